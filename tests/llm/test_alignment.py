import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rejoinder.llm import alignment
from rejoinder.llm.queries import PIECE_MODEL, tokenizer_json

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as file:
        return file.read()


def plain(texts, model):
    """The contract's columns by going along the whole texts."""
    a, b = Tokenizer.from_str(tokenizer_json()), SentencePieceProcessor()
    a.encode_special_tokens = True
    b.LoadFromSerializedProto(model)
    letters = alignment.byte_letters()
    name_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    name_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each, counts = [], Counter()
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[name_a(i) for i in ids[0]], [name_b(i) for i in ids[1]]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            each.append(None)
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(i) for i, e in zip(own, at) if before < e <= cut) for own, at in zip(ids, ends)) for before, cut in zip([0, *cuts], cuts)]
        first = lambda at, byte: next(k for k, e in enumerate(at) if e > byte)
        links = sorted({(first(ends[0], x), first(ends[1], x)) for x in range(ends[0][-1])})
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        counts.update(pairs)
        each.append((len(ids[0]), len(ids[1]), len(cuts), pairs, sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (*e[:3], len(e[3]), sum(counts[p] == most[p[1]] for p in e[3]), sum(counts[p] for p in e[3]), e[4]) if e else (0,) * 6 + ("",) for e in each
    ]


TEXTS = [
    None, "", " ", "a", "Hello world, hello World!", "  two  spaces ", "line\nends\n\nand\ttabs \n x", "▁marked", "mixed ▁ mark",
    "naïve café ﬁ ① \U0001f600\U0001f44d\U0001f3fd", "日本語の文章です。空白がない" * 30, "<|endoftext|> <s> </s> <unk> <0x0A>",
    "a\x00b \x1c c", "nb\xa0sp and　wide", "Hello world, hello World!", "x" * 3_000, "word " * 2_000, "é combining", "I'm don't we'll 's", "ไทย العربية",
]


def test_equals_whole_texts(spark, model):
    pick = random.Random(3)
    made = ["".join(pick.choice("ab é\n中'.,1 ") for _ in range(pick.randrange(60))) for _ in range(150)]
    texts = [*TEXTS, *made]
    rows = [(i, t, "taken", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, groups_sha256 string, part double").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(docs, tokenizer_json(), model, part_bytes=2_000).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, model)


def test_repeated_rows_and_null_ids(spark, model):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id bigint, text string")
    got = alignment.aligned(docs, tokenizer_json(), model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(plain(["a b", "a b", "a c"], model))
    assert alignment.aligned(docs.limit(0), tokenizer_json(), model).count() == 0


def test_shared_cuts_by_halving():
    pick = random.Random(5)
    for _ in range(300):
        size = pick.randrange(1, 200)
        share = pick.choice([0.05, 0.5, 0.9])
        a = sorted({size, *(x for x in range(1, size) if pick.random() < share)})
        b = sorted({size, *(x for x in range(1, size) if pick.random() < 1 - share)})
        got = alignment.shared_cuts(np.array(a), np.array(b), np.array([0]), np.array([len(a) - 1]))
        assert [a[i] for i in got] == sorted(set(a) & set(b))
