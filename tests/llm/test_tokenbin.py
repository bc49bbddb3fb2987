import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rejoinder.llm import tokenbin
from rejoinder.llm.queries import tokenizer_json

TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "Hello, world. It's 12,5 o'clock", "tab\tand\nline ends\n", "\n\nx y",
    "don't stop <|endoftext|> now", "<|endoftext|>", "é è ñ ß x y z  q", "\x1c a\x1c b", "日本語 テキスト 🙂 ok", "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library(library):
    encoder = tokenbin.Encoder(tokenizer_json())
    for _ in range(2):
        ids, sizes = encoder.encode(TEXTS)
        want = [plain(library, t) for t in TEXTS]
        assert sizes.tolist() == list(map(len, want))
        assert ids.tolist() == sum(want, [])


def test_every_white_space_and_marks_behind_words(library):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [t for b in blanks for t in (f"one{b}two three", f" é{b}{b}ü o", f"ß ñ.{b}", f"{b}", f"日本{b} a")]
    encoder = tokenbin.Encoder(tokenizer_json())
    assert [encoder.is_plain(t) for t in texts] == [not encoder.odd.search(t) for t in texts]
    ids, _ = encoder.encode(texts)
    assert ids.tolist() == sum((plain(library, t) for t in texts), [])


def test_text_of_several_segments_and_pieces_known_from_a_task_before(library):
    text = " ".join(f"wörd{i % 7919} {i}" for i in range(120_000)) + "."
    assert len(text) > tokenbin.SEGMENT
    shipped = {"tokenizer": tokenizer_json()}
    for _ in range(2):  # two tasks of a worker
        encoder = tokenbin.kept_encoder(shipped, 0)
        before = len(encoder.sizes)
        ids, sizes = encoder.encode([text, "", text])
        want = plain(library, text)
        assert sizes.tolist() == [len(want), 1, len(want)] and ids.tolist() == [*want, 0, *want]
    assert before > 7919 and len(encoder.sizes) == before


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], list(range(70_000)), [2**32 - 1, 0, 7]])
def test_round_trip_of_planes(bits, ids):
    ids = np.array(ids, dtype=np.uint32)
    payload = tokenbin.pack(ids, bits, 1000)
    assert tokenbin.unpack(payload).tolist() == ids.tolist()
    if len(ids) > 1000:
        assert tokenbin.unpack_block(payload, 3).tolist() == ids[3000:4000].tolist()


def test_documents_read_back(spark, library):
    rows = [(i * 3 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, None), (4, "twice"), (4, "twice")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, part string").repartition(3)
    stored = tokenbin.write(docs, tokenizer_json(), chunk_ids=500, block_ids=64)
    got = [tuple(r) for r in tokenbin.read_documents(stored).orderBy("start").collect()]
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(library, text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenbin.read_documents(tokenbin.write(none, tokenizer_json())).count() == 0


def test_pieces_that_share_a_hash_are_encoded_whole(library, monkeypatch):
    monkeypatch.setattr(tokenbin.Encoder, "hash", lambda self, data, starts, lengths: np.zeros(len(starts), dtype=np.uint64))
    ids, sizes = tokenbin.Encoder(tokenizer_json()).encode(TEXTS)
    assert ids.tolist() == sum((plain(library, t) for t in TEXTS), [])
    assert sizes.tolist() == [len(plain(library, t)) for t in TEXTS]


@pytest.mark.parametrize("segment", [16, 200])
def test_segments_and_starting_anew_change_nothing(library, monkeypatch, segment):
    monkeypatch.setattr(tokenbin, "SEGMENT", segment)
    monkeypatch.setattr(tokenbin, "REMEMBERED", 5)
    encoder = tokenbin.Encoder(tokenizer_json())
    texts = ["some words, and more.\nNext line é here", "ab " * 300 + "end", "x" * 150, "last"]
    for _ in range(2):
        ids, sizes = encoder.encode(texts)
        assert ids.tolist() == sum((plain(library, t) for t in texts), [])
        assert sizes.tolist() == [len(plain(library, t)) for t in texts]


def test_tasks_of_a_worker_share_the_encoder(spark):
    shipped = spark.sparkContext.broadcast({"tokenizer": tokenizer_json()})

    def run(batches):
        for _ in batches:
            pass
        known = "encoder" in shipped.value
        tokenbin.kept_encoder(shipped.value, 0)
        yield pa.RecordBatch.from_pydict({"known": [known]})

    # far more tasks than workers
    got = [r.known for r in spark.range(0, 40, 1, 40).mapInArrow(run, "known boolean").collect()]
    assert len(got) == 40 and sum(got) >= 20
