import random

import public_tokenizers
import pytest
import regex

from rejoinder.llm import tokencount

SCORES = {b"a": -1.0, b"b": -1.5, b"ab": -2.5, b"abc": -2.0, b"c": -3.0, b"bc": -1.2, b" ": -1.0, b" a": -1.1, b"\xc3\xa9": -4.0, b"abcabc": -9.0}


def plain(word, scores):
    """Best score and, among equal ones, fewest tokens, over all segmentations."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + tokencount.UNKNOWN, best[end - 1][1] - 0 + 1)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best[end] = max(options, key=lambda o: (o[0], -o[1]))
    return best[len(word)][1], best[len(word)][0]


def test_trie_equals_dynamic_programming_on_each_word():
    pick, trie = random.Random(8), tokencount.Trie(SCORES)
    for _ in range(2000):
        word = "".join(pick.choice("abc é?") for _ in range(pick.randrange(12))).encode()
        tokens, score = trie.insert(word)
        assert (tokens, pytest.approx(score)) == plain(word, SCORES)
    nodes = len(trie.best)
    trie.insert(b"abcabcabc")
    trie.insert(b"abcabcabc")
    assert len(trie.best) <= nodes + 9


def test_counts_of_a_table(spark, monkeypatch):
    pattern = public_tokenizers.PATTERN
    rows = [(1, "ab abc, 12 é\n\n a"), (2, None), (3, ""), (4, "abc " * 60_000), (1, "ab abc, 12 é\n\n a"), (None, "zzz")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, trie int")
    got = sorted((tuple(r) for r in tokencount.counted(docs, SCORES, pattern).drop("text").collect()), key=repr)
    want = []
    for doc_id, text in rows:
        pieces = [plain(p.encode(), SCORES) for p in regex.findall(pattern, text or "")]
        want.append((doc_id, 5, len(pieces), sum(t for t, _ in pieces), pytest.approx(sum(s for _, s in pieces))))
    assert got == sorted(want, key=repr)
    assert tokencount.counted(docs.limit(0), SCORES, pattern).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, 9, "ab abc", 9.0)], "doc_id int, N_tokens int, text string, token_score double")
    out = tokencount.counted(docs, SCORES, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "n_pretokens", "n_tokens", "token_score"] and out.first()["n_pretokens"] == 2


def test_starting_anew_changes_nothing(monkeypatch):
    texts = [f"word{i} ab{i} abc" for i in range(50)]
    whole = tokencount.Counter(SCORES, public_tokenizers.PATTERN)
    want = [whole.count([t])[1][0] for t in texts]
    monkeypatch.setattr(tokencount, "MOST_NODES", 10)
    anew = tokencount.Counter(SCORES, public_tokenizers.PATTERN)
    assert [anew.count([t])[1][0] for t in texts] == want


def test_registered_query_equals_dynamic_programming(spark):
    from rejoinder.llm.queries import QUERIES, VOCABULARY

    folder = "/root/testdata/sf0.001"
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        scores = tokencount.ranked_scores(file.readlines())
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in QUERIES["op4_trie_token_counts"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) < 20000").collect()
    assert len(docs) > 0.9 * len(got)
    for r in docs:
        pieces = regex.findall(public_tokenizers.PATTERN, r["text"] or "")
        assert got[r["doc_id"]] == (len(pieces), sum(plain(p.encode(), scores)[0] for p in pieces))
