import random
import re

import numpy as np
import pytest
import xxhash

from rejoinder.llm import simhash

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (doc_id, fp)."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                label[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc_id)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", " \n\t ", "One", "two words", "A b C d e", "a b a b a b", "È é z y x\x0bw", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bit_counts():
    hashes = np.array([random.Random(i).getrandbits(64) for i in range(1000)], dtype=np.uint64)
    assert simhash.bit_counts(hashes).tolist() == [sum(int(h) >> b & 1 for h in hashes) for b in range(64)]


def test_links_of_random_balls(spark):
    pick = random.Random(5)
    prints = set()
    for _ in range(30):
        centre = pick.getrandbits(64)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in {pick.randrange(64) for _ in range(pick.randrange(5))}))
    prints = sorted(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine = [roots.get(signed(p), signed(p)) for p in prints]
    want = plain_components([(signed(p), p) for p in prints])
    assert mine == want
    assert 1 < len(set(mine)) < len(mine)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[i] for i in range(1, 101)} == {0}


def test_near_duplicates_and_keep_first(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(3, long), (1, long + " more"), (2, long), (9, None), (8, ""), (7, "Alone here now"), (7, "Alone here now"), (None, long), (6, "x y")]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], SCHEMA + ", fp string, _id int")
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert got == sorted(((d, signed(f), c) for (d, f), c in zip(prints, plain_components(prints))), key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in plain_components(prints)})


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0


def test_registered_query_links_as_brute_force(spark):
    from rejoinder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in prints}
    assert [got[d]["component_id"] for d, _ in prints] == plain_components(prints)
