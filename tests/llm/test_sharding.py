import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rejoinder.llm import sharding

SCHEMA = "doc_id bigint, text string"


def plain_pack(items, shards):
    capacity = [max(sum(c) / shards, 1e-9) for c in zip(*items)]
    weighed = [[v / c * w for v, c, w in zip(i, capacity, sharding.WEIGHTS)] for i in items]
    residual = [[1.0] * len(capacity) for _ in range(shards)]
    chosen = {}
    for i in sorted(range(len(items)), key=lambda i: (-sum(weighed[i]), i)):
        dots = [sum(r * w for r, w in zip(residual[s], weighed[i])) for s in range(shards)]
        s = max(range(shards), key=lambda s: (dots[s], -s))
        chosen[i] = s
        residual[s] = [r - v / c for r, v, c in zip(residual[s], items[i], capacity)]
    return [chosen[i] for i in range(len(items))]


def test_packing_follows_the_rule():
    pick = random.Random(2)
    items = [[float(pick.randrange(1, 64)) for _ in range(3)] for _ in range(150)]
    assert sharding.pack(np.array(items), 5).tolist() == plain_pack(items, 5)
    assert sharding.pack(np.zeros((0, 3)), 5).tolist() == []


def made(copies):
    pick = random.Random(copies)
    rows = [(i, "text %d " % pick.randrange(3000) + "word " * pick.randrange(300)) for i in range(4000)]
    return rows + [(10_000 + i, "hot text of many copies é") for i in range(copies)] + [(5, "twice"), (5, "twice"), (6, None), (7, ""), (None, "x"), (8, "long " * 3000)]


@pytest.mark.parametrize("copies", [0, 300, 2500])
def test_shards(spark, copies):
    rows = made(copies)
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int").repartition(3)
    got = [r.asDict() for r in sharding.shards_of(docs).collect()]
    expect = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == expect
    sizes, counts = [0] * sharding.SHARDS, [0] * sharding.SHARDS
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert max(sizes) / min(sizes) < 1.02
    assert max(counts) / min(counts) < 1.6
    for s in range(sharding.SHARDS):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    places = {}
    for r in got:
        places.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    whole = len(rows) / sharding.SHARDS * sharding.SPLIT
    assert all(len(set(p)) == 1 for p in places.values() if len(p) <= whole)
    # a hot group lies in parts of no more than the split size, but for the unevenness of a hash
    assert all(len(set(p)) >= len(p) / (whole * 2) for p in places.values())


def test_small_tables(spark):
    assert sharding.shards_of(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sharding.shards_of(spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)).collect()
    assert sorted(r["slot"] for r in got) in ([0, 0], [0, 1])


def test_hot_text_of_one_id(spark):
    """Rows that agree in id and text cannot be told apart by a hash, and still are dealt out."""
    rows = [(None, "hot text") for _ in range(3000)] + [(i, "other %d" % i) for i in range(6000)]
    got = sharding.shards_of(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == 9000 and max(sizes.values()) / min(sizes.values()) < 1.01


def test_one_group_alone(spark):
    got = sharding.shards_of(spark.createDataFrame([(7, "same")] * 1600, SCHEMA)).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {100}


def test_groups_that_fit_stay_whole(spark):
    rows = [(i, "w%d " % i + "x" * 500) for i in range(1600)] + [(10_000 + i, "half-a-shard" + "y" * 400) for i in range(60)]
    got = sharding.shards_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 10_000}) == 1
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) / min(sizes.values()) < 1.01


def test_query_equals_packing_of_all_groups(spark):
    """The query's shards, from its units up, by a plain version of the rule."""
    from rejoinder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op6_vector_shards"](spark, folder).collect()
    key = {r["doc_id"]: (r["_hash"], r["size"], r["tokens"]) for r in sharding.measured(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert {r["doc_id"]: r["size"] for r in got} == {d: k[1] for d, k in key.items()} and len(got) == len(key)
    units = sharding.UNITS_PER_SHARD * sharding.SHARDS
    groups = {}
    for h, size, tokens in key.values():
        groups.setdefault((h, size), []).append((size, tokens, 1))
    whole = [sum(v[c] for g in groups.values() for v in g) / sharding.SHARDS for c in range(3)]
    share = {k: max(sum(v[c] for v in g) / whole[c] for c in range(3)) for k, g in groups.items()}
    crc = {(key[r["doc_id"]][0], r["size"]): r["text_crc32"] for r in got}
    notable = sorted((k for k in groups if share[k] >= sharding.NOTABLE), key=lambda k: (-share[k], k[0], crc[k], k[1]))
    unit, first = {}, units
    for k in notable:
        if share[k] <= 1:  # larger ones are dealt out by row: their rows' order is Spark's
            unit[k] = first
        first += 1 if share[k] <= 1 else -(-int(share[k] * 10_000) // int(sharding.SPLIT * 10_000))
    assert all(s <= 1 for s in share.values())
    items = {}
    for k, g in groups.items():
        own = items.setdefault(unit.get(k, k[0] % units), [0.0, 0.0, 0.0])
        for v in g:
            for c in range(3):
                own[c] += v[c]
    names = sorted(items)
    packed = sharding.levelled(np.array([items[n] for n in names]), np.array(plain_pack([items[n] for n in names], sharding.SHARDS)), sharding.SHARDS)
    shard = dict(zip(names, packed.tolist()))
    assert {r["doc_id"]: r["shard"] for r in got} == {d: shard[unit.get((h, s), h % units)] for d, (h, s, _) in key.items()}


def test_levelling_only_helps():
    pick = np.random.default_rng(4)
    for _ in range(30):
        items = np.floor(np.exp(3 * pick.normal(size=(pick.integers(1, 200), 3)))) + 1
        chosen = sharding.pack(items, 7)
        after = sharding.levelled(items, chosen, 7)
        spread = lambda c: np.ptp(np.bincount(c, weights=items[:, 0], minlength=7))
        assert spread(after) <= spread(chosen)
