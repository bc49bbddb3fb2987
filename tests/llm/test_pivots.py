import random
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rejoinder.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, every, k):
    """The best k for each query row, by all inner products."""
    known = {(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    product = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  a shorter vector is filled up with zeros
    out = []
    for q, x in known:
        if q % every == 0:
            best = sorted((-product(x, y), i) for i, y in known if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, every=3, k=5, schema=SCHEMA):
    top = pivots.top_k(pivots.quantised(spark.createDataFrame(rows, schema)), F.col("vec_id") % every == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top.collect())


@pytest.fixture
def small(monkeypatch):
    """Sizes at which a few rows make several pivots, chunks and rounds."""
    for name, value in {"PIVOT_ROWS": 40, "CHUNK_ROWS": 16, "QUERY_ROWS": 8, "PART_CHUNKS": 2, "FIRST_ROWS": 32, "GROWTH": 2}.items():
        monkeypatch.setattr(pivots, name, value)


@pytest.mark.parametrize("kind", ["spread", "grouped", "norms", "same"])
def test_equals_all_inner_products(spark, small, kind):
    pick = np.random.default_rng(7)
    x = pick.normal(size=(400, 6))
    if kind == "grouped":
        x = np.repeat(pick.normal(size=(8, 6)) * 5, 50, axis=0) + 0.05 * x
    elif kind == "norms":
        x *= np.exp(3 * pick.normal(size=(400, 1)))
    elif kind == "same":
        x[:150] = x[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(pick.permutation(400), x)]
    assert found(spark, rows) == plain(rows, 3, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [1.0, -2.0]), (3, [0.5, 0.0]), (1, [1.0, 2.0]), (2, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [3.0]), (9, [0.0, 0.0, 4.0]), (10, [3e38, 1.0]),
    ]
    assert found(spark, rows) == plain([r for r in rows if r[0] != 10], 3, 5)
    top = pivots.top_k(pivots.quantised(spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA + ", score double, annulus string")), F.col("vec_id") % 3 == 0)
    assert top.columns == ["query_id", "query_key", "rank", "vec_id", "score"]


def test_large_numbers_stay_exact(spark):
    pick = random.Random(1)
    rows = [(i, [pick.uniform(-1, 1) * 2**20 for _ in range(8)]) for i in range(60)]
    assert found(spark, rows, schema="vec_id bigint, embedding array<double>") == sorted(
        (q, r, i, s) for q, r, i, s in plain_double(rows)
    )


def plain_double(rows):
    known = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    for q, x in known:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in known if i != q)[:5]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(best))


def test_few_rows(spark):
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == [] and found(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]) == [(0, 1, 1, 2 * 65536), (0, 2, 2, -65536)]


def test_bounds_hold():
    pick = np.random.default_rng(2)
    x = np.floor(256 * pick.normal(size=(300, 5))).astype(np.int64)
    fit = pivots.Fit(x[:100], 6)
    annulus, far = fit.keys(x)
    names = np.unique(annulus)
    of = lambda f, v: np.array([f(v[annulus == a]) for a in names])
    norm = (x.astype(float) ** 2).sum(axis=1)
    directory = pivots.Directory(names, names // (fit.edges.shape[1] + 1), of(np.min, far), of(np.max, far), of(np.max, norm), of(len, far), of(len, far))
    bounds = directory.bounds(x, fit.pivots)
    for j, a in enumerate(names):
        assert (bounds[:, j] >= (x @ x[annulus == a].T).max(axis=1)).all()


def test_plans_and_rows_stay_small(spark, small, monkeypatch):
    kept, saved = {}, pivots.saved

    def noted(df, label, *args, **options):
        kept.setdefault(label, []).append(saved(df, label, *args, **options))
        return kept[label][-1]

    monkeypatch.setattr(pivots, "saved", noted)
    monkeypatch.setattr(pivots, "ROW_BYTES", 4 * 600 * 2)
    monkeypatch.setattr(pivots, "WIDE_ROWS", pivots.WIDE_ROWS | {"parquet.block.size": 32 << 10})
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(240, 600)))]
    assert found(spark, rows) == plain(rows, 3, 5)
    blocks, chunks = kept["query-blocks"][0].count(), kept["pivot-index"][0]
    assert chunks.select("annulus").distinct().count() > 20 and len(kept["visits"]) > 2
    # a plan has a row for each block and its queries once, however many annuli they visit
    for planned in kept["visits"]:
        assert planned.count() <= blocks
        assert planned.agg(F.sum(F.octet_length("queries"))).first()[0] <= 80 * 600 * 2
    assert chunks.agg(F.max("n")).first()[0] == 4
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in chunks.inputFiles()]
    assert all(m.row_group(g).total_byte_size < 64 << 10 for m in files for g in range(m.num_row_groups)) and max(m.num_row_groups for m in files) > 1


def test_cells_have_many_parts(spark, small, monkeypatch):
    for name, value in {"CELL": 3, "CHUNK_ROWS": 4, "MOST_CHUNKS": 2}.items():
        monkeypatch.setattr(pivots, name, value)
    x = np.random.default_rng(6).normal(size=(300, 6))
    x[:150] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    assert found(spark, rows) == plain(rows, 3, 5)


@pytest.mark.parametrize("largest", [1 << 7, 1 << 9, 1 << 14, 1 << 26])
def test_scores_are_exact(largest):
    pick = np.random.default_rng(4)
    a, b = pick.integers(-largest, largest, size=(9, 64)), pick.integers(-largest, largest, size=(30, 64))
    a[0] = b[0] = largest - 1
    assert pivots.scores(a, b).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
