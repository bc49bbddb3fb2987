"""Exact search for the largest inner products with an index of pivots and distances.

Components become whole numbers, so scores are exact. Every vector is keyed by its nearest pivot and its distance from it;
the distances of a pivot's vectors are cut into rings. Such an annulus holds its vectors in chunks sorted by distance. As
``2 * q.x = |q|^2 + |x|^2 - d(q, x)^2``, and the triangle inequality keeps ``d(q, x)`` above the distance of ``d(q, pivot)``
from the annulus, each annulus has a largest score it can hold for a query.

A query visits annuli in falling order of that bound. It begins with those that hold ``FIRST_ROWS`` vectors, and each round
takes in ``GROWTH`` times as many, so the number of rounds grows with the logarithm of the table. A query stops at the
first annulus whose bound lies below its k-th best score so far; equal bounds are still visited, as ties go
to the smaller id. Queries go by in blocks, and a block meets only the chunks that one of its queries has to see.

Memory doesn't grow with the table. The plan of a round has one row for each block, with a bit for each query and annulus; from it
a block's queries are sent once to each part of a cell, which is ``CELL`` neighbouring annuli, whatever annuli they visit there. A
chunk or block holds at most ``ROW_BYTES`` of vectors, a part at most ``MOST_CHUNKS`` chunks, and saved tables of them have small
row groups and pages, as Spark reads a row group at once.

Pivots and ring edges are fitted to at most ``SAMPLE_ROWS`` vectors chosen by a hash; any pivots and edges give the
same result. The directory of annuli has at most ``PIVOTS * RINGS`` rows; nothing else is sent to all tasks.

Cases: rows with a null id take no part, nor do vectors that are null, empty or hold a null or non-finite component, nor those
whose inner product with themselves doesn't fit in 62 bits. A shorter vector counts as filled up with zeros. Rows with
the same id and vector are one; different vectors of one id are queries and candidates of their own, told apart by
``query_key``, and none answers for its own id. Other columns are not read. An empty table, or one vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import partitions
from rejoinder.plans.session import saved

SCALE = 256
PIVOTS, RINGS, SAMPLE_ROWS = 256, 8, 8_192
# vectors for each pivot, until there are PIVOTS of them
PIVOT_ROWS = 4_096
CHUNK_ROWS, QUERY_ROWS = 1_024, 256
# bytes of vectors in one row, so that long vectors come fewer at a time
ROW_BYTES = 256 << 10
# annuli that a query is sent to once, at most as many as a long has bits
CELL = 16
# chunks of a cell that stay together, about a share of 1 / PARTS of all; a large cell is spread over many tasks
PARTS, PART_CHUNKS, MOST_CHUNKS = 64, 8, 256
# for tables whose rows have hundreds of kilobytes: a reader holds a row group, a codec holds a page
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 16, "parquet.enable.dictionary": False}
FIRST_ROWS, GROWTH = 2_048, 8
LARGEST_NORM = float(1 << 62)
# inner products below these are exact in singles and doubles
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 53)
ROUNDING = 1e-6


def quantised(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): distinct rows with whole-number components."""
    value = lambda c: c.cast("double") * scale
    square = F.aggregate(F.transform(F.col(column), lambda c: F.pow(F.floor(value(c)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    # a null, infinite, undefined or very large component fails the comparison
    fits = F.forall(F.col(column), lambda c: F.coalesce(F.abs(value(c)) < LARGEST_NORM, F.lit(False)))
    return (
        vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0))
        .filter(fits)
        .filter(square < LARGEST_NORM)
        .select(F.col(id_column).cast("long").alias("vec_id"), F.transform(F.col(column), lambda c: F.floor(value(c)).cast("long")).alias("x"))
        .distinct()
    )


def matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dimensions), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


class Fit:
    """Pivots, and for each the edges of its rings."""

    def __init__(self, sample: np.ndarray, count: int, rings: int = RINGS, rounds: int = 8):
        sample = sample.astype(np.float64)
        self.pivots = np.unique(sample[:count], axis=0)
        for _ in range(rounds):  # towards the means of what is nearest
            near = distances(sample, self.pivots).argmin(axis=1)
            sums, n = np.zeros_like(self.pivots), np.bincount(near, minlength=len(self.pivots))
            np.add.at(sums, near, sample)
            self.pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.pivots)
        far = distances(sample, self.pivots)
        near, own = far.argmin(axis=1), far.min(axis=1)
        self.edges = np.array([np.quantile(own[near == p], np.arange(1, rings) / rings) if (near == p).any() else np.zeros(rings - 1) for p in range(len(self.pivots))])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus and distance from the pivot."""
        far = distances(x, self.pivots)
        near, own = far.argmin(axis=1), far.min(axis=1)
        ring = (own[:, None] > self.edges[near]).sum(axis=1)
        return near * (self.edges.shape[1] + 1) + ring, own


class Directory:
    """What the annuli hold: at most ``PIVOTS * RINGS`` of them."""

    def __init__(self, annuli: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray, rows: np.ndarray, parts: np.ndarray):
        # parts are those of the annulus' cell
        self.annuli, self.pivot, self.low, self.high, self.norm, self.rows, self.parts = annuli, pivot, low, high, norm, rows, parts

    def bounds(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """The largest score that each annulus can hold for each query."""
        square = (x.astype(np.float64) ** 2).sum(axis=1)[:, None]
        far = distances(x, pivots)[:, self.pivot]
        gap = np.maximum(np.maximum(self.low - far, far - self.high), 0)
        size = np.sqrt(square) + np.sqrt(self.norm)
        gap = np.maximum(gap - ROUNDING * size, 0)
        bound = np.minimum((square + self.norm - gap * gap) / 2, np.sqrt(square * self.norm))
        return bound + ROUNDING * (1 + size)


def keyed(rows: DataFrame, fit: tuple[np.ndarray, np.ndarray], dimensions: int) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fit.__new__(Fit)
        own.pivots, own.edges = shipped.value
        for batch in batches:
            if batch.num_rows:
                annulus, far = own.keys(matrix(batch.column("x"), dimensions))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(annulus.astype(np.int32)), pa.array(far)], names=["vec_id", "x", "annulus", "far"])

    return rows.mapInArrow(run, "vec_id bigint, x array<bigint>, annulus int, far double")


def packed(rows: DataFrame, dimensions: int, kind: str, most: int, total: int, by_annulus: bool) -> DataFrame:
    """Vectors sorted by annulus and distance, at most ``most`` in a row as the bytes of their ids and of their matrix."""
    most = max(1, min(most, ROW_BYTES // (np.dtype(kind).itemsize * dimensions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, kept = TaskContext.get().partitionId() << 32, 0, []

        def row(ids: np.ndarray, x: np.ndarray, annulus: np.ndarray, far: np.ndarray) -> list:
            norm = float((x.astype(np.float64) ** 2).sum(axis=1).max())
            return [int(annulus[0]), task + n, len(ids), float(far.min()), float(far.max()), norm, ids.tobytes(), x.astype(kind).tobytes()]

        names = ["annulus", "number", "n", "low", "high", "norm", "ids", "x"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
        whole = lambda r: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, types)], names=names)
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((batch.column("vec_id").to_numpy(), matrix(batch.column("x"), dimensions), batch.column("annulus").to_numpy(), batch.column("far").to_numpy()))
            ids, x, annulus, far = map(np.concatenate, zip(*kept))
            cuts = np.flatnonzero(np.diff(annulus)) + 1 if by_annulus else np.zeros(0, dtype=np.int64)
            at = 0
            while True:
                end = min([at + most, *cuts[cuts > at][:1].tolist()])
                if end >= len(ids):
                    break
                yield whole(row(ids[at:end], x[at:end], annulus[at:end], far[at:end]))
                n, at = n + 1, end
            kept = [(ids[at:], x[at:], annulus[at:], far[at:])]
        if kept:
            yield whole(row(*kept[0]))

    spread = max(1, min(partitions(rows.sparkSession), total // (PART_CHUNKS * most)))
    order = ["annulus", "far", "vec_id"]
    return rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).mapInArrow(
        run, "annulus int, number bigint, n int, low double, high double, norm double, ids binary, x binary"
    )


class Index:
    """The saved chunks of all vectors, and what is needed to search them."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS):
        rows = saved(rows, "vectors")
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).first()
        self.spark, self.rows, self.n, self.dimensions = rows.sparkSession, rows, facts["n"], facts["d"] or 0
        if not self.n:
            return
        self.kind = next((t for t, bits in (("<i2", 15), ("<i4", 31)) if facts["most"] < 1 << bits), "<i8")
        sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample_rows).select("x").toArrow().column("x").combine_chunks()
        fit = Fit(matrix(sample, self.dimensions), max(1, min(pivots, self.n // PIVOT_ROWS)))
        self.fit = fit.pivots, fit.edges
        self.keyed = saved(keyed(rows, self.fit, self.dimensions), "vectors-keyed")
        chunks = saved(packed(self.keyed, self.dimensions, self.kind, CHUNK_ROWS, self.n, True), "pivot-index", **WIDE_ROWS)
        # a row for each annulus
        found = chunks.groupBy("annulus").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("chunks")
        ).orderBy("annulus").collect()
        column = lambda c: np.array([r[c] for r in found])
        cell, rings = column("annulus") // CELL, fit.edges.shape[1] + 1
        chunks_of = np.bincount(cell, weights=column("chunks")).astype(np.int64)
        parts = -(-chunks_of // min(max(PART_CHUNKS, chunks_of.sum() // PARTS), MOST_CHUNKS))
        self.directory = (column("annulus"), column("annulus") // rings, *map(column, ("low", "high", "norm", "rows")), parts[cell])
        listed = self.spark.createDataFrame([(c, n) for c, n in enumerate(parts.tolist()) if n], "cell int, parts int")
        near = chunks.withColumns({"cell": F.expr(f"cast(annulus div {CELL} as int)"), "bit": F.col("annulus") % CELL})
        # one row for each cell
        self.chunks = near.join(F.broadcast(listed), "cell").withColumn("part", F.pmod("number", "parts").cast("int"))

    def query_blocks(self, which: Column) -> DataFrame:
        asked = self.keyed.filter(which)
        blocks = packed(asked, self.dimensions, self.kind, QUERY_ROWS, asked.count(), False)
        return saved(blocks.select(F.col("number").alias("block"), F.col("ids").alias("query_ids"), F.col("x").alias("queries")), "query-blocks", **WIDE_ROWS)


def visits(blocks: DataFrame, best: DataFrame | None, index: Index, k: int, start: int, target: int) -> DataFrame:
    """(block, query_ids, queries, floors, needs): for each block, a bit for each query and annulus that it visits in this round.

    In falling order of bounds, a query's annuli behind those that hold its first ``start`` vectors, up to those
    that hold ``target``, as far as their bounds reach its k-th best score.
    """
    shipped = index.spark.sparkContext.broadcast((index.fit[0], index.directory))  # pivots and directory
    kind, dimensions = index.kind, index.dimensions
    schema = "block bigint, query_ids binary, queries binary, floors binary, needs binary"
    names = ["block", "query_ids", "queries", "floors", "needs"]

    def plan(block: int, ids: bytes, queries: bytes, x: np.ndarray, floor: np.ndarray) -> list[pa.RecordBatch]:
        pivots, columns = shipped.value
        directory = Directory(*columns)
        bounds = directory.bounds(x, pivots)
        order = np.argsort(-bounds, axis=1, kind="stable")
        reached = np.cumsum(directory.rows[order], axis=1)
        before = reached - directory.rows[order]
        sorted_bounds = np.take_along_axis(bounds, order, axis=1)
        wanted = (before >= start) & (before < target) & (sorted_bounds >= floor[:, None])
        needs = np.zeros_like(wanted)
        np.put_along_axis(needs, order, wanted, axis=1)
        if not needs.any():
            return []
        row = [block, ids, queries, floor.tobytes(), np.packbits(needs, axis=1).tobytes()]
        return [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), *[pa.binary()] * 4])], names=names)]

    def vectors(payload: bytes) -> np.ndarray:
        return np.frombuffer(payload, dtype=kind).reshape(-1, dimensions).astype(np.int64)

    lowest = np.iinfo(np.int64).min
    if best is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = vectors(row["queries"])
                    yield from plan(row["block"], row["query_ids"], row["queries"], x, np.full(len(x), lowest))

        return blocks.mapInArrow(run, schema)

    def again(own: pa.Table, found: pa.Table) -> pa.Table:
        """A block, and at most k scores for each of its queries."""
        queries = own.column("queries")[0].as_py()
        x = vectors(queries)
        floor = np.full(len(x), lowest)
        at = found.column("at").to_numpy()
        full = np.bincount(at, minlength=len(x)) >= k
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, at, found.column("score").to_numpy())
        floor[full] = least[full]
        planned = plan(own.column("block")[0].as_py(), own.column("query_ids")[0].as_py(), queries, x, floor)
        if planned:
            return pa.Table.from_batches(planned)
        return pa.table([pa.array([], t) for t in (pa.int64(), *[pa.binary()] * 4)], names=names)

    return blocks.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(again, schema)


def sent(planned: DataFrame, index: Index) -> DataFrame:
    """(cell, part, bits, block, at, asked_ids, asked, floors, needs): the queries of a block that visit a cell, once for each part of its chunks.

    ``needs`` has the annuli of the cell that each query visits, one bit each, and ``bits`` all of them.
    """
    shipped = index.spark.sparkContext.broadcast(index.directory)
    kind, dimensions, size = index.kind, index.dimensions, CELL
    names = ["cell", "part", "bits", "block", "at", "asked_ids", "asked", "floors", "needs"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(*shipped.value)
        bit = np.int64(1) << (directory.annuli % size).astype(np.int64)
        near = [(c, np.flatnonzero(directory.annuli // size == c)) for c in np.unique(directory.annuli // size).tolist()]
        for batch in batches:
            for row in batch.to_pylist():
                ids, floor = np.frombuffer(row["query_ids"], dtype=np.int64), np.frombuffer(row["floors"], dtype=np.int64)
                x = np.frombuffer(row["queries"], dtype=kind).reshape(-1, dimensions)
                needs = np.unpackbits(np.frombuffer(row["needs"], dtype=np.uint8).reshape(len(ids), -1), axis=1, count=len(bit))
                for cell, annuli in near:
                    bits = needs[:, annuli] @ bit[annuli]
                    at = np.flatnonzero(bits).astype(np.int32)
                    if not len(at):
                        continue
                    one = [int(np.bitwise_or.reduce(bits)), row["block"], *[a.tobytes() for a in (at, ids[at], x[at], floor[at], bits[at])]]
                    for part in range(int(directory.parts[annuli[0]])):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([cell, part, *one], types)], names=names)

    return planned.mapInArrow(
        run, "cell int, part int, bits bigint, block bigint, at binary, asked_ids binary, asked binary, floors binary, needs binary"
    )


def scores(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    largest = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1).max() * (x.astype(np.float64) ** 2).sum(axis=1).max())
    for kind, exact in ((np.float32, EXACT_SINGLE), (np.float64, EXACT)):
        if largest * max(1, x.shape[1]) ** 0.5 < exact:
            return (asked.astype(kind) @ x.astype(kind).T).astype(np.int64)
    return asked.astype(np.int64) @ x.astype(np.int64).T


def visited(planned: DataFrame, index: Index, k: int) -> DataFrame:
    """(block, at, score, vec_id): at most k candidates of each chunk for each query that visits it."""
    kind, dimensions = index.kind, index.dimensions
    asked, chunks = sent(planned, index), index.chunks.select("cell", "part", "bit", "ids", "x")
    # only chunks of an annulus that one of the queries visits
    meets = (asked["cell"] == chunks["cell"]) & (asked["part"] == chunks["part"]) & F.expr("(bits & shiftleft(1L, bit)) != 0")
    met = asked.join(chunks, meets).select("block", "at", "asked_ids", "asked", "floors", "needs", "bit", "ids", "x")
    lowest = np.iinfo(np.int64).min  # no score is that low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name, dtype: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=dtype)  # noqa: B023, E731
                here = np.flatnonzero(of("needs", np.int64) >> batch.column("bit")[i].as_py() & 1)
                ids, at = of("ids", np.int64), of("at", np.int32)[here]
                found = scores(of("asked", kind).reshape(-1, dimensions)[here], of("x", kind).reshape(-1, dimensions))
                found[of("asked_ids", np.int64)[here][:, None] == ids] = lowest
                good = found >= np.maximum(of("floors", np.int64)[here], lowest + 1)[:, None]
                many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
                if len(many):
                    least = np.partition(found[many], len(ids) - k, axis=1)[:, len(ids) - k]
                    good[many] = found[many] >= least[:, None]
                q, c = np.divmod(np.flatnonzero(good), len(ids))
                value = found[q, c]
                order = np.lexsort((ids[c], -value, q))
                q, c, value = q[order], c[order], value[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                if kept.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(kept.sum(), batch.column("block")[i].as_py())), pa.array(at[q[kept]]), pa.array(value[kept]), pa.array(ids[c[kept]])],
                        names=["block", "at", "score", "vec_id"],
                    )

    return met.mapInArrow(run, "block bigint, at int, score bigint, vec_id bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, which: Column, k: int = 5, **options: int) -> DataFrame:
    """(query_id, query_key, rank, vec_id, score): the best of all vectors for those that ``which``, on ``vec_id``, holds for."""
    index = Index(vectors, **options)
    schema = "query_id bigint, query_key bigint, rank int, vec_id bigint, score bigint"
    if not index.n:
        return index.spark.createDataFrame([], schema)
    blocks = index.query_blocks(which)
    best, start, target = None, 0, FIRST_ROWS
    while start < index.n:
        planned = saved(visits(blocks, best, index, k, start, target), "visits", **WIDE_ROWS)
        found = visited(planned, index, k)
        best = saved(best_of(found if best is None else best.drop("rank").union(found), k), "best")
        start, target = target, target * GROWTH
    kind, dimensions = index.kind, index.dimensions

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["query_ids"], dtype=np.int64), np.frombuffer(row["queries"], dtype=kind).reshape(-1, dimensions)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dimensions, pa.int32()), pa.array(x.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), lists], names=["block", "at", "query_id", "x"]
                )

    named = blocks.mapInArrow(names, "block bigint, at int, query_id bigint, x array<bigint>").select("block", "at", "query_id", F.xxhash64("x").alias("query_key"))
    return best.join(named, ["block", "at"]).select("query_id", "query_key", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
