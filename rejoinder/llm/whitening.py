"""Whitening of embeddings along their leading principal components.

Entries become whole numbers, so that sums over all rows are exact whatever their order. Two passes gather them: the sums of
each dimension, then the products of the entries centred by the whole number next to their mean; the rest of the mean, at
most a half, is taken off in exact arithmetic. So a repeated task changes no digit of the covariance.

The covariance is a matrix of the dimensions, not of the rows, and its leading eigenvalues are found by spectrum slicing: by
Sylvester's law the signs of D in a factorisation LDL' of the covariance less a shift count the eigenvalues above
it. Bisection on that count gives each leading eigenvalue an interval of its own, Rayleigh quotient iteration
converges cubically within it, and counts on both sides of the result certify its number. Equal eigenvalues cannot be parted:
bisection ends at an interval as narrow as the rounding, and any orthonormal directions of their space will do.

Cases: null vectors and those with a null or non-finite entry are dropped; so is an entry beyond ``LARGEST``, whose
products have no exact sum. Vectors whose length isn't the commonest one (of two equally common the longer) lack entries
and are dropped as well, empty ones too. Rows with the same or a null ``vec_id`` are rows of their own.
With fewer dimensions than components there are as many components as dimensions. A component without variance, as
when all rows are equal, has a null ``whitened``; ``explained`` is 0, and null if no component has any. ``identity_error``
covers the components with variance, and is null without any. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.plans.session import saved

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# of a scaled entry; sums of products of 10**13 rows then fit a decimal of 38 digits
LARGEST = 1 << 40
# numbers whose sums of products over a batch are exact in doubles
EXACT = 1 << 53
SUM = "decimal(38,0)"


def scaled(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): whole-number vectors of the commonest length."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    # a null, infinite, undefined or very large entry fails the comparison
    fits = F.forall(F.col(column), lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(LARGEST), F.lit(False)))
    whole = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(fits)
    long = whole.select(F.col(id_column).alias("vec_id"), F.transform(x, lambda c: c.cast("long") + F.lit(shift)).alias("x"))
    sizes = long.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return long.filter(F.size("x") == (sizes["size"] if sizes else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def decimals(values: list[int]) -> pa.Array:
    """A number of more than 38 digits is null."""
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def products(y: np.ndarray) -> list[list[int]]:
    """Exact sums of products of the columns."""
    total: np.ndarray | int = 0
    largest = max(1, int(np.abs(y).max(initial=0)))
    rows = EXACT // (largest * largest)
    if not rows:
        y = y.astype(object)
        return (y.T @ y).tolist()
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total.tolist()


@dataclass
class Moments:
    """Exact sums over the fit list: of each dimension, and of products of entries centred by ``centre``."""

    n: int
    sums: list[int]
    centre: list[int]
    rest: list[int]  # sums of the centred entries
    square: list[list[int]]

    def covariance(self) -> np.ndarray:
        n = self.n
        return np.array([[float(Fraction(n * s - a * b, n * n)) for s, b in zip(row, self.rest)] for row, a in zip(self.square, self.rest)])


def moments(x: DataFrame) -> Moments:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + matrix(batch).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), decimals(total.tolist()), pa.array([n] * len(total))], names=["i", "s", "n"])

    each = x.select("x").mapInArrow(add, f"i int, s {SUM}, n bigint")
    rows = each.groupBy("i").agg(F.sum("s").cast(SUM).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # one for each dimension
    if not rows:
        return Moments(0, [], [], [], [])
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    centre = [round(Fraction(s, n)) for s in sums]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = len(centre), 0
        for batch in batches:
            if batch.num_rows:
                total = total + np.array(products(matrix(batch) - np.array(centre)), dtype=object)
        if isinstance(total, np.ndarray):
            upper = [(i, j) for i in range(size) for j in range(i, size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in upper], pa.int32()), pa.array([j for _, j in upper], pa.int32()), decimals([total[i, j] for i, j in upper])], names=["i", "j", "s"]
            )

    each = x.select("x").mapInArrow(multiply, f"i int, j int, s {SUM}")
    square = [[0] * len(sums) for _ in sums]
    for r in each.groupBy("i", "j").agg(F.sum("s").cast(SUM).alias("s")).collect():  # one for each pair of dimensions
        square[r["i"]][r["j"]] = square[r["j"]][r["i"]] = int(r["s"])
    return Moments(n, sums, centre, [s - n * c for s, c in zip(sums, centre)], square)


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie above ``shift``: the positive ones of D in LDL' of ``v - shift``.

    Pivots are single or pairs, chosen as Bunch and Kaufman do; a pair has a negative determinant and so one sign each.
    """
    a = v - shift * np.eye(len(v))
    bound = (1 + 17**0.5) / 8
    positive, k, n = 0, 0, len(a)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        biggest = column.max(initial=0.0)
        if biggest == 0.0:
            positive += a[k, k] > 0
            k += 1
            continue
        r = k + 1 + int(column.argmax())
        other = np.abs(a[r, k:]).copy()
        other[r - k] = 0.0
        width, pivot = 1, k
        if abs(a[k, k]) < bound * biggest:
            if abs(a[k, k]) * other.max() >= bound * biggest**2:
                pass
            elif abs(a[r, r]) >= bound * other.max():
                pivot = r
            else:
                width, pivot = 2, r
        at = k + width - 1
        if pivot != at:
            a[[at, pivot]] = a[[pivot, at]]
            a[:, [at, pivot]] = a[:, [pivot, at]]
        rest = slice(k + width, n)
        if width == 1:
            positive += a[k, k] > 0
            a[rest, rest] -= np.outer(a[rest, k], a[k, rest] / a[k, k])
        else:
            block = a[k : k + 2, k : k + 2]
            positive += 1
            a[rest, rest] -= a[rest, k : k + 2] @ np.linalg.solve(block, a[k : k + 2, rest])
        k += width
    return int(positive)


def isolated(v: np.ndarray, count: int) -> list[tuple[float, float]]:
    """For each of the ``count`` largest eigenvalues an interval with its number: more than it lie above the lower end, fewer
    above the upper one. Intervals are cut in half until they hold one eigenvalue or are as narrow as the rounding."""
    radius = np.abs(v).sum(axis=1).max(initial=0.0) * (1 + 1e-12) + 1e-300
    narrow = 8 * np.finfo(float).eps * radius * max(1, len(v))
    out = []
    for k in range(1, count + 1):
        lo, hi = -radius, out[-1][1] if out else radius
        above_lo, above_hi = len(v), count_above(v, hi) if out else 0
        while above_lo - above_hi > 1 and hi - lo > narrow:
            middle = (lo + hi) / 2
            above = count_above(v, middle)
            if above >= k:
                lo, above_lo = middle, above
            else:
                hi, above_hi = middle, above
        out.append((lo, hi))
    return out


def eigenpairs(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors in columns, each with its largest entry positive."""
    size = len(v)
    scale = np.abs(v).max(initial=0.0)
    values, vectors = np.zeros(count), np.zeros((size, count))
    if scale == 0.0:
        vectors[np.arange(count), np.arange(count)] = 1.0
        return values, vectors
    v = v / scale
    rounding = 64 * np.finfo(float).eps * size * np.abs(v).sum(axis=1).max()
    for k, (lo, hi) in enumerate(isolated(v, count)):
        while True:
            value, vector = rayleigh(v, lo, hi, vectors[:, :k])
            # the counts on both sides certify the number
            if count_above(v, value - rounding) > k >= count_above(v, value + rounding) or hi - lo <= rounding:
                break
            middle = (lo + hi) / 2
            if count_above(v, middle) > k:
                lo = middle
            else:
                hi = middle
        values[k], vectors[:, k] = value, vector * np.sign(vector[np.abs(vector).argmax()])
    return values * scale, vectors


def rayleigh(v: np.ndarray, lo: float, hi: float, known: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an interval, at right angles to the vectors known already."""
    shift, size = (lo + hi) / 2, len(v)
    off = lambda x: x - known @ (known.T @ x)
    x = off(off(np.cos(1.0 + np.arange(size) ** 2)))
    x /= np.linalg.norm(x)
    for i in range(rounds):
        y = x
        a = v - shift * np.eye(size)
        try:
            y = np.linalg.solve(a, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(a + np.finfo(float).eps * np.eye(size), x)
        if not np.isfinite(y).all() or not y.any():
            break
        y = off(off(y / np.abs(y).max()))
        y /= np.linalg.norm(y)
        value = float(y @ (v @ y))
        # first some steps of inverse iteration, until the quotient lies in the interval
        settled = abs(abs(float(x @ y)) - 1) < 1e-15 and np.linalg.norm(v @ y - value * y) < 1e-15 * size
        x = y
        if i >= 2 and lo <= value <= hi:
            shift = value
        if settled and i > 3:
            break
    return float(x @ (v @ x)), x


def whitened(x: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of the rows of :func:`scaled`."""
    kind = x.schema["vec_id"].dataType
    x = saved(x, "scaled-vectors")
    found = moments(x)
    shape = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    if not found.n:
        values, trace, count = np.zeros(0), 0.0, 0
        projected = x.sparkSession.createDataFrame([], shape)
    else:
        v = found.covariance()
        count = min(components, len(v))
        values, vectors = eigenpairs(v, count)
        trace = float(np.trace(v))
        # an eigenvalue within the rounding of the largest one is zero
        values = np.where(values > len(v) * np.finfo(float).eps * 16 * max(values[0], 0), values, 0.0)
        axes = np.divide(vectors, np.sqrt(values), out=np.full_like(vectors, np.nan), where=values > 0)
        projected = saved(x.mapInArrow(project(found, axes), shape), "whitened")
    rows = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    number = lambda values: F.array(*[F.lit(v).cast("double") for v in values])[F.col("at")] if len(values) else F.lit(None).cast("double")
    shares = [v / trace if trace else None for v in values.tolist()]
    error = identity_error(projected, [k for k in range(count) if values[k] > 0])
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        "whitened", number(shares).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def project(found: Moments, axes: np.ndarray):
    """From scaled vectors to exact deviations and whitened components."""
    n, centre, rest = found.n, np.array(found.centre), found.rest
    axes = np.nan_to_num(axes, nan=0.0), np.isnan(axes).any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch) - centre
            # n * x - S = n * y - (S - n * centre)
            largest = n * int(np.abs(y).max()) + max(map(abs, rest))
            kind = np.int64 if largest**2 * y.shape[1] < 1 << 63 else object
            z = n * y.astype(kind) - np.array(rest, dtype=kind)
            deviation = (z * z).sum(axis=1).tolist()
            w = (z.astype(np.float64) / n) @ axes[0]
            size = w.shape[1]
            flat = pa.array(w.ravel(), pa.float64(), mask=np.broadcast_to(axes[1], w.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), decimals(deviation), lists], names=["vec_id", "deviation", "w"])

    return run


def identity_error(projected: DataFrame, used: list[int]) -> float | None:
    """Largest entry of the whitened components' covariance less the identity."""
    if not used:
        return None
    of = lambda k: F.col("w")[k]
    means = projected.agg(*[F.avg(of(k)).alias(f"m{k}") for k in used]).first()
    centred = lambda k: of(k) - F.lit(means[f"m{k}"])
    entry = lambda i, j: F.abs(F.avg(centred(i) * centred(j)) - F.lit(float(i == j)))
    entries: list[Column] = [entry(i, j) for i in used for j in used if i <= j]
    return projected.agg(F.greatest(*entries, F.lit(0.0)).alias("most")).first()["most"]
