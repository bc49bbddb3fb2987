"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits. A bit is 1 if it is 1 in more than half of the hashes of the text's word
shingles. Two fingerprints are linked if at most two bits differ. The index cuts a fingerprint into two
segments of 32 bits. Of two linked fingerprints either the upper segments differ in at most one bit, or the
lower ones are equal. So the index enumerates the ball of radius 1 around the upper segment and radius 0
around the lower one, looks up what shares the segment, and verifies the complete distance.

Work is done once for each distinct fingerprint, so copies cost one row whatever their number. Inside a
bucket a fingerprint looks for its possible partners in a sorted array; pairs are never multiplied out,
and a bucket hands on one row for each linked fingerprint instead of all its pairs.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other.
A text of any length is read whole, its shingles a block at a time.
Rows with the same ``doc_id`` are rows of their own. A null ``doc_id`` is a value of its own, larger than all others.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import keyed_as, partitions, rows_by_key, slices, text_key, texts_of
from rejoinder.plans.session import saved

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
HALF = 32
LOW = (1 << HALF) - 1
# shingles hashed at a time
BLOCK = 1 << 16
# index rows that a task holds at a time: their number decides how many tasks there are
TASK_ROWS = 4_000_000
# rows of bits that can be summed in one byte
LANE = 255


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    whole = len(bits) // LANE * LANE
    total = np.zeros(BITS, dtype=np.int64)
    if whole:
        lanes = bits[:whole].reshape(-1, LANE, 8).sum(axis=1, dtype=np.uint64)
        total += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    if whole < len(bits):
        total += bits[whole:].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    last = max(0, len(words) - shingle_words) + 1
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    width = min(shingle_words, len(words)) - 1
    for at in range(0, last, BLOCK):
        to = min(at + BLOCK, last)
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:to], ends[at + width : to + width])]
        counts += bit_counts(np.array(hashes, dtype=np.uint64))
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > last).tolist()))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle_words) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


def index_rows(distinct: DataFrame) -> DataFrame:
    """(side, key, fp, probe): table entries of both segments, and probes of the upper one.

    A pair whose upper segments differ in one bit is met once: by the one that has the bit set.
    """
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit(LOW))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda i: F.call_function("getbit", upper, i) == 1)
    entries = F.array(
        F.struct(F.lit(0).alias("side"), upper.alias("key"), F.lit(False).alias("probe")),
        F.struct(F.lit(1).alias("side"), lower.alias("key"), F.lit(False).alias("probe")),
    )
    flipped = lambda i: upper.bitwiseXOR(F.element_at(F.lit([1 << b for b in range(HALF)]), i + 1))
    probes = F.transform(
        set_bits, lambda i: F.struct(F.lit(0).alias("side"), flipped(i).alias("key"), F.lit(True).alias("probe"))
    )
    return distinct.select("fp", F.explode(F.concat(entries, probes)).alias("e")).select("e.*", "fp")


def ball(bits: int, radii: range) -> list[int]:
    return [sum(1 << b for b in c) for r in radii for c in combinations(range(bits), r)]


def matches(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``wanted`` whose value is in the sorted ``table``, and these values."""
    at = np.searchsorted(table, wanted)
    hit = np.flatnonzero(table[np.minimum(at, len(table) - 1)] == wanted)
    return hit, wanted[hit]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the given ones, one for each node but the smallest of its tree."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        for side in (left, right):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def lookups(side: np.ndarray, key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links among the entries and probes of whole buckets, as edges that join the same fingerprints."""
    upper = np.sort(fp[(side == 0) & ~probe])
    lower = np.sort(fp[side == 1])
    seekers, keys = fp[probe], key[probe]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def look(table: np.ndarray, own: np.ndarray, wanted: np.ndarray) -> None:
        hit, partner = matches(table, wanted)
        if len(hit):
            found.append((own[hit], partner))

    if len(upper):
        for mask in ball(HALF, range(1, 3)):
            look(upper, upper, upper ^ np.uint64(mask))
        targets = (keys << np.uint64(HALF)) | (seekers & np.uint64(LOW))
        order = np.argsort(targets)
        targets, seekers = targets[order], seekers[order]
        for mask in ball(HALF, range(0, 2)):
            look(upper, seekers, targets ^ np.uint64(mask))
    if len(lower):
        for mask in ball(HALF, range(2, 3)):
            look(lower, lower, lower ^ np.uint64(mask << HALF))
    if not found:
        return np.array([], dtype=np.uint64), np.array([], dtype=np.uint64)
    return forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges between different fingerprints; they join exactly what links of two bits or fewer join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        number = lambda c: rows.column(c).to_numpy().astype(np.int64).view(np.uint64)
        a, b = lookups(rows.column("side").to_numpy(), number("key"), number("fp"), rows.column("probe").to_numpy().astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows, spark = index_rows(distinct), distinct.sparkSession
    # a fingerprint gives two entries, and a probe for each bit of its upper segment, half of which are set as a rule
    tasks = max(partitions(spark), -(-distinct.count() * (2 + HALF // 2) // TASK_ROWS))
    return rows.repartition(tasks, "side", "key").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge the smallest node it is joined to.

    Alternating stars: each round hangs neighbours on the smallest of them. Every round is written to the
    shared folder, so a lost executor never brings back earlier rounds.
    """
    now, seen = saved(edges.filter("a <> b").distinct(), "links"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = down.join(low, "a")
        small = pairs.select("a", F.col("m").alias("b")).union(pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = saved(small.distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for every row.

    ``root`` is the smallest fingerprint of the group, ``component_id`` the smallest ``doc_id`` that links reach.
    """
    prints = saved(fingerprints(docs, shingle_words), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "fp", "root", "component_id")


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near-duplicates, whole, with its columns as they were.

    It is the row with the smallest ``doc_id``; of several with that id, the one with the smallest text key,
    and one of rows that agree in both.
    """
    first = near_duplicates(docs, shingle_words).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root").agg(F.first("component_id").alias("doc_id"), F.min("text_key").alias("text_key"))
    rows = rows_by_key(docs).join(kept, keyed_as(kept), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
