"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

What is packed are groups of equal texts. Groups with a notable share of all bytes, tokens or rows are packed one by one;
there can only be few of them, however large the table is. One that no shard can hold is dealt out row by row
into parts of ``SPLIT`` of a shard. All other groups fall by hash into ``UNITS_PER_SHARD`` units for each shard, so the list to be
packed has a fixed length. Each item, the largest first, goes to the shard where the dot product of its size with the
shard's residual capacity is highest. At the end single items change places until the bytes are level.

The law that holds is ``bytes``: sizes of the shards are near equal (rows and tokens nearly so where groups allow it).

Cases: a null text has no bytes and size 1, as an empty one has. Rows of any ids are rows of their own, repeated and
null ids too; a group of them is dealt out by row and not by id. A very long text is an item like any other; one longer than a
shard's share makes its shard the largest. Groups of equal size are packed in order of their hash. With fewer groups than shards
some shards stay empty. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.plans.session import saved

SHARDS = 16
UNITS_PER_SHARD = 256
# of a shard's capacity: groups above the first are packed one by one; those that no shard can hold in parts of the second
NOTABLE, SPLIT = 1 / 64, 1 / 4
# bytes decide; rows and tokens weigh less, so that the law holds
WEIGHTS = np.array([4.0, 1.0, 1.0])
ROWS_PER_BLOCK = 20_000
LEAST_BLOCKS = 8
SEED = 23
DIMENSIONS = ("size", "tokens", "ones")
KEY = ("_hash", "text_crc32", "size")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, ones, text_crc32, _hash): a row's sizes, and what equal texts agree in."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("ones"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("_hash"),
    )


def pack(items: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each item, a row of sizes; the largest items first, ties in the order given."""
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    sizes = items / capacity
    weighed = sizes * WEIGHTS
    residual = np.ones((shards, items.shape[1]))
    chosen = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-weighed.sum(axis=1), kind="stable"):
        chosen[i] = np.argmax(residual @ weighed[i])
        residual[chosen[i]] -= sizes[i]
    return chosen


def levelled(items: np.ndarray, chosen: np.ndarray, shards: int, near: float = 1e-4, most: int = 20_000) -> np.ndarray:
    """The packing with its bytes evened out: between the fullest and the emptiest shard the item, or the pair of items, that
    leaves them closest goes over, as long as that helps and they differ by more than ``near`` of a shard."""
    chosen, sizes = chosen.copy(), items[:, 0]
    held = np.bincount(chosen, weights=sizes, minlength=shards)
    for _ in range(most):
        full, empty = int(held.argmax()), int(held.argmin())
        gap = held[full] - held[empty]
        if gap <= near * max(1.0, held.mean()):
            break
        own, other = np.flatnonzero(chosen == full), np.flatnonzero(chosen == empty)
        # nothing in return counts as an item without size
        back = np.concatenate([[0.0], sizes[other]])
        order = np.argsort(back, kind="stable")
        at = np.searchsorted(back[order], sizes[own] - gap / 2)
        pairs = [(abs(sizes[own] - back[order[k]] - gap / 2), k) for k in (np.maximum(at - 1, 0), np.minimum(at, len(back) - 1))]
        off, k = min(pairs, key=lambda p: p[0].min())
        i = int(off.argmin())
        if off[i] >= gap / 2:  # the gap would be no smaller
            break
        give, take = own[i], order[k[i]] - 1
        chosen[give] = empty
        if take >= 0:
            chosen[other[take]] = full
        held = np.bincount(chosen, weights=sizes, minlength=shards)
    return chosen


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): slots of a shard count from 0 without gaps."""
    spark, units = docs.sparkSession, UNITS_PER_SHARD * shards
    rows = saved(measured(docs).withColumn("_n", F.monotonically_increasing_id()), "sizes")
    totals = rows.agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).first()
    total = {c: float(totals[c] or 0) for c in DIMENSIONS}
    groups = rows.groupBy(*KEY).agg(*[F.sum(c).alias(f"_{c}") for c in DIMENSIONS])
    share = F.greatest(*[F.col(f"_{c}") / F.lit(max(total[c], 1.0) / shards) for c in DIMENSIONS])
    # at most three times shards / NOTABLE groups
    notable = groups.withColumn("share", share).filter(F.col("share") >= NOTABLE).orderBy(F.desc("share"), *KEY).collect()
    placed, first = [], units
    for g in notable:
        parts = 1 if g["share"] <= 1 else int(np.ceil(g["share"] / SPLIT))
        placed.append((*(g[k] for k in KEY), first, parts))
        first += parts
    big = spark.createDataFrame(placed, "_h bigint, _c bigint, _s bigint, _first bigint, _parts int")
    own = (F.col("_hash") == F.col("_h")) & (F.col("text_crc32") == F.col("_c")) & (F.col("size") == F.col("_s"))
    marked = rows.join(F.broadcast(big), own, "left")
    torn = numbered_by(marked.filter("_parts > 1"), ["_first"], int(total["ones"]) // ROWS_PER_BLOCK + LEAST_BLOCKS, "_nth")
    unit = F.coalesce(F.col("_first") + F.pmod("_nth", "_parts"), F.pmod("_hash", F.lit(units)))
    whole = marked.filter("_parts is null or _parts = 1").withColumn("_nth", F.lit(0).cast("long"))
    in_units = torn.unionByName(whole).withColumn("_unit", unit).drop("_h", "_c", "_s", "_first", "_parts", "_nth")
    # at most the units and the parts of the notable groups
    items = in_units.groupBy("_unit").agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).orderBy("_unit").collect()
    sizes = np.array([[float(i[c]) for c in DIMENSIONS] for i in items]).reshape(-1, len(DIMENSIONS))
    chosen = levelled(sizes, pack(sizes, shards), shards)
    where = spark.createDataFrame([(i["_unit"], int(s)) for i, s in zip(items, chosen)], "_u bigint, shard int")
    found = in_units.join(F.broadcast(where), F.col("_unit") == F.col("_u"))
    blocks = max(LEAST_BLOCKS, -(-int(total["ones"]) // (shards * ROWS_PER_BLOCK)))
    return numbered_by(found, ["shard"], blocks, "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def numbered_by(rows: DataFrame, keys: list[str], blocks: int, name: str) -> DataFrame:
    """Number the rows of each key from 0. Rows are cut into blocks, so no task has to sort all rows of a key."""
    cut = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(SEED + 1), "_n"), F.lit(blocks)))
    sizes = saved(cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("n")), "block-sizes")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    starts = sizes.select(*named, F.col("_block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("doc_id", "text_crc32", "_n"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    numbered = cut.withColumn("_row", nth).join(starts, same)
    return numbered.withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_block", "_b", "_start", "_row", *[f"_k{i}" for i in range(len(keys))])
