"""Plan pieces that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that stay together in a window.
BLOCK_ROWS = 1_000_000


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` for every key; null keys are one key.

    An aggregate, not a window, so every task first cuts a hot key down to one row. The keys
    come back out of the picked row: a join on them shuffles the result once more, and only a
    join with a shuffle on both sides gets its hot keys split at run time.
    """
    picked = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(picked).select("_row.*")


def last_n(array: Column, n: int) -> Column:
    return F.when(F.size(array) <= n, array).otherwise(F.slice(array, -n, n))


def previous_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    payload: Column,
    n: int,
    position: Column,
    name: str = "previous",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name``: the payloads of the ``n`` rows before each row of its key, oldest first.

    Keys must not be null; ``position`` is a whole number that must not decrease with ``order``. A key of more than
    ``block_rows`` rows is cut into blocks of positions, so that its rows go to many tasks; every other key is one block. A
    window runs inside each block, a block of a cut key passes on its last ``n`` payloads, and a small window over
    these turns them into what a block inherits from the ones before it. It is one plan for any data, made without
    looking at them; where no key is cut its second half has no rows.
    """
    rows = df.withColumns({"_payload": payload, "_position": position.cast("double")})
    spans = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_from"), F.max("_position").alias("_to")
    )
    # at most one key for each block_rows rows of the table
    cut = spans.filter(F.col("_rows") > block_rows).select(
        *keys, "_from", ((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_rows") / block_rows)).alias("_width")
    )
    rows = rows.join(F.broadcast(cut), keys, "left").withColumn(
        "_block", F.coalesce(F.floor((F.col("_position") - F.col("_from")) / F.col("_width")), F.lit(0))
    )
    by_block = Window.partitionBy(*keys, "_block")
    own = rows.withColumn("_own", F.collect_list("_payload").over(by_block.orderBy(*order).rowsBetween(-n, -1)))

    newest_first = by_block.orderBy(*[F.desc(c) for c in order])
    ordered = F.array_sort(F.collect_list(F.struct(*order, "_payload")))
    tails = (
        rows.filter("_width is not null")
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= n)
        .groupBy(*keys, "_block")
        .agg(F.transform(ordered, lambda x: x["_payload"]).alias("_tail"))
    )
    # a few rows for each block of a cut key
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-n, -1)
    inherited = tails.select(
        *keys, "_block", last_n(F.flatten(F.collect_list("_tail").over(over_blocks)), n).alias("_inherited")
    )
    both = F.when(F.col("_inherited").isNull(), F.col("_own")).otherwise(
        last_n(F.concat("_inherited", "_own"), n)
    )
    return own.join(inherited, [*keys, "_block"], "left").select(*df.columns, both.alias(name))


def collect_parts(
    df: DataFrame,
    keys: list[str],
    value: str,
    part_rows: int,
    name: str = "items",
) -> DataFrame:
    """Sorted lists of ``value`` per key, in as many parts as needed to keep each list small.

    A key with at most ``part_rows`` values gives one list with ``part`` 0. A larger key is
    spread by hash over ``ceil(rows / part_rows)`` parts; together they hold every value.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    renamed = sizes.filter(F.col("_parts") > 1).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], "_parts"
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    part = F.pmod(F.xxhash64(value), F.coalesce("_parts", F.lit(1))).cast("int")
    return (
        df.join(renamed, same, "left")
        .withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(value)).alias(name))
    )
