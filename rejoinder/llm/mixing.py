"""Mixing sources to target weights with a temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is found by
bisection: the largest flattening whose repetition stays within a limit, or the one at which the weights reach a
target entropy. Weights times the budget give each source its quota of tokens. A quota is realised as whole
epochs of the source and a part of one more: its rows lie in blocks by a hash, each epoch permutes the blocks and the
rows within, and the last epoch is cut where the quota ends. A block is taken whole, but for one block of each source,
in which the rows up to a cut hash are taken.

Only DataFrame functions are used. Tokens are words between white space, at least one for a row. A source with
a third of the rows is cut into as many blocks as it needs; what is joined are blocks, and a row's fate follows
from its block and its hash, so rows are neither sorted nor grouped by source.

Cases: null is a source of its own; null and empty texts count one token. Rows that agree in id and text have one
hash, so they lie side by side and are taken together. An empty table gives an empty mixture. Other columns pass
through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import text_key
from rejoinder.plans.session import saved

ROWS_PER_BLOCK = 4_096
SEED = 17
# one job halves the bracket so many times
HALVINGS = 5
JOBS = 6
#: exponents looked at: 0 gives all sources equal weight, 1 their natural one, more favours the large ones
LOWEST, HIGHEST = 0.0, 8.0


def source_of(column: str = "source") -> Column:
    """A source's name that also tells null from a text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def token_count(column: str = "text") -> Column:
    words = F.regexp_count(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(r"\S+"))
    return F.greatest(words, F.lit(1)).cast("long")


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_id", "_key")


def keyed(docs: DataFrame) -> DataFrame:
    """(_row, _source, _tokens, _hash): whole rows in one column beside what is computed from them."""
    rows = docs.select(
        F.struct("*").alias("_row"), source_of().alias("_source"), token_count().alias("_tokens"),
        F.col("doc_id").alias("_id"), text_key().alias("_key"),
    )
    return rows.select("_row", "_source", "_tokens", row_hash(SEED).alias("_hash"))


def sources(rows: DataFrame) -> DataFrame:
    """(_source, tokens, rows, share) of every source; one row for each."""
    sizes = rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sizes = saved(sizes, "source-sizes")
    total = sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 1
    return sizes.withColumn("share", F.col("tokens") / F.lit(float(total)))


def measures(sizes: DataFrame, exponents: list[float]) -> list[Row]:
    """For each exponent: sum of powers, entropy of the weights, least and largest weight over share. One job."""
    rows = sizes.select(F.log("share").alias("log"), F.explode(F.lit(exponents)).alias("a"))
    power, ratio = F.exp(F.col("a") * F.col("log")), F.exp((F.col("a") - 1) * F.col("log"))
    z, s = F.sum(power), F.sum(power * F.col("log"))
    each = rows.groupBy("a").agg(
        z.alias("z"), (F.log(z) - F.first("a") * s / z).alias("entropy"), (F.min(ratio) / z).alias("low"), (F.max(ratio) / z).alias("high")
    )
    found = {r["a"]: r for r in each.collect()}
    return [found[a] for a in exponents if a in found]


def bisect(sizes: DataFrame, above: Callable[[Row], bool], low: float, high: float) -> float:
    """Where ``above`` turns from false to true between ``low`` and ``high``, several halvings to a job."""
    for _ in range(JOBS):
        steps = 1 << HALVINGS
        grid = [low + (high - low) * i / steps for i in range(1, steps)]
        found = [above(m) for m in measures(sizes, grid)]
        first = found.index(True) if True in found else len(grid)
        low, high = (grid[first - 1] if first else low), (grid[first] if first < len(grid) else high)
    return high


def exponent(
    sizes: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
) -> float:
    """The exponent for a share of the largest entropy, for a repetition limit, or the larger of both.

    ``target_entropy`` is a share of the entropy of equal weights. ``max_repetition`` is how often a source's tokens
    may be used on average; without a ``budget`` the budget is the smallest that uses every row at least once. A limit that
    even natural weights miss leaves the natural weights.
    """
    n = sizes.count()
    if n < 2:
        return 1.0
    total = float(sizes.agg(F.sum("tokens").alias("n")).first()["n"])
    found = []
    if target_entropy is not None:
        goal = target_entropy * math.log(n)
        found.append(bisect(sizes, lambda m: m["entropy"] <= goal, LOWEST, HIGHEST))
    if max_repetition is not None:
        # weight over share is repetition at a budget of all tokens
        scale = (lambda m: 1 / m["low"]) if budget is None else (lambda m: budget / total)
        found.append(bisect(sizes, lambda m: m["high"] * scale(m) <= max_repetition, LOWEST, 1.0))
    return max(found, default=1.0)


def quotas(sizes: DataFrame, power: float, budget: float | None = None) -> DataFrame:
    """(_source, tokens, rows, weight, epochs, rest, blocks): whole epochs of each source and the tokens of one more."""
    found = measures(sizes, [power])
    total = float(sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    m = found[0] if found else {"z": 1.0, "low": 1.0}  # without sources
    least = total / m["low"]
    spent = least if budget is None else budget
    weight = F.exp(F.lit(power) * F.log("share")) / F.lit(m["z"])
    # to the token, so that a source used exactly once is not cut by rounding
    quota = F.round(weight * F.lit(spent)).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("quota", quota)
    return rows.select(
        "_source", "tokens", "rows", "weight",
        F.floor(F.col("quota") / F.col("tokens")).alias("epochs"),
        F.expr("quota % tokens").alias("rest"),
        F.ceil(F.col("rows") / F.lit(ROWS_PER_BLOCK)).alias("blocks"),
    )


def block_fates(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, block, fate, cut): in the last, partial epoch a block is taken whole, not at all, or up to a hash."""
    order = F.xxhash64(F.lit(SEED), "source", "block", "epochs")
    totals = placed.groupBy("source", "block").agg(F.sum("_tokens").alias("n"))
    names = plan.select(F.col("_source").alias("_s"), "rest", "epochs")
    totals = totals.join(names, F.col("source") == F.col("_s"))
    before = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    ran = totals.withColumn("left", F.col("rest") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    fate = F.when(F.col("left") >= F.col("n"), "whole").when(F.col("left") > 0, "part").otherwise("none")
    return saved(ran.select("source", "block", "n", "left", fate.alias("fate")), "block-fates")


def cuts(placed: DataFrame, fates: DataFrame) -> DataFrame:
    """(_source, _block, cut): the largest hash taken in the one partial block of a source."""
    part = fates.filter("fate = 'part'").select("source", "block", "left")
    rows = placed.select("source", "block", "_tokens", "_hash").join(part, ["source", "block"])
    same = rows.groupBy("source", "block", "_hash").agg(F.sum("_tokens").alias("n"), F.first("left").alias("left"))
    upto = Window.partitionBy("source", "block").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    taken = same.withColumn("ran", F.sum("n").over(upto)).filter("ran <= left")
    return taken.groupBy(F.col("source").alias("_source2"), F.col("block").alias("_block2")).agg(F.max("_hash").alias("cut"))


def mixture(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
) -> DataFrame:
    """(_row, source, tokens, exponent, weight, epoch, block, place): a row for every use of a document.

    Sorted by ``epoch``, ``place`` (of the block in the epoch's permutation) and ``row_place``, the rows are the mixture in
    order.
    """
    rows = keyed(docs)
    sizes = sources(rows)
    power = exponent(sizes, target_entropy, max_repetition, budget)
    plan = saved(quotas(sizes, power, budget), "quotas")
    by_source = plan.select(F.col("_source").alias("source"), "weight", "epochs", "blocks")
    placed = rows.join(by_source, F.col("_source") == F.col("source")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(SEED + 1), "_hash"), F.col("blocks"))
    )
    fates = block_fates(placed, plan)
    cut = saved(cuts(placed, fates), "cuts")
    whole = fates.filter("fate <> 'none'").select(F.col("source").alias("_source3"), F.col("block").alias("_block3"), "fate")
    fate = whole.join(cut, (F.col("_source3") == F.col("_source2")) & (F.col("_block3") == F.col("_block2")), "left")
    found = placed.join(fate, (F.col("source") == F.col("_source3")) & (F.col("block") == F.col("_block3")), "left")
    once_more = (F.col("fate") == "whole") | (F.col("_hash") <= F.col("cut"))
    uses = F.col("epochs") + F.when(once_more, 1).otherwise(0)
    used = found.filter(uses > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
    return used.select(
        "_row", F.col("_tokens").alias("tokens"), F.lit(power).alias("exponent"), "weight", "epoch", "block",
        F.xxhash64(F.lit(SEED), "source", "block", "epoch").alias("place"), F.xxhash64("_hash", "epoch").alias("row_place"),
    )


def mixed(docs: DataFrame, **options: float | None) -> DataFrame:
    """The rows of the mixture with their columns as they were; a row used twice comes twice."""
    return mixture(docs, **options).select("_row.*")
