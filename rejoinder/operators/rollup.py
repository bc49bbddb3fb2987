"""From the replies of a batch to its overview."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.operators.inference import MakeClient, batch_inference
from rejoinder.operators.prompts import prompt_summary
from rejoinder.plans.session import saved
from rejoinder.plans.skew import collect_parts

PART_ROWS = 1_000
LEVELS = 64


def review_lists(rows: DataFrame, text: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The texts of a batch in order, with their number, cut into parts of at most ``part_rows``.

    ``rows`` has ``session_id`` and ``pos``; a batch up to that size gives one list, part 0.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("text"))))
    return (
        rows.withColumn("part", F.floor(F.col("pos") / part_rows))
        .groupBy("session_id", "part")
        .agg(ordered.alias("_o"), F.count(F.lit(1)).alias("reviews"))
        .select("session_id", "part", F.transform("_o", lambda x: x["text"]).alias("items"), "reviews")
    )


def sentiment_counts(responses: DataFrame, sentiment: str = "Sentiment") -> DataFrame:
    """How often each sentiment occurs in a batch; replies without one are counted under null."""
    return responses.groupBy("session_id", F.col(sentiment).alias("sentiment")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sentiment_overview(responses: DataFrame, sentiment: str = "Sentiment") -> DataFrame:
    """One sentiment per batch: the most frequent, the later name among equals.

    ``conflict`` is set unless there is exactly one distinct sentiment.
    """
    counts = sentiment_counts(responses, sentiment)
    return (
        counts.groupBy("session_id")
        .agg(
            F.count("sentiment").alias("n_sentiments"),
            F.max(F.when(F.col("sentiment").isNotNull(), F.struct("n", "sentiment"))).alias("_top"),
            F.sum("n").alias("reviews"),
        )
        .select(
            "session_id",
            F.col("_top.sentiment").alias("sentiment"),
            "n_sentiments",
            (F.col("n_sentiments") != 1).alias("conflict"),
            "reviews",
        )
    )


def theme_rows(responses: DataFrame) -> DataFrame:
    """Distinct themes of a batch, with how many replies name them. Holds for any number of themes."""
    def tagged(kind: str, column: str) -> Column:
        themes = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(themes), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("theme")))

    both = F.concat(tagged("positive", "Positive_Themes"), tagged("negative", "Negative_Themes"))
    return (
        responses.select("session_id", F.explode(both).alias("_t"))
        .groupBy("session_id", "_t.kind", "_t.theme")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def themes_overview(responses: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Sorted lists of distinct themes per batch, in parts when a batch has very many."""
    lists = collect_parts(theme_rows(responses), ["session_id", "kind"], "theme", part_rows, "themes")
    found = lists.groupBy("session_id", "part").agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.col("themes"))).alias(f"{kind}_themes")
            for kind in ("positive", "negative")
        ]
    )
    empty = F.array().cast("array<string>")
    return (
        responses.select("session_id")
        .distinct()
        .join(found, "session_id", "left")
        .select(
            "session_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("positive_themes", empty).alias("positive_themes"),
            F.coalesce("negative_themes", empty).alias("negative_themes"),
        )
    )


# Ends of sentences, then of words, at which a text is cut.
SENTENCE_END = re.compile(r"[.!?\u3002\uff01\uff1f]+\s+|\n+")
WORD_END = re.compile(r"\s+")


def split_text(text: str, most: int) -> list[str]:
    """A text in pieces of at most ``most`` characters that give it when put together.

    A piece ends at the last end of a sentence that fits, else of a word, else where it is full; so pieces depend on the
    text alone.
    """
    pieces, at = [], 0
    while len(text) - at > most:
        ends = [m.end() for m in SENTENCE_END.finditer(text, at, at + most)] or [m.end() for m in WORD_END.finditer(text, at, at + most)]
        cut = ends[-1] if ends and ends[-1] > at else at + most
        pieces.append(text[at:cut])
        at = cut
    return [*pieces, text[at:]]


def _pieces(level: DataFrame, budget: int) -> DataFrame:
    """Every text in pieces of half the budget, so that any two fit a prompt; ``piece`` numbers them. A text counts once."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, max(1, budget // 2)))

    each = level.withColumn("_p", cut("text")).select(*[c for c in level.columns if c != "text"], F.posexplode("_p").alias("piece", "text"))
    return each.withColumn("reviews", F.when(F.col("piece") == 0, F.col("reviews")).otherwise(F.lit(0)).cast("bigint"))


def _buckets(level: DataFrame, step: int, shrink: bool) -> DataFrame:
    """Neighbouring texts of a block put together: those that begin in the same ``step`` characters of the block's text."""
    before = Window.partitionBy("session_id", "block").orderBy("place", "piece")
    used = F.coalesce(
        F.sum(F.length("text")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    bucket = F.floor(used / step)
    if shrink:
        # at least two texts together, so that every level has fewer rows than the one before
        bucket = F.least(bucket, F.floor((F.row_number().over(before) - 1) / 2))
    return (
        level.withColumn("bucket", bucket)
        .groupBy("session_id", "block", "bucket")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "piece", "text"))).alias("_o"),
            F.sum("reviews").alias("reviews"),
            F.max("failed").alias("failed"),
        )
        .withColumn("items", F.transform("_o", lambda x: x["text"]))
        .drop("_o")
    )


def consolidated_summary(
    replies: DataFrame,
    text: str,
    make_client: MakeClient,
    budget: int = 20_000,
    block_rows: int = PART_ROWS,
    whole_texts: bool = True,
    **calls,
) -> DataFrame:
    """One summary per batch, however large: summaries of summaries.

    Texts are put together by place up to about ``budget`` characters and summed up; the summaries go the same way until each
    batch has one. A text is never cut, so a long one makes a prompt of its own length. With ``whole_texts=False`` a text, or
    a summary, of more than half the budget is first cut at ends of sentences or words, and no prompt ever holds more than
    ``budget`` characters of texts. How they are put together depends on ``pos`` only, not on how Spark splits the
    data. Every level is saved, so no model call is repeated. A model whose summaries are as long as what they sum
    up may never come to one; after ``LEVELS`` levels that is an error.
    """
    step = budget if whole_texts else max(1, budget // 2)
    level = replies.select(
        "session_id",
        F.floor(F.col("pos") / block_rows).alias("block"),
        F.col("pos").cast("bigint").alias("place"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit(1).cast("bigint").alias("reviews"),
        F.lit(False).alias("failed"),
    )
    for number in range(LEVELS):
        cut = level.withColumn("piece", F.lit(0)) if whole_texts else _pieces(level, budget)
        lists = _buckets(cut, step, shrink=number > 0)
        # a text that is a summary already and stands alone is passed on as it is
        alone = F.size("items") == 1 if number else F.lit(False)
        asked = prompt_summary(lists).select(
            "session_id",
            "block",
            "bucket",
            "reviews",
            "failed",
            F.when(alone, F.col("items")[0]).alias("_passed_on"),
            F.when(~alone, F.col("prompt")).alias("prompt"),
        )
        answered = batch_inference(asked, make_client, dedupe=False, **calls)
        level = saved(
            answered.select(
                "session_id",
                "block",
                # in the order of blocks, and of buckets in a block
                (F.col("block") * (1 << 32) + F.col("bucket")).alias("place"),
                F.coalesce("_passed_on", "raw", F.lit("")).alias("text"),
                "reviews",
                (F.col("failed") | F.col("error").isNotNull()).alias("failed"),
            ),
            "summaries",
        )
        most = level.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return level.select("session_id", F.col("text").alias("summary"), "reviews", "failed")
        in_block = level.groupBy("session_id", "block").count().agg(F.max("count")).first()[0]
        level = level.withColumn("block", F.floor(F.col("block") / max(2, block_rows // in_block)))
    raise RuntimeError(f"no single summary after {LEVELS} levels: the summaries do not get shorter")


def overview(responses: DataFrame, summary: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Overview record of each batch. Parts after 0 only hold further themes.

    ``failed`` tells that a call for the summary failed; there is no summary then, not an empty one.
    """
    first = F.col("part") == 0
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in summary.columns else F.lit(False)
    own = summary.select("session_id", "summary", failed.alias("failed"))
    return (
        themes_overview(responses, part_rows)
        .join(sentiment_overview(responses), "session_id", "left")
        .join(own, "session_id", "left")
        .select(
            "session_id",
            "part",
            F.when(first & ~F.coalesce("failed", F.lit(False)), F.col("summary")).alias("Summary"),
            F.when(first, F.col("sentiment")).alias("Sentiment"),
            F.col("positive_themes").alias("Positive_Themes"),
            F.col("negative_themes").alias("Negative_Themes"),
            "conflict",
            "reviews",
            F.coalesce("failed", F.lit(False)).alias("failed"),
        )
    )
