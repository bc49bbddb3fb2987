"""Theme labels of comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.inference import MakeClient, batch_inference
from rejoinder.operators.parse import parse_replies
from rejoinder.operators.prompts import prompt_themes
from rejoinder.plans.session import saved
from rejoinder.schemas import THEME_REPLY


def label_rows(df: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """One row per distinct label of a row's label list."""
    return df.select(*keys, F.explode(F.array_distinct(labels)).alias("theme"))


def allowed_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    known = taxonomy.select("theme").distinct()
    return labels.join(known, "theme", "left_semi").select(*labels.columns)


def rejected_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    known = taxonomy.select("theme").distinct()
    return labels.join(known, "theme", "left_anti").select(*labels.columns)


def check_labels(df: DataFrame, labels: str, taxonomy: DataFrame) -> DataFrame:
    """Split a label list in those of the taxonomy and ``rejected`` ones, both sorted.

    Reads ``df`` once: its other columns go through the aggregate beside the labels, so what made them
    (a model, say) never runs a second time. Rows need no key of their own.
    """
    known = taxonomy.select(F.col("theme").alias("_known")).filter("_known is not null").distinct()
    whole = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*df.columns).alias("_whole"))
    rows = whole.select("_row", "_whole", F.explode_outer(F.array_distinct(F.col(f"_whole.{labels}"))).alias("_label")).join(
        known, F.col("_label") == F.col("_known"), "left"
    )
    lists = rows.groupBy("_row").agg(
        F.first("_whole").alias("_whole"),
        F.sort_array(F.collect_set("_known")).alias("_kept"),
        F.sort_array(F.collect_set(F.when(F.col("_known").isNull(), F.col("_label")))).alias("rejected"),
    )
    return lists.select(*[F.col("_kept").alias(c) if c == labels else F.col(f"_whole.{c}").alias(c) for c in df.columns], "rejected")


def classify(
    comments: DataFrame, key: str, comment: str, taxonomy: DataFrame, classes: Column, make_client: MakeClient, **calls
) -> DataFrame:
    """Themes and sentiment of each comment by a model; labels outside the taxonomy are set apart."""
    asked = prompt_themes(comments.select(key, comment), classes, comment).drop(comment)
    parsed = parse_replies(batch_inference(asked, make_client, **calls), THEME_REPLY)
    return check_labels(
        parsed.select(key, "themes_category", "sentiment", "parse_ok", "error"),
        "themes_category",
        taxonomy,
    )


def tag_by_keyword(comments: DataFrame, key: str, comment: str, keywords: DataFrame) -> DataFrame:
    """Themes whose keyword is one of the comment's words, without a model.

    Only words that are keywords reach the shuffle, and each task first joins the themes of a
    comment into one set.
    """
    words = comments.select(
        key, F.explode(F.array_distinct(F.split(comment, r"\s+"))).alias("keyword")
    )
    known = keywords.select("keyword", "theme").distinct()
    tags = words.join(known, "keyword").groupBy(key).agg(F.sort_array(F.collect_set("theme")).alias("themes"))
    return comments.select(key).join(tags, key, "left").select(
        key, F.coalesce("themes", F.array().cast("array<string>")).alias("themes")
    )


# A word is a run of letters and digits; everything else only parts words.
WORD = r"[\p{L}\p{N}]+"
# Up to so many first words of phrases are held against each word in place; with more, all runs go to the join.
MOST_FIRST_WORDS = 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tag_by_phrase(comments: DataFrame, key: str, comment: str, phrases: DataFrame) -> DataFrame:
    """Themes of which a phrase stands in the comment, word by word, without a model.

    ``phrases`` has ``theme`` and ``phrase``, of one or more words. Case and the marks between words do not matter, so
    "late delivery" is found in "Late  delivery," and "late-delivery". A comment gives its distinct runs of words, of the lengths that
    phrases have and that begin as one of them does, to a join by the whole run: only runs that are phrases go on. The phrases
    are saved first, so that Spark knows their size and few of them never make it shuffle the runs. Rows need no key of their own.
    """
    known = saved(
        phrases.select("theme", words_of(F.col("phrase")).alias("_words"))
        .filter(F.size("_words") > 0)
        .select("theme", F.array_join("_words", " ").alias("_run"), F.get("_words", F.lit(0)).alias("_first"), F.size("_words").alias("_size"))
        .distinct(),
        "phrases",
    )
    lengths = sorted(r[0] for r in known.select("_size").distinct().collect())  # a few small numbers
    firsts = known.select("_size", "_first").distinct().limit(MOST_FIRST_WORDS + 1).collect()
    rows = comments.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.coalesce(words_of(F.col(comment)), F.array().cast("array<string>")).alias("_words"))

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("_words") - n)
        if len(firsts) <= MOST_FIRST_WORDS:
            own = [r["_first"] for r in firsts if r["_size"] == n]
            starts = F.filter(starts, lambda i: F.get("_words", i).isin(own))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("_words", i + k) for k in range(n)]))

    none = F.array().cast("array<string>")
    # the null stands for the comment itself, which stays without any phrase
    found = F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), *[F.when(F.size("_words") >= n, runs_of(n)).otherwise(none) for n in lengths]))
    each = rows.select("_row", F.col(key), F.explode(found).alias("_run"))
    tagged = each.join(known.select("theme", "_run").distinct(), "_run", "left").filter("theme is not null or _run is null")
    return tagged.groupBy("_row").agg(F.first(key, ignorenulls=True).alias(key), F.sort_array(F.collect_set("theme")).alias("themes")).drop("_row")
