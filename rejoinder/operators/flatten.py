"""From nested feedback batches to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import before_and_after

CONTEXT_MARKER = "Context details:"


def flatten_feedback(batches: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per feedback with its place in the batch; surveys stay nested beside it.

    Entries that are no feedback are left out; the others keep their place. ``keep_empty`` keeps batches without entries.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = batches.select(
        "session_id", "Core Prompt", "Context Prompt", explode("Feedback Data").alias("pos", "_f")
    ).filter("_f is not null or pos is null")
    first, last = before_and_after(F.col("Context Prompt"), CONTEXT_MARKER)
    return rows.select(
        "session_id",
        "pos",
        F.col("_f.ID").alias("feedback_id"),
        F.col("_f.Review.Text").alias("review_text"),
        F.col("_f.Customer.Name").alias("customer_name"),
        F.col("_f.Surveys").alias("surveys"),
        F.col("Core Prompt").alias("core_prompt"),
        first.alias("context_first"),
        last.alias("context_last"),
    )


def split_context(df: DataFrame, column: str) -> DataFrame:
    first, last = before_and_after(F.col(column), CONTEXT_MARKER)
    return df.withColumn("context_first", first).withColumn("context_last", last)


def customer_name(name: Column, missing_label: str | None = None) -> Column:
    """The name, or ``missing_label`` where there is none (null by default)."""
    return name if missing_label is None else F.coalesce(name, F.lit(missing_label))


def first_survey(surveys: Column) -> Column:
    """Questions of the first survey as JSON text; null when the feedback has none."""
    return F.try_element_at(surveys, F.lit(1))["Questions"]


def own_surveys(surveys: Column) -> Column:
    """Questions of all surveys of one feedback, in order, as one JSON array; ``[]`` when it has none."""
    entries = F.array_join(F.filter(F.transform(surveys, lambda s: _entries(s["Questions"])), lambda q: q != ""), ",")
    return F.concat(F.lit("["), F.coalesce(entries, F.lit("")), F.lit("]"))


def _entries(questions: Column) -> Column:
    """What is inside a JSON array; any other JSON value is an entry itself."""
    inside = F.trim(F.substring(questions, F.lit(2), F.length(questions) - 2))
    return F.when(questions.startswith("["), inside).otherwise(questions)


def flatten_surveys(batches: DataFrame) -> DataFrame:
    """One row per survey, with its place in the feedback and the feedback's place in the batch."""
    feedback = batches.select("session_id", F.posexplode("Feedback Data").alias("pos", "_f"))
    return feedback.select(
        "session_id",
        "pos",
        F.col("_f.ID").alias("feedback_id"),
        F.posexplode("_f.Surveys").alias("survey_pos", "_s"),
    ).select("session_id", "pos", "feedback_id", "survey_pos", F.col("_s.Questions").alias("questions"))


def pair_by_position(batches: DataFrame) -> DataFrame:
    """The n-th feedback of a batch with the n-th survey of the batch, cut to the shorter list.

    Surveys of all feedback in a batch are put in one list first, so a feedback with none or
    several shifts the pairs after it. Entries that are no feedback are left out first. Worked out inside each batch
    row: nothing is shuffled.
    """
    feedback = F.filter("Feedback Data", lambda f: f.isNotNull())
    surveys = F.flatten(
        F.transform(
            feedback,
            lambda f: F.coalesce(
                F.transform(f["Surveys"], lambda s: s["Questions"]),
                F.array().cast("array<string>"),
            ),
        )
    )
    shorter = F.least(F.size(feedback), F.size("_surveys"))
    pairs = F.arrays_zip(
        F.slice(feedback, F.lit(1), shorter).alias("f"), F.slice("_surveys", F.lit(1), shorter).alias("q")
    )
    return (
        batches.withColumn("_surveys", surveys)
        .select("session_id", F.posexplode(pairs).alias("pos", "_p"))
        .select(
            "session_id",
            "pos",
            F.col("_p").getField("f")["ID"].alias("feedback_id"),
            F.col("_p").getField("f")["Review"]["Text"].alias("review_text"),
            F.col("_p").getField("f")["Customer"]["Name"].alias("customer_name"),
            F.col("_p").getField("q").alias("questions"),
        )
    )


def nonempty(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Drop rows without text; ``strict`` also drops those that hold only blanks."""
    text = F.col(column)
    if strict:
        text = F.regexp_replace(text, r"(?U)^\s+", "")
    return df.filter(F.col(column).isNotNull() & (text != ""))
