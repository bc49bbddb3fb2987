"""Lookups: survey master, prices, stored replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import to_survey_id, with_review, word_count
from rejoinder.plans.skew import first_per_key


def survey_lookup(requests: DataFrame, master: DataFrame) -> DataFrame:
    """Contact, review and rating of each request's survey; null when the survey is unknown.

    The first master row of a survey wins; ``pos`` numbers the master's rows. ``comment_with_review`` is what gets answered.
    """
    # two numbers tell which rows are first; whole rows are only read by the join
    places = master.filter(F.col("survey_id").isNotNull()).groupBy(F.col("survey_id").alias("_id")).agg(F.min("pos").alias("_pos"))
    first = master.join(places, (F.col("survey_id") == F.col("_id")) & (F.col("pos") == F.col("_pos")), "left_semi").select(
        F.col("survey_id").alias("_survey"), "contact", "review_text", "review_rating"
    )
    asked = requests.withColumn("survey_key", to_survey_id(F.col("survey_id")))
    return (
        asked.join(first, F.col("survey_key") == F.col("_survey"), "left")
        .drop("_survey")
        .withColumn("comment_with_review", with_review(F.col("comment"), F.col("review_text")))
    )


def request_cost(
    df: DataFrame, prices: DataFrame, prompt: str, reply: str, model: str = "model", per: int = 1
) -> DataFrame:
    """Words times price for prompt and reply, and their sum; null for an unknown model.

    ``per=1`` takes prices per word; ``per=1000`` takes them per thousand words.
    """
    known = prices.select(F.col("model").alias("_model"), "prompt_price", "completion_price")
    def cost(text, price):
        value = word_count(F.col(text)).cast("decimal(10,0)") * F.col(price)
        return value if per == 1 else value / F.lit(per)

    return (
        df.join(known, F.col(model) == F.col("_model"), "left")
        .withColumn("prompt_cost", cost(prompt, "prompt_price"))
        .withColumn("reply_cost", cost(reply, "completion_price"))
        .withColumn("cost", F.col("prompt_cost") + F.col("reply_cost"))
        .drop("_model", "prompt_price", "completion_price")
    )


def match_revisions(requests: DataFrame, responses: DataFrame, fields: list[str]) -> DataFrame:
    """Each revision request with the stored text it names.

    ``status`` is 200, or 404 with the ``reason`` when there is no such feedback or field. Stored replies
    with their JSON text in ``reply_json`` can be revised in any of their fields, others in the given ``fields``.
    Only replies that are asked for are compared. Feedback ids may be of any type; they are compared as text.
    """
    if "reply_json" in responses.columns:
        by_name = F.map_filter(F.from_json("reply_json", "map<string,string>"), lambda key, _: key != "feedback_id")
    else:
        by_name = F.create_map(*[part for f in fields for part in (F.lit(f), F.col(f))])
    requests = requests.withColumn("_id", F.col("feedback_id").cast("string"))
    asked = requests.select("session_id", "_id").distinct()
    own = responses.withColumn("_id", F.col("feedback_id").cast("string")).join(asked, ["session_id", "_id"], "left_semi")
    stored = first_per_key(own.select("session_id", "_id", "pos", by_name.alias("_texts")), ["session_id", "_id"], ["pos"]).withColumn(
        "_stored", F.lit(True)
    )
    text = F.try_element_at("_texts", F.col("modification_key"))
    return (
        requests.join(stored, ["session_id", "_id"], "left")
        .withColumn("stored_text", text)
        .withColumn(
            "reason",
            F.when(F.col("_stored").isNull(), "no_such_feedback").when(
                F.col("stored_text").isNull(), "no_such_field"
            ),
        )
        .withColumn("status", F.when(F.col("reason").isNotNull(), 404).otherwise(200))
        .drop("_texts", "_stored", "_id")
    )
