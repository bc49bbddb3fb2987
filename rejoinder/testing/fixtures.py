"""Inputs of the registered queries, derived by Spark from the given tables.

Every function takes ``t``, which gives a table by name. ``oracles.py`` states the same
derivations in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rejoinder.testing.stand_in import StandIn
from rejoinder.operators.flatten import flatten_feedback
from rejoinder.sources.batches import parse_batches

Tables = Callable[[str], DataFrame]

# Documents of one source with ids in the same block of this size form a batch.
BATCH_IDS = 100

THEMES = ["the", "die", "les", "que", "with", "this", "Never used"]
KEYWORDS = [("Warranty", "the"), ("Design", "with"), ("Lender", "die"), ("Design", "this"), ("Sales", "les")]
# phrases of the themes, with marks and capitals as a list of themes has them
PHRASES = [
    ("Warranty", "Of the"), ("Warranty", "the, and"), ("Design", "to the"), ("Lender", "in"), ("Sales", "de la"), ("Late delivery", "que de"),
    ("Service", "der und"), ("Service", "is-the"), ("Never used", "no such run of words"),
]
MODEL_PRICES = [("small-instruct", "0.00015", "0.0002"), ("large-instruct", "0.008", "0.024")]


def tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def chat_log(events: DataFrame) -> DataFrame:
    """Request log from events, batch or stream.

    'error' rows carry a bad token value, some rows have no session, and the rows of hour 5 are
    moved an hour on, so that there are empty hours to fill.
    """
    ts = F.col("ts").cast("timestamp")
    k = F.regexp_extract("props", "[0-9]+", 0)
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 97 != 0, F.col("user_id").cast("string")).alias("session_id"),
        F.concat("event_type", F.lit("\n"), "props").alias("user_feedback"),
        F.when(F.col("event_id") % 3 == 0, "shorter").otherwise("").alias("modification_needed"),
        F.lit("").alias("history"),
        F.concat(F.lit("reply "), (F.col("event_id") % 5).cast("string"), F.lit("\ntail")).alias("model_response"),
        F.when(F.hour(ts) == 5, ts + F.expr("interval 1 hour")).otherwise(ts).alias("timestamp"),
        F.col("value").alias("latency"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(k).alias("tokens_raw"),
        ((F.col("event_id") % 1000).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(5,4)"))
        .cast("decimal(18,8)")
        .alias("cost"),
    )


def messages(conversations: DataFrame) -> DataFrame:
    """Chat turns without the system line; batch or stream."""
    return conversations.filter("role <> 'system'").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), "role", "text"
    )


def _batch_key() -> Column:
    block = F.floor(F.col("doc_id") / BATCH_IDS).cast("string")
    return F.concat("source", F.lit("-"), block)


def feedback(t: Tables) -> DataFrame:
    """Flat truth of the nested batches: review, customer (every 7th missing), survey scores."""
    return (
        t("documents")
        .join(
            t("customer").select(F.col("c_custkey").alias("doc_id"), "c_name"), "doc_id", "left"
        )
        .join(t("labels"), "doc_id", "left")
        .select(
            _batch_key().alias("session_id"),
            F.col("doc_id").alias("feedback_id"),
            F.floor(F.col("doc_id") / BATCH_IDS).alias("block"),
            F.col("text").alias("review_text"),
            "lang",
            "n_chars",
            F.when(F.col("doc_id") % 7 != 0, F.col("c_name")).alias("customer_name"),
            F.when(F.col("quality").isNull(), 0)
            .when(F.col("doc_id") % 5 == 0, 2)
            .otherwise(1)
            .alias("n_surveys"),
            "quality",
            "toxic",
        )
    )


def _question(q=None, score=None, question=None, answer=None, rating=None) -> Column:
    """Two shapes of a question; JSON leaves out what is null."""
    return F.struct(
        F.lit(q).cast("string").alias("q"),
        (F.col(score) if score else F.lit(None)).cast("int").alias("score"),
        F.lit(question).cast("string").alias("Question"),
        (F.col(answer) if answer else F.lit(None)).cast("string").alias("Answer"),
        F.lit(rating).cast("double").alias("Rating"),
    )


def batches_json(t: Tables) -> DataFrame:
    """One JSON text per batch. A batch holds at most ``BATCH_IDS`` documents."""
    first = F.struct(F.array(_question("quality", "quality"), _question("toxic", "toxic")).alias("Questions"))
    second = F.struct(F.array(_question(question="recommend", answer="lang", rating=4.5)).alias("Questions"))
    none = F.when(F.col("feedback_id") % 2 == 0, F.slice(F.array(first), 1, 0))
    surveys = (
        F.when(F.col("n_surveys") == 2, F.array(first, second))
        .when(F.col("n_surveys") == 1, F.array(first))
        .otherwise(none)
    )
    one = F.struct(
        F.col("feedback_id").alias("ID"),
        F.struct(F.col("review_text").alias("Text")).alias("Review"),
        F.struct(F.col("customer_name").alias("Name")).alias("Customer"),
        surveys.alias("Surveys"),
    )
    context = (
        F.when(F.col("block") % 3 == 0, F.concat(F.lit("Shop rules. Context details: block "), F.col("block").cast("string")))
        .when(F.col("block") % 3 == 1, "No marker here")
        .otherwise("a Context details: b Context details: c")
    )
    grouped = (
        feedback(t).groupBy("session_id", "block").agg(F.array_sort(F.collect_list(one)).alias("Feedback Data"))
    )
    return grouped.select(
        "session_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("Be kind to "), "session_id").alias("Core Prompt"),
                context.alias("Context Prompt"),
                "Feedback Data",
            )
        ).alias("batch"),
    )


def batches(t: Tables) -> DataFrame:
    return parse_batches(batches_json(t), "batch", id_type="bigint")


def damaged_batches(t: Tables) -> DataFrame:
    """The batches as texts of which some are damaged: cut in half, or with a text behind them; and some of their entries:
    plain text for a review, an entry that is a text, no id, an id that is a text."""
    key = F.col("feedback_id") % 10
    name = F.concat(F.lit("F-"), F.col("feedback_id").cast("string"))
    review = F.struct(F.col("lang").alias("Text"))
    entry = (
        F.when(key == 3, F.to_json(F.struct(F.col("feedback_id").alias("ID"), F.lit("plain text").alias("Review"))))
        .when(key == 5, F.lit('"lost"'))
        .when(key == 6, F.to_json(F.struct(review.alias("Review"))))
        .when(key == 4, F.to_json(F.struct(name.alias("ID"), review.alias("Review"))))
        .otherwise(F.to_json(F.struct(F.col("feedback_id").alias("ID"), review.alias("Review"))))
    )
    ordered = F.array_sort(F.collect_list(F.struct("feedback_id", entry.alias("e"))))  # at most BATCH_IDS entries
    whole = (
        feedback(t)
        .groupBy("session_id", "block")
        .agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ",").alias("entries"))
        .select("block", F.concat(F.lit('{"Core Prompt":"'), "session_id", F.lit('","Feedback Data":['), "entries", F.lit("]}")).alias("text"))
    )
    half = F.substring(F.col("text"), F.lit(1), (F.length("text") / 2).cast("int"))
    damaged = F.when(F.col("block") % 4 == 1, half).when(F.col("block") % 4 == 2, F.concat("text", F.lit(' {"more":1}')))
    return whole.select(damaged.otherwise(F.col("text")).alias("value"))


def feedback_rows(t: Tables) -> DataFrame:
    return flatten_feedback(batches(t))


def survey_master(t: Tables) -> DataFrame:
    """Every 10th survey is there twice; its second row must lose."""
    rows = feedback(t).select(
        F.col("feedback_id").alias("survey_id"),
        F.col("customer_name").alias("contact"),
        "review_text",
        (1 + 4 * F.col("quality") - F.col("toxic")).alias("review_rating"),
        F.col("feedback_id").alias("pos"),
    )
    second = rows.filter("survey_id % 10 = 0").select(
        "survey_id",
        F.lit("SECOND").alias("contact"),
        F.lit("second").alias("review_text"),
        F.lit(0).alias("review_rating"),
        (F.col("pos") + 1_000_000_000).alias("pos"),
    )
    return rows.unionByName(second)


def survey_requests(t: Tables) -> DataFrame:
    """Write requests: some ids are not numbers, some are unknown."""
    doc = F.col("doc_id")
    return t("documents").select(
        "doc_id",
        F.when(doc % 11 == 0, F.concat(F.lit("x"), doc.cast("string")))
        .when(doc % 7 == 0, (doc + 1_000_000_000).cast("string"))
        .otherwise(doc.cast("string"))
        .alias("survey_id"),
        F.col("text").alias("comment"),
    )


def responses(t: Tables) -> DataFrame:
    """Stored replies of every feedback; those without a survey have no sentiment and no themes."""
    name = F.coalesce("customer_name", F.lit("customer"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    in_batch = Window.partitionBy("session_id").orderBy("feedback_id")  # at most BATCH_IDS rows
    none = F.array().cast("array<string>")
    return feedback(t).select(
        "session_id",
        (F.row_number().over(in_batch) - 1).cast("bigint").alias("pos"),
        "feedback_id",
        F.concat(
            F.lit("Dear "), name, F.lit(", thank you for "), F.col("n_chars").cast("string"), F.lit(" characters")
        ).alias("Default"),
        F.concat(F.lit("Hi "), name).alias("More_friendly"),
        F.concat(F.lit("To "), name).alias("More_Professional"),
        F.lit("Thanks").alias("More_Concise"),
        F.concat(F.lit("In "), "lang").alias("Summary"),
        F.when(good, "promoter").when(~good, "non-promoter").alias("Sentiment"),
        F.when(good, F.array("lang")).when(~good, none).alias("Positive_Themes"),
        F.when(good, none).when(~good, F.array("lang", F.lit("survey"))).alias("Negative_Themes"),
    )


def revision_requests(t: Tables) -> DataFrame:
    """Four requests per toxic document: two in a row, an unknown feedback, an unknown field."""
    asks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(change).alias("change"), F.lit(key).alias("key"), F.lit(off).alias("off"))
            for i, (change, key, off) in enumerate(
                [
                    ("softer", "Default", 0),
                    ("shorter", "Default", 0),
                    ("softer", "Default", 1_000_000_000),
                    ("softer", "No_such_field", 0),
                ]
            )
        ]
    )
    return (
        feedback(t)
        .filter("toxic = 1")
        .select("session_id", "feedback_id", F.explode(asks).alias("_a"))
        .select(
            (F.col("feedback_id") * 4 + F.col("_a.i")).alias("request_id"),
            "session_id",
            (F.col("feedback_id") + F.col("_a.off")).alias("feedback_id"),
            F.col("_a.change").alias("modifications"),
            F.col("_a.key").alias("modification_key"),
        )
    )


def delta_events(documents: DataFrame) -> DataFrame:
    """Every document cut after each space into delta events; batch or stream.

    In between come a start event, an event of a type to ignore and one without payload.
    """
    # JSON escapes character by character and never a space, so a text is escaped whole and then cut
    escaped = F.to_json(F.struct("text"))
    inside = F.substring(escaped, F.lit(len('{"text":"') + 1), F.length(escaped) - len('{"text":""}'))
    pieces = F.split(F.when(F.col("text").isNotNull(), inside), "(?<= )")
    payloads = F.concat(
        F.array(F.lit('{"type":"message_start"}'), F.lit(None).cast("string"), F.lit('{"type":"ping"}')),
        F.transform(pieces, lambda piece: F.concat(F.lit('{"type":"content_block_delta","delta":{"text":"'), piece, F.lit('"}}'))),
        F.array(F.lit('{"type":"message_stop"}')),
    )
    return documents.select(F.col("doc_id").alias("message_id"), F.posexplode(payloads).alias("seq", "payload")).select(
        "message_id", F.col("seq").cast("bigint").alias("seq"), "payload"
    )


def _constants(spark: SparkSession, names: list[str], rows: Sequence[tuple]) -> DataFrame:
    """A small table of literals that never leaves the JVM."""
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def prices(spark: SparkSession) -> DataFrame:
    """Two known models; a third one that requests name is left out on purpose."""
    return _constants(spark, ["model", "p", "c"], MODEL_PRICES).select(
        "model",
        F.col("p").cast("decimal(18,8)").alias("prompt_price"),
        F.col("c").cast("decimal(18,8)").alias("completion_price"),
    )


def model_of(key: Column) -> Column:
    return (
        F.when(key % 3 == 0, "small-instruct").when(key % 3 == 1, "large-instruct").otherwise("no-such-model")
    )


def taxonomy(spark: SparkSession) -> DataFrame:
    return _constants(spark, ["theme"], [(x,) for x in THEMES])


def keywords(spark: SparkSession) -> DataFrame:
    return _constants(spark, ["theme", "keyword"], KEYWORDS)


def phrases(spark: SparkSession) -> DataFrame:
    return _constants(spark, ["theme", "phrase"], PHRASES)


def catalog_json(t: Tables) -> DataFrame:
    """Price catalogues from parts, one JSON text per 100 part keys; the key picks the section."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("model-"), key.cast("string"))
    price = (F.col("p_retailprice") / 1000).cast("decimal(18,8)")

    def section(number, value):
        pair = F.struct(name.alias("key"), value.alias("value"))
        return F.map_from_entries(F.collect_list(F.when(key % 4 == number, pair)))

    def one(k, value):
        return F.create_map(k, value)

    chat = F.struct(price.alias("promptPrice"), (price * 2).cast("decimal(18,8)").alias("completionPrice"))
    grouped = t("part").groupBy(F.floor(key / 100).alias("block")).agg(
        section(0, price).alias("embeddings"),
        section(1, one(F.col("p_brand"), one(F.col("p_size").cast("string"), price))).alias("images"),
        section(2, price).alias("audio"),
        section(3, chat).alias("chat"),
    )
    return grouped.select(F.to_json(F.struct("embeddings", "images", "audio", "chat")).alias("catalog"))


def taxonomy_text(t: Tables) -> DataFrame:
    """Comma-separated part types per brand and block of 100 part keys, with loose blanks."""
    return (
        t("part")
        .groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("block"))
        .agg(F.array_join(F.sort_array(F.collect_list("p_type")), " ,\n  ").alias("_j"))
        .select("p_brand", "block", F.concat(F.lit("  "), "_j", F.lit(", ,")).alias("themes"))
    )


class Faulty(StandIn):
    """Stand-in that always fails on direct prompts whose feedback has a word count divisible by 17."""

    def generate(self, prompts: Sequence[str]) -> list[str]:
        out = super().generate(prompts)
        for reply in out:
            words = reply.split()[3]
            if int(words) % 17 == 0:
                raise ValueError("no reply for this text")
        return out


def faulty() -> StandIn:
    return Faulty()
