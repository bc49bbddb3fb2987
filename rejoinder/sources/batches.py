"""Feedback batches: nested JSON documents, one row per batch.

The text of a batch stays beside its fields, and nothing of it is lost: a text that is no batch is a rejected batch, an
entry that is no feedback a rejected entry, each with a reason. Entries keep their place in the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.functions.text import random_run_id
from rejoinder.schemas import FEEDBACK, FEEDBACK_BATCH

ENTRIES = "Feedback Data"


def read_batches(spark: SparkSession, path: str, one_per_file: bool = True, id_type: str = "string") -> DataFrame:
    """Read batch files: ``session_id``, ``file``, ``batch`` (the text as it is) and the batch's fields.

    ``one_per_file=False`` reads JSON lines, which splits inside large files. The id is random,
    so save the result before using it twice. Texts that are no batch have no fields; see :func:`batch_rejects`.
    """
    texts = spark.read.text(path, wholetext=one_per_file).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("batch"))
    if not one_per_file:
        texts = texts.filter(F.trim("batch") != "")
    return parse_batches(texts.withColumn("session_id", random_run_id()), "batch", id_type, keep=True)


def _is_one_value(text: Column) -> Column:
    """Whether the text is one JSON value with nothing behind it.

    A JSON reader stops where its value ends. Inside a list a value may be followed by a closing bracket or a comma
    only, inside an object by a closing brace or another key; what passes both has nothing behind it.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(T.StringType()))
    inside = F.from_json(F.concat(F.lit('{"b":'), text, F.lit("}")), "b string, _corrupt_record string")
    return F.coalesce((F.size(listed) == 1) & listed[0].isNotNull() & inside["_corrupt_record"].isNull() & inside["b"].isNotNull(), F.lit(False))


def _entry_reason(entry: Column) -> Column:
    """Why an entry, a variant, is no feedback; null if it is one."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(entry, path, "variant"))
    nested = lambda k: k.startswith("OBJECT") | k.startswith("ARRAY")
    whole, feedback_id, review, text, surveys = (kind(p) for p in ("$", "$.ID", "$.Review", "$.Review.Text", "$.Surveys"))
    return (
        F.when(entry.isNull() | ~whole.startswith("OBJECT"), "not_an_object")
        .when(feedback_id.isNull() | (feedback_id == "VOID") | nested(feedback_id), "no_id")
        .when(review.isNull() | ~review.startswith("OBJECT"), "review_is_no_object")
        .when(text.isNull() | nested(text), "no_text")
        .when(surveys.isNotNull() & (surveys != "VOID") & ~surveys.startswith("ARRAY"), "surveys_are_no_list")
    )


def _entries(text: Column) -> Column:
    """The entries of a batch in order, each as its JSON text and with the reason why it is no feedback."""
    texts = F.from_json(text, T.StructType([T.StructField(ENTRIES, T.ArrayType(T.StringType()))]))[ENTRIES]
    values = F.from_json(text, T.StructType([T.StructField(ENTRIES, T.ArrayType(T.VariantType()))]))[ENTRIES]
    return F.zip_with(texts, values, lambda t, v: F.struct(t.alias("text"), _entry_reason(v).alias("reason")))


def _feedback(entry: Column, id_type: str) -> Column:
    one = F.from_json(entry, FEEDBACK)
    return F.struct(one["ID"].try_cast(id_type).alias("ID"), *[one[f.name].alias(f.name) for f in FEEDBACK.fields if f.name != "ID"])


def batch_reason(text: Column) -> Column:
    """Why a text is no batch; null if it is one."""
    listed = F.from_json(text, T.StructType([T.StructField(ENTRIES, T.ArrayType(T.StringType()))]))[ENTRIES]
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    return F.when(blank, "empty").when(~_is_one_value(text), "broken_json").when(listed.isNull(), "no_feedback_list")


def parse_batches(df: DataFrame, column: str, id_type: str = "string", keep: bool = False) -> DataFrame:
    """Replace a JSON text column by the batch fields, or with ``keep`` put them beside it.

    An entry that is no feedback is null at its place; see :func:`entry_rejects`. Feedback ids are kept as the text they
    have in JSON; ``id_type`` names another type they are wanted in, ids that are none of that type become null. A text that is
    no batch has no fields.
    """
    good = F.when(batch_reason(F.col(column)).isNull(), F.col(column))
    heads = T.StructType([f for f in FEEDBACK_BATCH.fields if f.name != ENTRIES])
    feedback = F.transform("_e", lambda e: F.when(e["reason"].isNull(), _feedback(e["text"], id_type)))
    others = [c for c in df.columns if keep or c != column]
    return (
        df.withColumn("_good", good)
        .withColumns({"_b": F.from_json("_good", heads), "_e": _entries(F.col("_good"))})
        .select(*others, "_b.*", feedback.alias(ENTRIES))
    )


def batch_rejects(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no feedback batch, as they came, with the ``reason``."""
    return df.withColumn("reason", batch_reason(F.col(column))).filter("reason is not null")


def entry_rejects(df: DataFrame, column: str) -> DataFrame:
    """Entries of good batches that are no feedback: the row's other columns, ``pos``, ``entry`` (its JSON text), ``reason``."""
    good = F.when(batch_reason(F.col(column)).isNull(), F.col(column))
    others = [c for c in df.columns if c != column and c not in FEEDBACK_BATCH.names]
    each = df.select(*others, F.posexplode(_entries(good)).alias("pos", "_e"))
    return each.filter("_e.reason is not null").select(*others, "pos", F.col("_e.text").alias("entry"), "_e.reason")
