"""Structured replies: cut out the JSON, read it, check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the keys that prompts and replies use for the same field.
ALIASES = {
    "More_friendly": ["More friendly"],
    "More_Professional": ["More Professional"],
    "More_Concise": ["More Concise"],
    "Positive_Themes": ["Positive Themes"],
    "Negative_Themes": ["Negative Themes"],
    "themes_category": ["theme_category"],
}


def json_object(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is none."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def parse_replies(
    df: DataFrame, schema: T.StructType, raw: str = "raw", aliases: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add the fields of ``schema``, ``missing_keys`` and ``parse_ok``; keeps ``raw``.

    A list where text is expected is kept as its JSON text. ``parse_ok`` means that there was
    a JSON object with at least one of the fields.
    """
    aliases = ALIASES if aliases is None else aliases
    wide = T.StructType(
        [
            T.StructField(name, field.dataType)
            for field in schema.fields
            for name in [field.name, *aliases.get(field.name, [])]
        ]
    )
    reply = F.from_json(json_object(F.col(raw)), wide)
    # a generator is evaluated once; as a plain column the JSON would be read again by every
    # filter on one of its fields
    places = {name: f"_reply_{i}" for i, name in enumerate(wide.fieldNames())}
    out = df.select("*", F.inline_outer(F.array(reply)).alias(*places.values()))
    fields = {
        field.name: F.coalesce(*[places[name] for name in [field.name, *aliases.get(field.name, [])]])
        for field in schema.fields
    }
    out = out.withColumns(fields).drop(*places.values())
    missing = F.filter(
        F.array(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields]),
        lambda name: name.isNotNull(),
    )
    return out.withColumn("missing_keys", missing).withColumn(
        "parse_ok", F.size("missing_keys") < len(schema.fields)
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parse_ok")


def rejects(parsed: DataFrame) -> DataFrame:
    """Replies that could not be read, and calls that gave none."""
    return parsed.filter(~F.col("parse_ok"))


def plain_sentiment(sentiment: Column) -> Column:
    """One spelling for promoter and non-promoter; other labels only lose outer blanks and case."""
    return F.regexp_replace(F.lower(F.trim(sentiment)), r"^(non-)?promotor$", "$1promoter")
