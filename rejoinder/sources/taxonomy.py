"""Theme taxonomy: the classes a comment may be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def theme_names(text: Column) -> Column:
    """Names in a comma-separated text, trimmed of blanks and line breaks, without empty ones."""
    names = F.transform(F.split(text, ","), lambda name: F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.filter(names, lambda name: name != "")


def parse_taxonomy(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """One row per distinct theme per kept key."""
    keep = keep or []
    return df.select(*keep, F.explode(theme_names(F.col(column))).alias("theme")).distinct()


def read_taxonomy(spark: SparkSession, path: str, commas: bool = True) -> DataFrame:
    """Read a taxonomy file: one comma-separated text, or one theme per line.

    The line form is the one for names that hold a comma.
    """
    if commas:
        return parse_taxonomy(spark.read.text(path, wholetext=True), "value")
    lines = spark.read.text(path).select(F.trim("value").alias("theme"))
    return lines.filter("theme <> ''").distinct()
