"""Flat tables: survey master, chat log, messages and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rejoinder.schemas import CHAT_LOG, SURVEY_MASTER


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read Parquet, ORC, CSV (with header) or JSON lines; text formats need a schema."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema: inferring one reads the data twice")
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def read_survey_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, SURVEY_MASTER, fmt)


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CHAT_LOG)
