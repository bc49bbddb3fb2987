"""Model delta events: message id, sequence number, JSON payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rejoinder.schemas import DELTA_EVENT


def read_deltas(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).schema(DELTA_EVENT).load(path)


def stream_deltas(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None):
    reader = spark.readStream.format(fmt).schema(DELTA_EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
