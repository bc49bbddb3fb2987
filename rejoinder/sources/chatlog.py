"""The request log as an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows, in folders by day, and within a day in files by ranges of sessions.

    A time range reads only its days. One session opens few files: a file holds a range of sessions, sorted, with the
    smallest and largest of each row group, and a Bloom filter tells the ranges that only enclose it. A day has as many files as
    its size asks for, not one from every task.
    """
    (
        rows.withColumn("day", F.to_date("timestamp"))
        .repartitionByRange("day", "session_id")
        .sortWithinPartitions("day", "session_id", "timestamp")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#session_id", "true")
        .partitionBy("day")
        .parquet(path)
    )


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch in a folder of its own; writing it again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
