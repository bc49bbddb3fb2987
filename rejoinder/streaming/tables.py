"""Results of streams as tables that stay small: a snapshot and the changes since.

A micro-batch writes a folder of its own, so running it again replaces it. What is newest is known from the names of folders; no
data are read to find it. A folder counts once its writer has marked it as done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.plans import store

# Micro-batches after which changes are put together.
COMPACT_EVERY = 20


def _done(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind, rising."""
    named = [n.removeprefix(f"{kind}=") for n in store.names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n) for n in named if "_SUCCESS" in store.names(spark, f"{path}/{kind}={n}"))


def write_result(rows: DataFrame, path: str, number: int, keep: int = 2) -> None:
    """Write a whole result, and remove all but the ``keep`` newest ones."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    for old in [n for n in _done(spark, path, "batch") if n <= number][:-keep]:
        store.remove(spark, f"{path}/batch={old}")


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest whole result: one folder is opened."""
    known = _done(spark, path, "batch")
    return spark.read.schema(schema).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], schema)


def _newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in changes.columns if c not in keys and c != "_number"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "_number").alias("_row")).select(*keys, "_row.*") if others else changes.select(*keys).distinct()


def _folders(spark: SparkSession, path: str, upto: int | None = None) -> list[tuple[int, str]]:
    """The newest snapshot and the changes after it, each with the number of its last micro-batch."""
    within = lambda n: upto is None or n <= upto
    snapshots = [n for n in _done(spark, path, "upto") if within(n)]
    last = snapshots[-1] if snapshots else -1
    changes = [(n, f"{path}/batch={n}") for n in _done(spark, path, "batch") if n > last and within(n)]
    return [*([(last, f"{path}/upto={last}")] if snapshots else []), *changes]


def write_changes(rows: DataFrame, path: str, number: int, keys: list[str], every: int = COMPACT_EVERY) -> None:
    """Write the changed rows of a micro-batch; every ``every`` batches put all of them together, newest row by key.

    The snapshot before the last one, and the changes it holds, stay until the next time, for those who are reading them.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % every:
        return
    merged = _read(spark, rows.schema, _folders(spark, path, number), keys)
    merged.write.mode("overwrite").parquet(f"{path}/upto={number}")
    snapshots = [n for n in _done(spark, path, "upto") if n <= number]
    for old in snapshots[:-2]:
        store.remove(spark, f"{path}/upto={old}")
    for old in _done(spark, path, "batch"):
        if len(snapshots) > 1 and old <= snapshots[-2]:
            store.remove(spark, f"{path}/batch={old}")


def _read(spark: SparkSession, schema: T.StructType, folders: list[tuple[int, str]], keys: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*[folder for _, folder in folders])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|upto)=(\d+)/[^/]*$", 1).cast("long")
    return _newest(found.withColumn("_number", number), keys).select(*schema.names)


def read_newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of every key: one snapshot and at most ``every`` folders of changes are opened."""
    return _read(spark, schema, _folders(spark, path), keys)
