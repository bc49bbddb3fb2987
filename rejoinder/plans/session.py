"""Session settings and the shared folder for saved results."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all can be changed on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even when the split costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a worker holds a batch several times (Arrow, strings, prompts, replies), so long texts come a few at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings, and let workers run our functions without an installed package."""
    cloudpickle.register_pickle_by_value(sys.modules["rejoinder"])
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="rejoinder-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, partition_by: list[str] | None = None, **options: int | str) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the writer, and read it back.

    Cuts the lineage and pins the result: what comes after never runs the model again,
    and survives the loss of the executors that produced it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
