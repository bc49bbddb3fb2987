"""What the operators of this subpackage share: settings, tables, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.plans.session import tune

# Rows and bytes of one Arrow batch, so that a batch of very long texts stays small in a worker.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in ARROW_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns behind its own."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The fields of ``df`` without any of that name, in any case, and the new one."""
    return T.StructType([*[f for f in df.schema.fields if f.name.lower() != name.lower()], T.StructField(name, kind)])


def replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with a column that takes the place of any of its name."""
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], column], names=[*[batch.schema.names[i] for i in kept], name])


def text_key() -> Column:
    """Tells rows with the same ``doc_id`` but different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def rows_by_key(docs: DataFrame) -> DataFrame:
    """(_row, _id, _key): whole rows in one column, so that no name of theirs meets one of ours."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))


def keyed_as(other: DataFrame) -> Column:
    """Rows of :func:`rows_by_key` and rows of ``other`` with the same id and text."""
    return F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_key") == other["text_key"])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


class Pieces(dict):
    """Numbers of pieces of text in order of their first appearance; ``new`` lists those not worked on yet."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.next, self.new = first, []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.next
        self.next += 1
        self.new.append(piece)
        return number

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new
