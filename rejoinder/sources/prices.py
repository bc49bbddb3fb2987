"""Price catalogue: nested JSON with four sections, flattened to one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.schemas import PRICE_CATALOG

COLUMNS = ["section", "model", "variant", "size", "price_kind", "price"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_CATALOG).json(path, multiLine=True)


def parse_catalog(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, PRICE_CATALOG).alias("_c")).select("_c.*")


def _entry(
    section: str,
    model: Column,
    price: Column,
    price_kind: str = "price",
    variant: Column | None = None,
    size: Column | None = None,
) -> Column:
    missing = F.lit(None).cast("string")
    values = [F.lit(section), model, missing if variant is None else variant, missing if size is None else size]
    return F.struct(*[v.alias(c) for v, c in zip([*values, F.lit(price_kind), price], COLUMNS, strict=True)])


def _each(entries: Column, make: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.map_entries(entries), lambda e: make(e["key"], e["value"]))


def flat_prices(catalog: DataFrame) -> DataFrame:
    """One row per price. All sections are unrolled in one pass over each document."""
    sections = [
        _each(F.col("embeddings"), lambda model, price: _entry("embeddings", model, price)),
        F.flatten(
            _each(
                F.col("images"),
                lambda model, qualities: F.flatten(
                    _each(
                        qualities,
                        lambda quality, sizes: _each(
                            sizes,
                            lambda size, price: _entry("images", model, price, variant=quality, size=size),
                        ),
                    )
                ),
            )
        ),
        _each(F.col("audio"), lambda model, price: _entry("audio", model, price)),
        F.flatten(
            _each(
                F.col("chat"),
                lambda model, both: F.array(
                    _entry("chat", model, both["promptPrice"], "prompt"),
                    _entry("chat", model, both["completionPrice"], "completion"),
                ),
            )
        ),
    ]
    # a section that is not there is null; null lists are left out before they are joined
    present = F.flatten(F.filter(F.array(*sections), lambda prices: prices.isNotNull()))
    return catalog.select(F.explode(present).alias("_p")).select("_p.*")


def chat_prices(flat: DataFrame) -> DataFrame:
    """One row per chat model with both prices."""

    def price_of(kind: str) -> Column:
        return F.max(F.when(F.col("price_kind") == kind, F.col("price")))

    return (
        flat.filter(F.col("section") == "chat")
        .groupBy("model")
        .agg(price_of("prompt").alias("prompt_price"), price_of("completion").alias("completion_price"))
    )
