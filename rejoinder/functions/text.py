"""Text functions on columns. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters, blanks in the Unicode sense; null stays null."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def token_meter(text: Column) -> Column:
    """Approximate token count: runs of word characters plus single marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def tokenizer_meter(make_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Token meter from a tokenizer of the user's choice.

    ``make_encoder`` runs in the worker, once per task, and returns a text -> tokens function.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield texts.map(lambda text: len(encode(text)), na_action="ignore").astype("Int64")

    return count


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def second_field(text: Column, separator: str = ": ") -> Column:
    """What stands between the first and the second separator; empty when there is none."""
    return F.split_part(text, F.lit(separator), F.lit(2))


def joined_lines(text: Column) -> Column:
    """The non-empty lines put together with nothing between them."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: line != ""), "")


def before_and_after(text: Column, marker: str) -> tuple[Column, Column]:
    """First and last part of a text cut at ``marker``; both are the whole text without it."""
    return F.split_part(text, F.lit(marker), F.lit(1)), F.split_part(text, F.lit(marker), F.lit(-1))


def shown(value: Column) -> Column:
    """Text form for a prompt, where a missing value reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def with_review(comment: Column, review: Column) -> Column:
    """Comment followed directly by the stored review, ``None`` when there is none."""
    return F.concat(comment, shown(review))


def to_survey_id(value: Column) -> Column:
    return value.try_cast("bigint")


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def to_time(value: Column) -> Column:
    """Timestamp from text; text that is no timestamp is an error."""
    return F.to_timestamp(value)


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)


def repeatable_run_id(*key: Column) -> Column:
    """32 hex digits that are the same for the same batch key."""
    return F.md5(F.concat_ws("\x1f", *key))


def random_run_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
