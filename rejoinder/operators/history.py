"""Message history of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import shown
from rejoinder.plans.skew import BLOCK_ROWS, previous_rows


def history_before(messages: DataFrame, n: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``history``: the last ``n`` messages of the session before each message."""
    return previous_rows(
        messages, ["session_id"], ["ord"], F.struct("role", "text"), n, F.col("ord"), "history", block_rows
    )


def history_after(messages: DataFrame, n: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Replies only, with the history as it stands once the reply is in.

    Up to ``n`` messages before the prompt, then the prompt and the reply.
    """
    return (
        previous_rows(
            messages, ["session_id"], ["ord"], F.struct("role", "text"), n + 1, F.col("ord"), "_before", block_rows
        )
        .filter(F.col("role") == "assistant")
        .withColumn("history", F.concat("_before", F.array(F.struct("role", "text"))))
        .drop("_before")
    )


def history_text(history: Column) -> Column:
    """One ``role: text`` line per message."""
    return F.array_join(
        F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), shown(m["text"]))), "\n"
    )
