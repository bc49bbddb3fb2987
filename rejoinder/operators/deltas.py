"""Replies that arrive in pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import word_count

# The event types that carry text and that end a message.
PIECE = "content_block_delta"
STOP = "message_stop"

# Pieces of one message that are joined together first.
BLOCK = 4_096


def read_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Type and delta text of every event; works on a stream as well.

    ``json_tuple`` reads the payload once per row; a parsed struct would be built again for
    each filter and column that uses it.
    """
    read = events.select("message_id", "seq", F.json_tuple(payload, "type", "delta").alias("kind", "_delta"))
    return read.select(
        "message_id",
        "seq",
        "kind",
        F.when(F.col("kind") == PIECE, F.coalesce(F.get_json_object("_delta", "$.text"), F.lit("")))
        .when(F.col("kind") == STOP, F.lit("\n"))
        .alias("piece"),
    )


def decode(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Text pieces from delta events; works on a stream as well.

    A delta gives its text (nothing for null), the stop event a line break; other types and
    events without payload are left out.
    """
    return (
        read_events(events, payload)
        .filter(F.col("kind").isin(PIECE, STOP))
        .select("message_id", "seq", "piece", (F.col("kind") == STOP).alias("is_stop"))
    )


def assemble(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """The text of each message, pieces joined by ``seq``.

    Long messages are joined in blocks first, so one huge message is spread over many tasks
    and the last step only sees a row per block.
    """
    def joined(order: str, text: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(ordered, lambda x: x[text]), "")

    blocks = pieces.groupBy("message_id", F.floor(F.col("seq") / block).alias("_block")).agg(
        joined("seq", "piece").alias("_text"), F.count(F.lit(1)).alias("_pieces")
    )
    return blocks.groupBy("message_id").agg(
        joined("_block", "_text").alias("text"), F.sum("_pieces").alias("pieces")
    )


def tokens_per_message(pieces: DataFrame, meter: Callable[[Column], Column] = word_count) -> DataFrame:
    """Tokens counted piece by piece, as they arrive, and added up."""
    return pieces.groupBy("message_id").agg(F.sum(meter(F.col("piece"))).alias("tokens"))
