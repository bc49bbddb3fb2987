"""The live request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.dashboard import fill_hours, finish_kpis, kpis

__all__ = ["fill_hours", "finished_requests", "live_kpis", "live_requests_per_hour", "live_tokens_by_session"]


def live_kpis(log: DataFrame) -> DataFrame:
    """Headline figures; complete mode, one row."""
    return finish_kpis(log.agg(*kpis()))


def live_requests_per_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows with a session per hour. Append mode gives an hour once it is over and ``late`` has passed."""
    return (
        log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 hour").alias("_w"))
        .agg(F.count("session_id").alias("requests"))
        .select(F.col("_w.start").alias("hour"), "requests")
    )


def live_tokens_by_session(log: DataFrame) -> DataFrame:
    """Token sum per session; update mode writes only sessions that changed."""
    return (
        log.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.coalesce(F.sum("tokens_used"), F.lit(0.0)).alias("tokens_used"))
    )


def finished_requests(starts: DataFrame, replies: DataFrame, keys: list[str], wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Requests put together with their replies, from a stream of each.

    ``starts`` has ``started_at`` and ``replies`` has ``finished_at`` beside ``keys``; all their other columns come along. A reply
    that comes within ``wait`` of its request gives a row with ``status`` "answered" and ``latency_s`` from both times. A
    request without one gives "missing" once ``wait`` is over, with nulls for the reply; a reply without a request that
    waits for it, because it comes too late or the request never came, gives "unasked", with nulls for the request. Both kinds of state are
    dropped when the watermark, ``late`` behind the newest time, has passed ``wait``.
    """
    asked = starts.withWatermark("started_at", late)
    done = replies.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in replies.columns if c not in keys]).withWatermark("finished_at", late)
    same = F.expr(f"finished_at >= started_at and finished_at <= started_at + interval {wait}")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    status = F.when(F.col("finished_at").isNull(), "missing").when(F.col("started_at").isNull(), "unasked").otherwise("answered")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    both = asked.join(done, same, "full")
    return both.select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys],
        *[c for c in starts.columns if c not in keys],
        *[c for c in replies.columns if c not in keys],
        seconds.alias("latency_s"),
        status.alias("status"),
    )
