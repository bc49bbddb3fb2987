"""Usage questions over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.functions.text import first_line, to_number
from rejoinder.plans.skew import BLOCK_ROWS, previous_rows

# Fixed value: the flat price per token on the dashboard.
FLAT_PRICE = "0.0001"


def with_numbers(log: DataFrame, raw: str = "tokens_raw", name: str = "tokens_used") -> DataFrame:
    """Token counts as numbers; what is not a number becomes null."""
    return log.withColumn(name, to_number(F.col(raw))).drop(raw)


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def kpis() -> list[Column]:
    """Aggregates for the headline figures; also usable on a stream."""
    tokens = F.col("tokens_used").cast("decimal(18,4)")
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.min_by("timestamp", "id").alias("_first"),
        F.max_by("timestamp", "id").alias("_last"),
        F.sum(tokens).alias("_tokens"),
        F.count(tokens).alias("_counted"),
    ]


def finish_kpis(sums: DataFrame) -> DataFrame:
    n = F.col("total_requests")
    total = F.coalesce(F.col("_tokens"), F.lit(0))
    cost = (total * F.lit(FLAT_PRICE).cast("decimal(5,4)")).cast("decimal(38,8)")
    mean = (F.col("_tokens") / F.nullif(F.col("_counted"), F.lit(0))).cast("bigint")
    return sums.select(
        "total_requests",
        # the gaps between neighbours add up to last minus first
        (_seconds(F.col("_last"), F.col("_first")) / F.nullif(n - 1, F.lit(0))).alias("avg_gap_s"),
        total.cast("double").alias("total_tokens"),
        F.coalesce(mean, F.lit(0)).alias("avg_tokens"),
        cost.cast("double").alias("total_cost"),
        F.coalesce(cost.cast("double") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("cost_per_request"),
    )


def kpi_overall(log: DataFrame) -> DataFrame:
    return finish_kpis(log.agg(*kpis()))


def tokens_by_session(log: DataFrame) -> DataFrame:
    """Token sum per session; rows without a session are left out, no tokens at all gives 0."""
    return (
        log.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.coalesce(F.sum("tokens_used"), F.lit(0.0)).alias("tokens_used"))
    )


def requests_per_hour(log: DataFrame) -> DataFrame:
    """Rows with a session per hour, from the first hour to the last, empty hours as 0."""
    counts = log.groupBy(F.date_trunc("hour", F.col("timestamp").cast("timestamp")).alias("hour")).agg(
        F.count("session_id").alias("requests")
    )
    return fill_hours(counts)


def fill_hours(counts: DataFrame) -> DataFrame:
    """Counts by hour with the hours in between that have none, as 0.

    Every hour fills up what lies between it and the next one. That is looked up in its year first, and only the first hour
    of each year is looked up over all years, so neither a window nor a row grows with the whole span: a gap of several
    years is one row a year before it is filled.
    """
    hour = F.expr("interval 1 hour")
    years = counts.filter("hour is not null").withColumn("_year", F.year("hour"))
    in_year = years.withColumn("_next", F.lead("hour").over(Window.partitionBy("_year").orderBy("hour")))
    # one row a year
    firsts = years.groupBy("_year").agg(F.min("hour").alias("_first"))
    following = firsts.select("_year", F.lead("_first").over(Window.orderBy("_year")).alias("_following"))
    filled = in_year.join(F.broadcast(following), "_year", "left").withColumn("_next", F.coalesce("_next", "_following"))
    # the years a gap runs through, each with its own part of the gap
    new_year = F.make_timestamp(F.col("_y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    spans = filled.withColumn("_y", F.explode(F.sequence("_year", F.year(F.coalesce(F.col("_next") - hour, F.col("hour"))))))
    start = F.when(F.col("_y") == F.col("_year"), F.col("hour")).otherwise(new_year)
    last = F.least(F.coalesce(F.col("_next") - hour, F.col("hour")), F.make_timestamp(F.col("_y"), F.lit(12), F.lit(31), F.lit(23), F.lit(0), F.lit(0)))
    each = spans.select("hour", "requests", start.alias("_start"), last.alias("_last")).repartition("hour", "_start")
    return each.select(F.col("hour").alias("_hour"), "requests", F.explode(F.sequence("_start", "_last", hour)).alias("hour")).select(
        "hour", F.when(F.col("hour") == F.col("_hour"), F.col("requests")).otherwise(F.lit(0)).alias("requests")
    )


def start_time(timestamp: Column, latency: Column) -> Column:
    seconds = latency.cast("decimal(18,6)")
    return timestamp - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


DETAIL_KEYS = ["session_id", "user_feedback", "model_response"]


def session_details(log: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` distinct log rows in log order, with start and first time of the session.

    Rows with the same session, feedback line and reply line count once, the earliest stays.
    The ids to show come from an aggregate over the three short keys; only those ``n`` rows
    are then read in full.
    """
    keys = [
        F.col("session_id"),
        first_line(F.col("user_feedback")).alias("user_feedback"),
        first_line(F.col("model_response")).alias("model_response"),
    ]
    shown = log.groupBy(*keys).agg(F.min("id").alias("id")).orderBy("id").limit(n).select("id")
    rows = log.join(F.broadcast(shown), "id", "left_semi")  # at most n ids
    sessions = rows.select("session_id").distinct()
    firsts = (
        log.select("session_id", "timestamp")
        .join(F.broadcast(sessions), "session_id", "left_semi")  # at most n sessions
        .groupBy("session_id")
        .agg(F.min("timestamp").alias("first_token"))
    )
    return (
        rows.join(firsts, "session_id", "left")
        .withColumn("user_feedback", first_line(F.col("user_feedback")))
        .withColumn("model_response", first_line(F.col("model_response")))
        .withColumn("start_time", start_time(F.col("timestamp"), F.col("latency")))
        .select(
            "id",
            "session_id",
            "user_feedback",
            "modification_needed",
            "history",
            "model_response",
            "timestamp",
            "latency",
            "tokens_used",
            "cost",
            "start_time",
            "first_token",
        )
        .orderBy("id")
        .limit(n)
    )


def latest_by_session(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """The newest row of every session, or of one; among equal times the larger id. Ids are whole numbers."""
    rows = log.filter(F.col("session_id").isNotNull())
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    # time and id as one number: a plain hash aggregate over short rows; only the join reads whole ones
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("decimal(18,0)")
    place = (micros * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col("id")).cast("decimal(38,0)")
    newest = rows.groupBy(F.col("session_id").alias("_session")).agg(F.max(place).alias("_place"))
    return rows.join(newest, (F.col("session_id") == F.col("_session")) & (place == F.col("_place")), "left_semi")


def session_gaps(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Seconds since the previous row of the same session, null on its first row."""
    slim = log.filter(F.col("session_id").isNotNull()).select("session_id", "timestamp", "id")
    with_before = previous_rows(
        slim,
        ["session_id"],
        ["timestamp", "id"],
        F.col("timestamp"),
        1,
        F.unix_micros(F.col("timestamp").cast("timestamp")),
        "_before",
        block_rows,
    )
    return with_before.select(
        "session_id",
        "id",
        "timestamp",
        _seconds(F.col("timestamp"), F.try_element_at("_before", F.lit(1))).alias("gap_s"),
    )
