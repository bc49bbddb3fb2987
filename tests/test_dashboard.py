from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rejoinder.operators import chat, dashboard
from rejoinder.schemas import CHAT_LOG
from rejoinder.sources.chatlog import append_log
from rejoinder.sources.tables import read_table
from rejoinder.testing.stand_in import stand_in

T0 = datetime(2024, 3, 1, 10, 15)
LOG = "id bigint, session_id string, user_feedback string, modification_needed string, history string, model_response string, timestamp timestamp, latency double, tokens_used double, cost decimal(18,8)"


def log_of(spark, *rows):
    return spark.createDataFrame(
        [
            (i, s, fb, "", "", reply, T0 + timedelta(minutes=m), lat, tok, Decimal("0.1"))
            for i, s, fb, reply, m, lat, tok in rows
        ],
        LOG,
    )


@pytest.fixture
def log(spark):
    return log_of(
        spark,
        (1, "a", "hello\nx", "r\n1", 0, 1.5, 10.0),
        (2, "b", "hello\nx", "r\n1", 10, 2.0, None),
        (3, "a", "hello\ny", "r\n2", 20, 0.25, 30.0),
        (4, None, "q", "r", 200, 1.0, 5.0),
        (5, "a", "other", "r", 250, 1.0, 5.0),
        (6, None, "q", "r", 260, 1.0, 5.0),
        (7, "c", "z", "r", 260, 1.0, None),
    )


def test_kpis_as_pandas(log):
    frame = pd.DataFrame(log.collect(), columns=log.columns)
    row = dashboard.kpi_overall(log).first()
    assert row.total_requests == len(frame)
    assert row.avg_gap_s == pytest.approx(frame["timestamp"].diff().mean().total_seconds())
    assert row.total_tokens == frame["tokens_used"].sum() and row.avg_tokens == int(frame["tokens_used"].mean())
    assert row.total_cost == pytest.approx(frame["tokens_used"].sum() * 0.0001)
    assert row.cost_per_request == pytest.approx(frame["tokens_used"].sum() * 0.0001 / len(frame))


def test_kpis_of_small_logs(spark):
    empty = dashboard.kpi_overall(log_of(spark)).first()
    assert tuple(empty) == (0, None, 0.0, 0, 0.0, 0.0)
    one = dashboard.kpi_overall(log_of(spark, (1, "a", "x", "y", 0, 1.0, None))).first()
    assert (one.total_requests, one.avg_gap_s, one.avg_tokens) == (1, None, 0)


def test_tokens_by_session(log, rows):
    assert rows(dashboard.tokens_by_session(log)) == [("a", 45.0), ("b", 0.0), ("c", 0.0)]


def test_hours_are_filled_and_rows_without_session_not_counted(log):
    got = {r.hour.hour: r.requests for r in dashboard.requests_per_hour(log).collect()}
    assert got == {10: 3, 11: 0, 12: 0, 13: 0, 14: 2}


def test_details(log):
    got = {r.id: r for r in dashboard.session_details(log).collect()}
    # 3 repeats the first lines of 1, and 6 those of 4 (no session counts as one key)
    assert sorted(got) == [1, 2, 4, 5, 7]
    assert got[1].user_feedback == "hello" and got[1].start_time == T0 - timedelta(seconds=1.5)
    assert got[5].first_token == T0 and got[4].first_token is None
    assert [r.id for r in dashboard.session_details(log, n=2).collect()] == [1, 2]


def test_latest(log):
    got = {r.session_id: r.id for r in dashboard.latest_by_session(log).collect()}
    assert got == {"a": 5, "b": 2, "c": 7}
    assert [r.id for r in dashboard.latest_by_session(log, "a").collect()] == [5]


def test_one_session_is_filtered_in_the_scan(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    plan = dashboard.latest_by_session(stored, "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,a)" in plan
    plan = dashboard.tokens_by_session(stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<session_id:string,tokens_used:double>" in plan


def test_append_twice(spark, log, tmp_path, rows):
    path = str(tmp_path / "log")
    append_log(log.filter("id < 4"), path)
    append_log(log.filter("id >= 4"), path)
    assert rows(read_table(spark, path, CHAT_LOG), *log.columns) == rows(log)


def test_text_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, str(tmp_path), fmt="csv")
    (tmp_path / "m.csv").write_text('survey_id,contact,review_text,review_rating,pos\n1,A,"two\nlines, ""quoted""",5,0\n')
    from rejoinder.sources.tables import read_survey_master

    row = read_survey_master(spark, str(tmp_path / "m.csv"), "csv").first()
    assert (row.survey_id, row.review_text, row.review_rating) == (1, 'two\nlines, "quoted"', 5)


def test_hours_far_apart_are_filled_by_their_neighbours(spark):
    log = spark.createDataFrame(
        [(1, "s", "1970-03-01 10:20:00"), (2, None, "1970-03-01 13:59:59"), (3, "s", "2026-01-01 00:00:00"), (4, "s", "2026-01-01 00:30:00"), (5, "s", "2024-12-31 23:00:00")],
        "id bigint, session_id string, t string",
    ).select("id", "session_id", F.col("t").cast("timestamp").alias("timestamp"))
    got = dashboard.requests_per_hour(log)
    whole = got.agg(F.count("*"), F.countDistinct("hour"), F.sum("requests"), F.min("hour").cast("string"), F.max("hour").cast("string")).first()
    hours = 24 * 20_395 - 10 + 1  # whole days from 1970-03-01 to 2026-01-01
    assert tuple(whole) == (hours, hours, 4, "1970-03-01 10:00:00", "2026-01-01 00:00:00")
    assert {(str(r.hour), r.requests) for r in got.filter("requests > 0").collect()} == {("1970-03-01 10:00:00", 1), ("2024-12-31 23:00:00", 1), ("2026-01-01 00:00:00", 2)}
    # no row unrolls more than a year
    assert dashboard.requests_per_hour(log.limit(0)).count() == 0


def test_latest_sorts_no_whole_rows(spark):
    log = spark.createDataFrame(
        [(1, "a", "2024-01-01 00:00:01", "x"), (2, "a", "2024-01-01 00:00:01", "y"), (3, "a", "1960-01-01 00:00:00", "z"), (4, None, "2025-01-01 00:00:00", "n"), (5, "b", "1960-01-01 00:00:00", "w")],
        "id bigint, session_id string, t string, model_response string",
    ).withColumn("timestamp", F.col("t").cast("timestamp"))
    latest = dashboard.latest_by_session(log)
    assert {(r.session_id, r.id) for r in latest.collect()} == {("a", 2), ("b", 5)}
    assert [r.id for r in dashboard.latest_by_session(log, "a").collect()] == [2]
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()


def test_log_of_one_session_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(0, 20_000, 1, 16).select(
        "id", F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("session_id"), F.timestamp_seconds(F.col("id") * 13 + 1_700_000_000).alias("timestamp")
    )
    append_log(rows, path)
    days = {str(f.parent): 0 for f in tmp_path.rglob("*.parquet")}
    for f in tmp_path.rglob("*.parquet"):
        days[str(f.parent)] += 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(days) == 4 and sum(days.values()) <= len(days) + partitions - 1
    own = spark.read.parquet(path).filter("session_id = 's7'")
    assert own.count() == 40 and "EqualTo(session_id,s7)" in own._jdf.queryExecution().executedPlan().toString()
    for f in tmp_path.rglob("*.parquet"):
        column = pq.ParquetFile(f).metadata.row_group(0).column(1)
        names = [r[0] for r in spark.read.parquet(str(f)).select("session_id").collect()]
        assert names == sorted(names) and column.statistics.min == names[0]


def test_first_user_turn_may_follow_others(spark):
    messages = spark.createDataFrame(
        [("a", 0, "assistant", "hello"), ("a", 1, "user", "first"), ("a", 2, "assistant", "r"), ("a", 3, "user", "second"), ("b", 0, "user", "only")],
        "session_id string, ord bigint, role string, text string",
    )
    sessions = spark.createDataFrame([("a", "1"), ("b", "2")], "session_id string, survey_id string")
    master = spark.createDataFrame([(1, "Ann", "rev", 5, 0)], "survey_id bigint, contact string, review_text string, review_rating int, pos bigint")
    got = chat.chat_replies(messages, sessions, master, stand_in).collect()
    assert {(r.session_id, r.ord): r.is_first for r in got} == {("a", 1): True, ("a", 3): False, ("b", 0): True}
