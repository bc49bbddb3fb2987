import glob
import json
import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rejoinder.operators import dashboard, deltas
from rejoinder.schemas import DELTA_EVENT
from rejoinder.sources.deltas import read_deltas, stream_deltas
from rejoinder.streaming import log as live_log
from rejoinder.streaming import memory, runner, tables
from rejoinder.streaming.deltas import live_assemble
from rejoinder.testing import fixtures

TEXTS = {m: [f"p{m}.{i} " for i in range(n)] for m, n in ((1, 1), (2, 40), (3, 7), (4, 200), (5, 0))}


def events():
    out = []
    for m, pieces in TEXTS.items():
        body = [{"type": "message_start"}, None, *[{"type": "content_block_delta", "delta": {"text": p}} for p in pieces]]
        body += [{"type": "content_block_delta", "delta": {"text": None}}, {"type": "message_stop"}]
        out += [(m, i, None if b is None else json.dumps(b)) for i, b in enumerate(body)]
    return out


WANT = {m: "".join(p) + "\n" for m, p in TEXTS.items()}


def write_files(path, data, n):
    path.mkdir()
    for i in range(n):
        lines = [json.dumps(dict(zip(("message_id", "seq", "payload"), e, strict=True))) for e in data[i::n]]
        (path / f"{i:02d}.json").write_text("\n".join(lines))
    return str(path)


def test_batch_assembly(spark, rows):
    data = events()
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, DELTA_EVENT).repartition(3)
    pieces = deltas.decode(df)
    for block in (3, 4096):
        assert dict(rows(deltas.assemble(pieces, block), "message_id", "text")) == WANT
    tokens = dict(rows(deltas.tokens_per_message(pieces), "message_id", "tokens"))
    assert tokens == {m: len(p) for m, p in TEXTS.items()}


def test_tokens_are_counted_per_piece(spark):
    cut = [(1, 0, '{"type":"content_block_delta","delta":{"text":"hel"}}'), (1, 1, '{"type":"content_block_delta","delta":{"text":"lo"}}')]
    df = deltas.decode(spark.createDataFrame(cut, DELTA_EVENT))
    assert deltas.tokens_per_message(df).first().tokens == 2


@pytest.mark.parametrize("files", [1, 5])
def test_live_assembly_of_shuffled_events(spark, tmp_path, rows, files):
    data = events()
    random.Random(files).shuffle(data)
    path = write_files(tmp_path / "in", data, files)
    done = runner.run_append(live_assemble(stream_deltas(spark, path, files_per_trigger=1)), "t")
    assert rows(done) == sorted((m, t, True) for m, t in WANT.items())
    assert dict(rows(deltas.assemble(deltas.decode(read_deltas(spark, path))), "message_id", "text")) == WANT


def test_message_without_stop_is_given_up(spark, tmp_path):
    first = [e for e in events() if not (e[0] == 3 and e[2] and "message_stop" in e[2])]
    path = write_files(tmp_path / "in", first, 1)
    stream = live_assemble(stream_deltas(spark, path), give_up_after_ms=1)
    out = str(tmp_path / "out")
    spark.createDataFrame([], stream.schema).write.parquet(out)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="200 milliseconds")
        .start()
    )
    try:
        # a query with a timer always has a next batch, so there is no "all done" to wait for
        end = time.time() + 40
        got = {}
        while time.time() < end and 3 not in got:
            time.sleep(1)
            got = {r.message_id: (r.text, r.complete) for r in spark.read.schema(stream.schema).parquet(out).collect()}
    finally:
        query.stop()
    assert got[3] == (WANT[3].removesuffix("\n"), False)
    assert got[2] == (WANT[2], True)


def log_files(spark, tmp_path, n):
    data = [(i, f"s{i % 7}" if i % 11 else None, 1_709_280_000 + i * 700, float(i) if i % 5 else None) for i in range(200)]
    log = spark.createDataFrame(data, "id bigint, session_id string, s bigint, tokens_used double").select(
        "id", "session_id", F.timestamp_seconds("s").alias("timestamp"), "tokens_used"
    )
    path = str(tmp_path / "log")
    log.repartitionByRange(n, "id").write.parquet(path)
    # a stream takes files by age: make the ages follow the ids, or early rows come too late
    for age, name in enumerate(sorted(glob.glob(f"{path}/part-*"))):
        os.utime(name, (1_700_000_000 + age * 60,) * 2)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_figures_equal_batch_ones(spark, tmp_path, rows):
    log, stream = log_files(spark, tmp_path, 4)
    assert rows(runner.run_complete(live_log.live_kpis(stream), "k")) == rows(dashboard.kpi_overall(log))
    hours = runner.run_complete(live_log.live_requests_per_hour(stream), "h")
    assert rows(live_log.fill_hours(hours)) == rows(dashboard.requests_per_hour(log))
    tokens = runner.run_update(live_log.live_tokens_by_session(stream), ["session_id"], "t")
    assert rows(tokens) == rows(dashboard.tokens_by_session(log))


def test_hours_in_append_mode_hold_back_open_ones(spark, tmp_path):
    log, stream = log_files(spark, tmp_path, 4)
    closed = runner.run_append(live_log.live_requests_per_hour(stream), "a")
    n = log.select(F.date_trunc("hour", "timestamp")).distinct().count()
    assert n - 3 <= closed.count() < n


def test_keyed_append_adds_nothing_twice(spark, tmp_path, rows):
    log, stream = log_files(spark, tmp_path, 3)
    path = str(tmp_path / "out")
    assert rows(runner.run_keyed_append(stream, "x", path)) == rows(log)
    from rejoinder.sources.chatlog import write_batch

    again = spark.read.parquet(f"{path}/batch=1")
    n = again.count()
    again = spark.createDataFrame(again.collect(), again.schema)
    write_batch(again, path, 1)
    assert n > 0 and spark.read.parquet(path).count() == log.count()


def test_live_query_renews_itself(spark, tmp_path, rows):
    log, stream = log_files(spark, tmp_path, 2)
    path = str(tmp_path / "live")
    figures = live_log.live_kpis(stream)
    query = runner.run_live(figures, "complete", path, str(tmp_path / "checkpoint"), every="100 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(tables.read_result(spark, path, figures.schema)) == rows(dashboard.kpi_overall(log))


@pytest.mark.parametrize("files", [1, 4])
def test_memory_of_shuffled_messages(spark, tmp_path, files):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}", i, "user", f"t{i}") for i in range(300)]
    want = {}
    for s, o, r, t in data:
        want.setdefault(s, []).append((r, t))
    rng.shuffle(data)
    path = str(tmp_path / "in")
    df = spark.createDataFrame(data, "session_id string, ord bigint, role string, text string")
    df.repartition(files).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = runner.run_update(memory.live_history(stream), ["session_id"], "m").collect()
    assert {r.session_id: [tuple(m) for m in r.history] for r in kept} == {s: m[-3:] for s, m in want.items()}


def test_silent_session_is_forgotten(spark, tmp_path):
    schema = "session_id string, ord bigint, role string, text string"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def say(ord, text):
        spark.createDataFrame([("s", ord, "user", text)], schema).coalesce(1).write.mode("append").parquet(path)

    def newest():
        seen = spark.read.schema(memory_of.schema).parquet(f"{out}/batch=*").collect()
        return max(((r.last_ord, [m.text for m in r.history]) for r in seen), default=None)

    say(1, "old")
    memory_of = memory.live_history(spark.readStream.schema(schema).parquet(path), forget_after_ms=500)
    query = runner.run_live(memory_of, "update", out, str(tmp_path / "checkpoint"), every="200 milliseconds")
    try:
        for ord, text in ((1, None), (2, "new")):
            if text:
                time.sleep(4)  # long enough for the timer to run out
                say(ord, text)
            end = time.time() + 40
            while time.time() < end:
                time.sleep(1)
                try:
                    got = newest()
                except Exception:  # a folder that is being replaced right now
                    continue
                if got and got[0] == ord:
                    break
    finally:
        query.stop()
    assert got == (2, ["new"])


@pytest.mark.parametrize("files", [1, 4])
def test_events_that_come_again_change_nothing(spark, tmp_path, rows, files):
    data = events()
    data += data[::3]
    random.Random(files + 7).shuffle(data)
    path = write_files(tmp_path / "in", data, files)
    done = runner.run_append(live_assemble(stream_deltas(spark, path, files_per_trigger=1)), "t")
    assert rows(done) == sorted((m, t, True) for m, t in WANT.items())


def test_a_message_that_comes_again_takes_one_place(spark, tmp_path):
    sent = [("s", i, "user", f"m{i}") for i in (1, 2, 3, 3, 2, 3)] + [("s", 4, None, None), ("s", 4, "user", "x")]
    path = str(tmp_path / "in")
    spark.createDataFrame(sent, "session_id string, ord int, role string, text string").repartition(2).write.parquet(path)
    stream = memory.live_history(spark.readStream.schema("session_id string, ord int, role string, text string").parquet(path))
    kept = runner.run_update(stream, ["session_id"], "again").first()
    assert kept.last_ord == 4 and [m.text for m in kept.history][:2] == ["m2", "m3"] and len(kept.history) == 3


def test_events_behind_the_stop_lose_no_message(spark, tmp_path, rows):
    behind = [(m, len(TEXTS[m]) + 4 + i, json.dumps({"type": "content_block_delta", "delta": {"text": "late"}})) for m in TEXTS for i in range(3)]
    for files, data in ((1, events() + behind), (2, events()[:150] + behind + events()[150:])):
        path = write_files(tmp_path / f"in{files}", data, files)
        done = runner.run_append(live_assemble(stream_deltas(spark, path, files_per_trigger=1)), "t")
        assert rows(done) == sorted((m, t, True) for m, t in WANT.items())


def test_events_after_a_message_was_given_out_are_ignored(spark, tmp_path, rows):
    path = tmp_path / "in"
    path.mkdir()
    for i, data in enumerate([events(), [(2, 60, json.dumps({"type": "content_block_delta", "delta": {"text": "late"}})), (2, 3, None)], events()[:40]]):
        lines = [json.dumps(dict(zip(("message_id", "seq", "payload"), e, strict=True))) for e in data]
        (path / f"{i}.json").write_text("\n".join(lines))
        os.utime(path / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)
    done = runner.run_append(live_assemble(stream_deltas(spark, str(path), files_per_trigger=1)), "t")
    assert rows(done) == sorted((m, t, True) for m, t in WANT.items())


def test_overlapping_runs(spark, tmp_path, rows):
    """Files that hold the same stretch of events more than once, cut at different places."""
    message = [e for e in events() if e[0] == 4]
    path = tmp_path / "in"
    path.mkdir()
    for i, (a, b) in enumerate([(50, 120), (0, 70), (100, 180), (40, 60), (150, 999)]):
        lines = [json.dumps(dict(zip(("message_id", "seq", "payload"), e, strict=True))) for e in message[a:b]]
        (path / f"{i}.json").write_text("\n".join(lines))
    done = runner.run_append(live_assemble(stream_deltas(spark, str(path), files_per_trigger=1)), "t")
    assert rows(done) == [(4, WANT[4], True)]


def test_changes_are_put_together_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    want = {}
    for number in range(11):
        changed = [(k, f"{number}") for k in (number % 3, 100 + number)]
        want.update(changed)
        tables.write_changes(spark.createDataFrame(changed, schema), path, number, ["k"], every=4)
        newest = tables.read_newest(spark, path, spark.createDataFrame([], schema).schema, ["k"])
        assert {r.k: r.v for r in newest.collect()} == want
        # one snapshot and at most four folders of changes
        assert len({f.rpartition("/")[0] for f in newest.inputFiles()}) <= 5
    # a batch that is run again replaces itself, compaction and all
    tables.write_changes(spark.createDataFrame([(10 % 3, "10"), (110, "10")], schema), path, 10, ["k"], every=4)
    newest = tables.read_newest(spark, path, spark.createDataFrame([], schema).schema, ["k"])
    assert {r.k: r.v for r in newest.collect()} == want
    assert len(os.listdir(path)) <= 4 + 4 + 2
    (tmp_path / "t" / "batch=11").mkdir()  # a writer that was killed has left no mark
    assert {r.k: r.v for r in tables.read_newest(spark, path, newest.schema, ["k"]).collect()} == want


def test_whole_results_do_not_pile_up(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in range(5):
        tables.write_result(spark.createDataFrame([(number,)], "n int"), path, number)
        read = tables.read_result(spark, path, spark.createDataFrame([], "n int").schema)
        assert [r.n for r in read.collect()] == [number] and len({f.rpartition("/")[0] for f in read.inputFiles()}) == 1
    assert len([n for n in os.listdir(path) if n.startswith("batch=")]) == 2
    assert tables.read_result(spark, str(tmp_path / "none"), read.schema).count() == 0


def test_requests_meet_their_replies(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    starts = [("a", 0, "q0", at(0)), ("a", 1, "q1", at(10)), ("b", 0, "q2", at(20)), ("c", 0, "q3", at(30)), ("z", 0, "last", at(5_000))]
    replies = [("a", 0, "r0", at(4)), ("b", 0, "r2", at(2_000)), ("x", 0, "r?", at(40)), ("c", 0, "r3", at(30)), ("z", 0, "last", at(5_000))]
    paths = []
    for name, rows_, schema in (("starts", starts, "s string, o int, text string, started_at timestamp"), ("replies", replies, "s string, o int, raw string, finished_at timestamp")):
        df = spark.createDataFrame(rows_, schema)
        paths.append((str(tmp_path / name), df.schema))
        for i, part in enumerate((df.filter("s <> 'z'"), df.filter("s = 'z'"))):
            part.coalesce(1).write.mode("append").parquet(paths[-1][0])
            time.sleep(0.02)
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path) for path, schema in paths]
    done = runner.run_append(live_log.finished_requests(*streams, ["s", "o"], wait="10 minutes", late="1 minute"), "f").collect()
    got = {(r.s, r.o, r.status): (r.text, r.raw, r.latency_s) for r in done}
    assert len(got) == len(done) and got == {
        ("a", 0, "answered"): ("q0", "r0", 4.0), ("a", 1, "missing"): ("q1", None, None), ("b", 0, "missing"): ("q2", None, None), ("b", 0, "unasked"): (None, "r2", None),
        ("c", 0, "answered"): ("q3", "r3", 0.0), ("x", 0, "unasked"): (None, "r?", None), ("z", 0, "answered"): ("last", "last", 0.0),
    }


def test_delta_events_of_odd_texts(spark):
    texts = ["a b", "", " ", "two  spaces ", 'q"u\\o/te" \n\t\r\x01 end', "Grüße 😀 \u2028 x", "</s> {\"text\":\"\"} ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = fixtures.delta_events(docs)
    # built in the plan as literals, not piece by piece as structs
    assert "to_json" in made._jdf.queryExecution().analyzed().toString() and "named_struct(type" not in made._jdf.queryExecution().analyzed().toString()
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.message_id, r.seq)):
        got.setdefault(r.message_id, []).append(r.payload)
    one = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct("text").alias("delta"))).alias("payload")
    for i, text in enumerate(texts[:-1]):
        pieces = [p + " " for p in text.split(" ")[:-1]] + [text.split(" ")[-1]]
        want = [r.payload for r in spark.createDataFrame([(p,) for p in pieces], "text string").coalesce(1).select(one).collect()]
        assert got[i] == ['{"type":"message_start"}', None, '{"type":"ping"}', *want, '{"type":"message_stop"}']
        assert "".join(json.loads(p)["delta"]["text"] for p in got[i][3:-1]) == text
    assert len(texts) - 1 not in got  # a null text has no events
