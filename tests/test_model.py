import glob
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rejoinder.functions.model import Permanent, Retry, ask
from rejoinder.operators.themes import classify, tag_by_phrase
from rejoinder.testing.stand_in import StandIn, stand_in
from rejoinder.operators import parse, themes
from rejoinder.operators.inference import answers_in, batch_inference, durable_inference, run_chain
from rejoinder.schemas import ANALYSIS_REPLY, THEME_REPLY


class Flaky:
    """Fails the first ``times`` calls."""

    def __init__(self, times):
        self.times, self.calls = times, 0

    def generate(self, prompts):
        self.calls += 1
        if self.calls <= self.times:
            raise TimeoutError("busy")
        return [p.upper() for p in prompts]


class Picky:
    """Refuses any call that holds the bad prompt; counts the calls of this process."""

    def generate(self, prompts):
        if "bad" in prompts:
            raise ValueError("refused")
        return [p.upper() for p in prompts]


def test_retry_until_it_works(retry):
    assert ask(Flaky(2), ["a"], retry)[0][:3] == ("A", None, 3)
    failed = ask(Flaky(3), ["a"], retry)[0]
    assert failed.raw is None and failed.error == "TimeoutError: busy" and failed.attempts == 3


def test_one_bad_prompt_does_not_take_the_others_down(retry):
    answers = ask(Picky(), ["a", "b", "bad", "c", "d"], retry)
    assert [a.raw for a in answers] == ["A", "B", None, "C", "D"]
    assert [a.error is None for a in answers] == [True, True, False, True, True]


def test_wrong_number_of_replies_is_an_error():
    class Short:
        def generate(self, prompts):
            return []

    assert "1 prompts but 0 replies" in ask(Short(), ["a"], Retry(2, 0))[0].error


def test_waits_grow_up_to_a_limit(monkeypatch):
    waits = []
    monkeypatch.setattr("rejoinder.functions.model.time.sleep", waits.append)
    ask(Flaky(99), ["a"], Retry(max_attempts=6, first_wait_s=1, longest_wait_s=4))
    assert len(waits) == 5 and max(waits) <= 4 and waits[0] <= 1


@pytest.mark.parametrize("dedupe", [True, False])
def test_batch_inference_keeps_every_row(spark, retry, dedupe):
    data = [(i, p) for i, p in enumerate(["a", "b", "bad", "a", None, "c", "a", None])]
    df = spark.createDataFrame(data, "id int, prompt string")
    got = batch_inference(df, Picky, retry=retry, batch_size=2, dedupe=dedupe)
    assert got.columns == ["id", "raw", "error", "attempts", "latency_s"]
    result = {r.id: (r.raw, r.error) for r in got.collect()}
    assert result == {
        i: (None, "ValueError: refused") if p == "bad" else (p and p.upper(), None) for i, p in data
    }


def test_equal_prompts_are_sent_once(spark, retry):
    sent = spark.sparkContext.accumulator(0)

    class Counting:
        def generate(self, prompts):
            sent.add(len(prompts))
            return list(prompts)

    df = spark.range(300, numPartitions=5).select("id", (F.col("id") % 7).cast("string").alias("prompt"))
    got = batch_inference(df, Counting, retry=retry, max_concurrency=2, dedupe=True)
    assert got.count() == 300
    assert got.filter("raw = cast(id % 7 as string)").count() == 300
    assert sent.value % 7 == 0


def test_concurrency_cap_is_in_the_plan(spark, retry):
    df = spark.range(10).select("id", F.col("id").cast("string").alias("prompt"))
    plan = batch_inference(df, stand_in, retry=retry, max_concurrency=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 3, true" in plan


def test_chain_carries_state_across_arrow_batches(spark, retry):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        data = [(k, i) for k in ("hot", "b", "c") for i in range(50 if k == "hot" else 5)]
        df = spark.createDataFrame(data, "k string, i int").orderBy(F.rand(1))
        got = run_chain(
            df,
            ["k"],
            ["i"],
            start=lambda row: "",
            prompt=lambda state, row: f"{state}{row['i'] % 10}",
            step=lambda state, row, raw: raw,
            make_client=lambda: Echo(),
            retry=retry,
            batch_size=3,
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(k, i): "".join(str(j % 10) for j in range(i + 1)) for k, i in data}
    assert {(r.k, r.i): r.raw for r in got} == want


class Echo:
    def generate(self, prompts):
        return list(prompts)


REPLY = {"Default": "d", "Summary": "s", "Sentiment": "promotor", "Positive_Themes": ["a"], "Negative_Themes": []}


@pytest.mark.parametrize(
    "raw, ok, missing",
    [
        (json.dumps(REPLY), True, ["More_friendly", "More_Professional", "More_Concise"]),
        (f"Here it is:\n```json\n{json.dumps(REPLY, indent=1)}\n```", True, ["More_friendly", "More_Professional", "More_Concise"]),
        ("no json", False, ANALYSIS_REPLY.fieldNames()),
        ("{broken", False, ANALYSIS_REPLY.fieldNames()),
        ("{}", False, ANALYSIS_REPLY.fieldNames()),
        (None, False, ANALYSIS_REPLY.fieldNames()),
    ],
)
def test_parse(spark, raw, ok, missing):
    parsed = parse.parse_replies(spark.createDataFrame([(raw,)], "raw string"), ANALYSIS_REPLY)
    row = parsed.first()
    assert row.parse_ok is ok and row.missing_keys == missing and row.raw == raw
    assert parse.accepted(parsed).count() == int(ok) and parse.rejects(parsed).count() == int(not ok)


def test_other_spellings_and_types(spark):
    raw = json.dumps({"More friendly": "f", "More_Concise": ["x", "y"], "Positive Themes": ["p"], "Negative_Themes": "not a list"})
    row = parse.parse_replies(spark.createDataFrame([(raw,)], "raw string"), ANALYSIS_REPLY).first()
    assert row.More_friendly == "f" and row.Positive_Themes == ["p"]
    assert json.loads(row.More_Concise) == ["x", "y"]
    assert row.Negative_Themes is None and row.parse_ok
    row = parse.parse_replies(
        spark.createDataFrame([('{"theme_category": ["a"], "sentiment": "neutral"}',)], "raw string"), THEME_REPLY
    ).first()
    assert row.themes_category == ["a"] and row.sentiment == "neutral"


@pytest.mark.parametrize(
    "label, plain",
    [("promotor", "promoter"), ("Promoter ", "promoter"), ("non-promotor", "non-promoter"), ("Mixed", "mixed"), (None, None)],
)
def test_sentiment_spelling(spark, label, plain):
    df = spark.createDataFrame([(label,)], "s string")
    assert df.select(parse.plain_sentiment(F.col("s"))).first()[0] == plain


def test_stand_in_knows_its_tasks():
    with pytest.raises(ValueError, match="no rule"):
        StandIn().reply("Task: something else")
    assert StandIn().reply("Task: answer feedback.\n<feedback>\na b\n</feedback>") == "Thank you for 2 words"


def test_json_is_read_once_per_reply(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    plan = parse.accepted(parse.parse_replies(df, ANALYSIS_REPLY))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_classify_asks_once_for_each_comment(spark, retry):
    sent = spark.sparkContext.accumulator(0)

    class Counting(StandIn):
        def generate(self, prompts):
            sent.add(len(prompts))
            return super().generate(prompts)

    comments = spark.createDataFrame([(i, f"the text {i}") for i in range(20)], "k int, text string")
    taxonomy = spark.createDataFrame([("the",)], "theme string")
    got = classify(comments, "k", "text", taxonomy, F.lit("the"), Counting, retry=retry).collect()
    assert len(got) == 20 and sent.value == 20
    assert all(r.themes_category == ["the"] and r.rejected == ["Something else"] for r in got)


def test_errors_that_stay_are_not_tried_again(retry):
    class Broken:
        calls = 0

        def generate(self, prompts):
            Broken.calls += 1
            raise TypeError("no such argument")

    answers = ask(Broken(), ["a", "b"], retry)
    assert [(a.error, a.attempts, a.permanent) for a in answers] == [("TypeError: no such argument", 1, True)] * 2
    assert Broken.calls == 3  # together, then each alone

    class Refusing:
        def generate(self, prompts):
            if "bad" in prompts:
                raise Permanent("refused")
            return list(prompts)

    assert [(a.raw, a.permanent) for a in ask(Refusing(), ["a", "bad"], Retry(5, 0))] == [("a", False), (None, True)]


class Logged:
    """Writes down what it is asked, in files that outlive the task; fails for good after ``most`` prompts of a run."""

    def __init__(self, folder, most=None):
        self.folder, self.most = folder, most

    def generate(self, prompts):
        asked = len(glob.glob(f"{self.folder}/*"))
        if self.most is not None and asked >= self.most:
            os._exit(1)  # the worker dies, and so does the job
        for p in prompts:
            open(f"{self.folder}/{uuid.uuid4().hex}-{p}", "w").close()
        if "bad" in prompts:
            raise Permanent("refused")
        if "busy" in prompts:
            raise TimeoutError("busy")
        return [p.upper() for p in prompts]


def test_killed_job_asks_only_for_what_is_missing(spark, tmp_path, retry):
    asked, path = str(tmp_path / "asked"), str(tmp_path / "answers")
    os.mkdir(asked)
    df = spark.createDataFrame([(i, f"p{i % 40}") for i in range(120)] + [(200, None)], "id int, prompt string")
    calls = {"retry": retry, "batch_size": 1, "commit_prompts": 4, "max_concurrency": 1}
    with pytest.raises(Exception):
        durable_inference(df, lambda: Logged(asked, most=14), path, **calls)
    committed = answers_in(spark, path).count()
    before = len(os.listdir(asked))
    assert 8 <= committed <= 14 and before >= 14
    got = durable_inference(df, lambda: Logged(asked), path, **calls).collect()
    assert {r.id: r.raw for r in got} == {**{i: f"P{i % 40}" for i in range(120)}, 200: None}
    assert len(os.listdir(asked)) == before + 40 - committed
    again = durable_inference(df, lambda: Logged(asked), path, keep_prompt=True, **calls)
    assert again.columns == ["id", "prompt", "raw", "error", "attempts", "latency_s"] and again.count() == 121
    assert len(os.listdir(asked)) == before + 40 - committed


def test_killed_job_of_many_tasks_keeps_what_they_committed(spark, tmp_path, retry):
    asked, path = str(tmp_path / "asked"), str(tmp_path / "answers")
    os.mkdir(asked)
    df = spark.range(60).selectExpr("id", "concat('p', id) as prompt")
    calls = {"retry": retry, "batch_size": 1, "commit_prompts": 8}
    with pytest.raises(Exception):
        durable_inference(df, lambda: Logged(asked, most=40), path, **calls)
    committed, before = answers_in(spark, path).count(), len(os.listdir(asked))
    assert 24 <= committed <= before < 60
    got = durable_inference(df, lambda: Logged(asked), path, **calls).collect()
    assert {r.id: r.raw for r in got} == {i: f"P{i}" for i in range(60)}
    assert len(os.listdir(asked)) == before + 60 - committed
    # one Spark job each, not one for every few prompts
    assert [os.listdir(run) for run in glob.glob(f"{path}/*")] == [["batch=0"]] * 2


def test_errors_in_the_durable_table(spark, tmp_path, retry):
    asked, path = str(tmp_path / "asked"), str(tmp_path / "answers")
    os.mkdir(asked)
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "busy")], "id int, prompt string")
    want = {1: ("GOOD", None), 2: (None, "Permanent: refused"), 3: (None, "TimeoutError: busy")}
    for _ in range(2):
        got = durable_inference(df, lambda: Logged(asked), path, retry=retry, batch_size=1)
        assert {r.id: (r.raw, r.error) for r in got.collect()} == want
    names = [n.rpartition("-")[2] for n in os.listdir(asked)]
    # what stays is asked once, what ran out of attempts again
    assert (names.count("good"), names.count("bad"), names.count("busy")) == (1, 1, 2 * retry.max_attempts)


def test_phrases(spark, rows):
    comments = spark.createDataFrame(
        [(1, "Late  DELIVERY, again."), (2, "late\ndelivery-man"), (3, "latest delivery"), (4, None), (5, ""), (6, "Straße: späte Lieferung!"), (7, "late. late delivery"), (1, "nothing")],
        "doc bigint, c string",
    )
    phrases = spark.createDataFrame(
        [("Delivery", "late delivery"), ("Delivery", "Delivery,man"), ("People", "man"), ("German", "SPÄTE lieferung"), ("Never", "--"), ("Never", None)], "theme string, phrase string"
    )
    got = sorted(((r.doc, r.themes) for r in tag_by_phrase(comments, "doc", "c", phrases).collect()), key=repr)
    assert got == sorted([(1, ["Delivery"]), (1, []), (2, ["Delivery", "People"]), (3, []), (4, []), (5, []), (6, ["German"]), (7, ["Delivery"])], key=repr)
    assert tag_by_phrase(comments, "doc", "c", phrases.limit(0)).filter("size(themes) > 0").count() == 0


def test_few_phrases_do_not_make_the_runs_of_words_shuffle(spark, monkeypatch):
    comments = spark.range(50).selectExpr("id", "repeat('late delivery of the goods ', 40) as c")
    phrases = spark.createDataFrame([("Delivery", "late delivery"), ("Goods", "The goods"), ("Never", "late goods")], "theme string, phrase string")
    tagged = tag_by_phrase(comments, "id", "c", phrases)
    assert [tuple(r.themes) for r in tagged.collect()] == [("Delivery", "Goods")] * 50
    # as planned, before any stage has run
    plan = tag_by_phrase(comments, "id", "c", phrases)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(themes, "MOST_FIRST_WORDS", 1)  # now all runs go to the join
    assert [tuple(r.themes) for r in tag_by_phrase(comments, "id", "c", phrases).collect()] == [("Delivery", "Goods")] * 50
