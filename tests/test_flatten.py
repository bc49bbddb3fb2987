import json

import pytest
from pyspark.sql import functions as F

from rejoinder.operators import flatten, themes
from rejoinder.sources.batches import batch_rejects, parse_batches, read_batches
from rejoinder.sources.taxonomy import read_taxonomy


def questions(*scores):
    return {"Questions": [{"q": f"q{i}", "score": s} for i, s in enumerate(scores)]}


def feedback(id, text="t", name="N", surveys=None):
    out = {"ID": id, "Review": {"Text": text}, "Customer": {} if name is None else {"Name": name}}
    if surveys is not None:
        out["Surveys"] = surveys
    return out


@pytest.fixture
def batches(spark):
    batch = {
        "Core Prompt": "core",
        "Context Prompt": "before Context details: after",
        "Feedback Data": [
            feedback(1, surveys=[questions(1), questions(2, 3)]),
            feedback(2, name=None),
            feedback(3, surveys=[]),
            feedback(4, surveys=[questions(4)]),
        ],
    }
    empty = {"Core Prompt": "c", "Context Prompt": "none", "Feedback Data": []}
    data = [("a", json.dumps(batch)), ("b", json.dumps(empty))]
    return parse_batches(spark.createDataFrame(data, "session_id string, j string"), "j", id_type="bigint")


def test_flatten(batches):
    got = {r.feedback_id: r for r in flatten.flatten_feedback(batches).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[i].pos for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert got[2].customer_name is None and got[1].customer_name == "N"
    assert (got[1].context_first, got[1].context_last) == ("before ", " after")
    assert len(got[1].surveys) == 2 and got[2].surveys is None and got[3].surveys == []


def test_empty_batch_can_be_kept(batches):
    kept = flatten.flatten_feedback(batches, keep_empty=True)
    assert kept.filter("session_id = 'b' and feedback_id is null").count() == 1


def test_surveys(batches, rows):
    flat = flatten.flatten_feedback(batches)
    first = flat.select("feedback_id", flatten.first_survey(F.col("surveys")).alias("q"))
    assert dict(rows(first)) == {1: '[{"q":"q0","score":1}]', 2: None, 3: None, 4: '[{"q":"q0","score":4}]'}
    own = flat.select("feedback_id", flatten.own_surveys(F.col("surveys")).alias("q"))
    assert dict(rows(own))[1] == '[{"q":"q0","score":1},{"q":"q0","score":2},{"q":"q1","score":3}]'
    assert dict(rows(own))[2] == "[]"
    places = rows(flatten.flatten_surveys(batches), "feedback_id", "pos", "survey_pos")
    assert places == [(1, 0, 0), (1, 0, 1), (4, 3, 0)]


def test_pairs_by_position_cut_to_the_shorter_list(batches):
    got = {r.pos: (r.feedback_id, [q["score"] for q in json.loads(r.questions)]) for r in flatten.pair_by_position(batches).collect()}
    # three surveys in the batch, so the fourth review is lost and the second gets a survey of the first
    assert got == {0: (1, [1]), 1: (2, [2, 3]), 2: (3, [4])}


def test_missing_name_label(spark, rows):
    df = spark.createDataFrame([(None,), ("x",)], "n string")
    assert rows(df.select(flatten.customer_name(F.col("n"), "None"))) == [("None",), ("x",)]


@pytest.mark.parametrize(
    "text, first, last",
    [
        ("no marker", "no marker", "no marker"),
        ("aContext details:b", "a", "b"),
        ("aContext details:bContext details:c", "a", "c"),
        ("Context details:", "", ""),
    ],
)
def test_context(spark, text, first, last):
    got = flatten.split_context(spark.createDataFrame([(text,)], "p string"), "p").first()
    assert (got.context_first, got.context_last) == (first, last)


def test_nonempty(spark, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, " x ")], "id int, t string")
    assert rows(flatten.nonempty(df, "t"), "id") == [(4,)]
    assert rows(flatten.nonempty(df, "t", strict=False), "id") == [(3,), (4,)]


def test_read_batches_gives_each_batch_an_id(spark, tmp_path):
    for i in range(2):
        body = {"Core Prompt": "c", "Context Prompt": "x", "Feedback Data": [feedback(i)]}
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
    ids = [r.session_id for r in read_batches(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 32 for i in ids)


def test_taxonomy_files(spark, tmp_path, rows):
    (tmp_path / "commas").write_text(" Design ,\n Sales, Sales,,\n")
    (tmp_path / "lines").write_text("Design, Sales\n\n Paint \n")
    assert rows(read_taxonomy(spark, str(tmp_path / "commas"))) == [("Design",), ("Sales",)]
    assert rows(read_taxonomy(spark, str(tmp_path / "lines"), commas=False)) == [("Design, Sales",), ("Paint",)]


def test_check_labels(spark, rows):
    df = spark.createDataFrame([(1, ["b", "a", "x", "a"]), (2, []), (3, None)], "k int, labels array<string>")
    taxonomy = spark.createDataFrame([("a",), ("b",), ("b",)], "theme string")
    got = rows(themes.check_labels(df, "labels", taxonomy), "k", "labels", "rejected")
    assert got == [(1, ["a", "b"], ["x"]), (2, [], []), (3, [], [])]


def test_questions_of_any_shape_are_kept(spark):
    batch = {"Feedback Data": [feedback(1, surveys=[{"Questions": [{"Question": "How?", "Answer": "Bad, [really]", "Rating": 4.5}]}, {"Questions": {"a": [1, 2]}}, {"Questions": []}])]}
    rows = flatten.flatten_feedback(parse_batches(spark.createDataFrame([("s", json.dumps({"Core Prompt": "c", "Context Prompt": "x", **batch}))], "session_id string, j string"), "j"))
    own, first = rows.select(flatten.own_surveys(F.col("surveys")), flatten.first_survey(F.col("surveys"))).first()
    assert json.loads(own) == [{"Question": "How?", "Answer": "Bad, [really]", "Rating": 4.5}, {"a": [1, 2]}]
    assert json.loads(first) == [{"Question": "How?", "Answer": "Bad, [really]", "Rating": 4.5}]


def test_broken_batches_are_found(spark):
    data = [("ok", '{"Feedback Data": []}'), ("cut", '{"Feedback Data": [{"ID"'), ("other", '{"x": 1}'), ("none", None)]
    assert sorted(r.k for r in batch_rejects(spark.createDataFrame(data, "k string, j string"), "j").collect()) == ["cut", "none", "other"]


def test_feedback_of_no_break_spaces_is_empty(spark):
    df = spark.createDataFrame([("\u00a0 \u2003",), ("a",), ("",), (None,)], "t string")
    assert [r.t for r in flatten.nonempty(df, "t").collect()] == ["a"]


def test_labels_of_equal_keys_stay_apart(spark, rows):
    df = spark.createDataFrame([(1, ["a"]), (1, ["z"])], "k int, labels array<string>")
    taxonomy = spark.createDataFrame([("a",)], "theme string")
    assert rows(themes.check_labels(df, "labels", taxonomy)) == [(1, ["a"], []), (1, [], ["z"])]
