"""Batches from files: what is damaged is told, nothing is lost."""

import json

import pytest

from rejoinder.operators import flatten
from rejoinder.sources import batches

GOOD = {"Core Prompt": "be kind", "Context Prompt": None, "Feedback Data": [{"ID": 1, "Review": {"Text": "fine"}, "Customer": {"Name": "Ann"}, "Surveys": []}]}


def with_entries(*entries):
    return json.dumps({**GOOD, "Feedback Data": list(entries)})


def test_files_keep_their_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(GOOD)[:-10])
    (tmp_path / "c.json").write_text("")
    read = batches.read_batches(spark, str(tmp_path))
    got = {r.file.rpartition("/")[2]: (r.batch, r["Core Prompt"], r["Feedback Data"]) for r in read.collect()}
    assert got["a.json"][0] == json.dumps(GOOD, indent=2) and got["a.json"][1] == "be kind" and got["a.json"][2][0].ID == "1"
    assert got["b.json"] == (json.dumps(GOOD)[:-10], None, None)
    rejects = {r.file.rpartition("/")[2]: r.reason for r in batches.batch_rejects(read, "batch").collect()}
    assert rejects["b.json"] == "broken_json" and rejects.get("c.json", "empty") == "empty" and "a.json" not in rejects


def test_lines(spark, tmp_path):
    (tmp_path / "lines").write_text("\n".join([json.dumps(GOOD), "", json.dumps(GOOD)[:20], json.dumps(GOOD)]))
    read = batches.read_batches(spark, str(tmp_path / "lines"), one_per_file=False, id_type="bigint")
    assert [r.feedback_id for r in flatten.flatten_feedback(read).collect()] == [1, 1]
    assert [r.reason for r in batches.batch_rejects(read, "batch").collect()] == ["broken_json"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [(json.dumps(GOOD), None), (" \n" + json.dumps(GOOD) + "\n ", None), (json.dumps(GOOD) + " x", "broken_json"), (json.dumps(GOOD) + "{}", "broken_json"),
     (json.dumps(GOOD) + ", {}", "broken_json"), (json.dumps(GOOD) + "], [1", "broken_json"), (json.dumps(GOOD) + "} x", "broken_json"),
     (json.dumps(GOOD) + ', "c": 1', "broken_json"), (json.dumps(GOOD)[:-1], "broken_json"), (None, "empty"), ("  ", "empty"), ("[1]", "no_feedback_list"),
     ("plain", "broken_json"), ('"text"', "no_feedback_list"), ("{}", "no_feedback_list"), ('{"Feedback Data": {"ID": 1}}', "no_feedback_list"),
     ('{"Feedback Data": null}', "no_feedback_list"), ('{"Feedback Data": []}', None)],
)
def test_texts_that_are_no_batch(spark, text, reason):
    df = spark.createDataFrame([("s", text)], "session_id string, batch string")
    assert [r.reason for r in batches.batch_rejects(df, "batch").collect()] == ([reason] if reason else [])
    parsed = batches.parse_batches(df, "batch", keep=True).first()
    assert (parsed["Feedback Data"] is None) == (reason is not None) and parsed.batch == text


def test_entries_that_are_no_feedback(spark):
    fine = lambda i: {"ID": i, "Review": {"Text": "t"}}
    given = [
        fine(1), {"ID": 2, "Review": "plain text"}, "lost", None, 5, [fine(6)], {"Review": {"Text": "t"}}, {"ID": None, "Review": {"Text": "t"}},
        {"ID": {"n": 1}, "Review": {"Text": "t"}}, {"ID": 9}, {"ID": 10, "Review": {}}, {"ID": 11, "Review": {"Text": ["t"]}}, {"ID": 12, "Review": {"Text": None}},
        {**fine(13), "Surveys": "none"}, {**fine(14), "Surveys": None}, fine("A-15"), fine("16"), fine(1.5), fine(True), {**fine(19), "Surveys": [{"Questions": [{"b": 1, "a": 2}]}]},
    ]
    df = spark.createDataFrame([("s", with_entries(*given), 7)], "session_id string, batch string, other int")
    rows = flatten.flatten_feedback(batches.parse_batches(df, "batch")).collect()
    assert {r.pos: r.feedback_id for r in rows} == {0: "1", 12: "12", 14: "14", 15: "A-15", 16: "16", 17: "1.5", 18: "true", 19: "19"}
    assert {r.pos: r.surveys for r in rows}[19][0].Questions == '[{"b":1,"a":2}]'
    rejects = batches.entry_rejects(df, "batch").collect()
    assert {r.pos: r.reason for r in rejects} == {
        1: "review_is_no_object", 2: "not_an_object", 3: "not_an_object", 4: "not_an_object", 5: "not_an_object", 6: "no_id", 7: "no_id", 8: "no_id",
        9: "review_is_no_object", 10: "no_text", 11: "no_text", 13: "surveys_are_no_list",
    }
    assert {(r.session_id, r.other) for r in rejects} == {("s", 7)}
    assert {r.pos: r.entry for r in rejects}[1] == '{"ID":2,"Review":"plain text"}'
    assert len(rows) + len(rejects) == len(given)
    as_numbers = flatten.flatten_feedback(batches.parse_batches(df, "batch", id_type="bigint")).collect()
    assert {r.pos: r.feedback_id for r in as_numbers if r.pos in (0, 15, 16)} == {0: 1, 15: None, 16: 16}


def test_pairing_leaves_out_what_is_no_feedback(spark):
    survey = {"Questions": ["q"]}
    text = with_entries({"ID": 1, "Review": {"Text": "a"}, "Surveys": [survey]}, "lost", {"ID": 3, "Review": {"Text": "c"}, "Surveys": [survey]})
    parsed = batches.parse_batches(spark.createDataFrame([("s", text)], "session_id string, batch string"), "batch")
    pairs = flatten.pair_by_position(parsed).collect()
    assert [(r.feedback_id, r.review_text) for r in pairs] == [("1", "a"), ("3", "c")]
    assert [(r.pos, r.feedback_id) for r in flatten.flatten_surveys(parsed).collect()] == [(0, "1"), (2, "3")]
