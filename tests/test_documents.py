import json

import pytest
from pyspark.sql import functions as F

from rejoinder.plans import store
from rejoinder.testing.stand_in import stand_in
from rejoinder.operators import revise, rollup
from rejoinder.operators.lookups import match_revisions, survey_lookup
from rejoinder.schemas import RESPONSE, TONE_KEYS
from rejoinder.sources import documents


@pytest.fixture
def responses(spark):
    data = [
        (f"s{s}", p, f"reply {s}.{p}", "hi", "prof", "short", "sum", "promoter", ["a"], [], p)
        for s in range(5)
        for p in range(s + 1)
    ]
    names = ["session_id", "pos", *RESPONSE.fieldNames()]
    return spark.createDataFrame(
        data,
        "session_id string, pos bigint, "
        + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESPONSE.fields),
    ).select(*names)


def overview_of(responses):
    summary = responses.groupBy("session_id").agg(F.lit("all fine").alias("summary"))
    return rollup.overview(responses, summary)


@pytest.mark.parametrize("part_rows", [1000, 2])
def test_round_trip(spark, tmp_path, rows, responses, part_rows):
    path = str(tmp_path / "docs")
    built = documents.build_documents(responses, overview_of(responses), part_rows)
    documents.write_documents(built, path, buckets=4)
    stored = documents.read_documents(spark, path)
    assert rows(documents.expand_responses(stored, "bigint"), *responses.columns) == rows(responses)
    assert stored.count() == sum(-(-(s + 1) // part_rows) for s in range(5))
    assert {r.Summary for r in documents.stored_overviews(stored).collect()} == {"all fine"}


def test_document_text(responses):
    built = documents.build_documents(responses, overview_of(responses)).filter("session_id = 's1'").first()
    body = json.loads(built.document)
    assert list(body) == ["Overview", "Responses", "session_id"] and body["session_id"] == "s1"
    assert body["Overview"] == {"Summary": "all fine", "Sentiment": "promoter", "Positive_Themes": ["a"], "Negative_Themes": []}
    assert [r["feedback_id"] for r in body["Responses"]] == [0, 1]


def test_one_session_opens_one_bucket(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    documents.write_documents(documents.build_documents(responses), path, buckets=4)
    one = documents.read_documents(spark, path, "s3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,s3)" in plan
    assert len(one.inputFiles()) == 1 and len(documents.read_documents(spark, path).inputFiles()) > 1
    assert [r.session_id for r in one.collect()] == ["s3"]
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1


REQUEST = "request_id bigint, session_id string, feedback_id bigint, modifications string, modification_key string"


def test_match(spark, responses):
    again = responses.filter("session_id = 's1' and pos = 0").withColumn("pos", F.lit(9)).withColumn("Default", F.lit("later"))
    requests = spark.createDataFrame(
        [(1, "s1", 0, "x", "Default"), (2, "s1", 99, "x", "Default"), (3, "s1", 0, "x", "Nothing"), (4, "no", 0, "x", "Default")],
        REQUEST,
    )
    got = {r.request_id: (r.status, r.reason, r.stored_text) for r in match_revisions(requests, responses.unionByName(again), TONE_KEYS).collect()}
    assert got == {
        1: (200, None, "reply 1.0"),
        2: (404, "no_such_feedback", None),
        3: (404, "no_such_field", None),
        4: (404, "no_such_feedback", None),
    }


def test_revisions_follow_each_other_and_reach_the_store(spark, tmp_path, rows, responses, retry):
    path = str(tmp_path / "docs")
    documents.write_documents(documents.build_documents(responses), path, buckets=4)
    before = {r[0]: r[1] for r in documents.read_documents(spark, path).select("session_id", "document").collect()}
    requests = spark.createDataFrame(
        [
            (3, "s2", 1, "third", "Default"),
            (1, "s2", 1, "first", "Default"),
            (2, "s2", 1, "other", "More_friendly"),
            (4, "s4", 4, "new", "More_Concise"),
            (5, "s4", 77, "lost", "Default"),
        ],
        REQUEST,
    )
    stored = documents.expand_responses(documents.read_documents(spark, path))
    revised = revise.revise(requests, stored, stand_in, retry=retry)
    got = {r.request_id: (r.status, r.revised_text) for r in revised.collect()}
    assert got == {
        1: (200, "reply 2.1 [first]"),
        2: (200, "hi [other]"),
        3: (200, "reply 2.1 [first] [third]"),
        4: (200, "short [new]"),
        5: (404, None),
    }
    documents.replace_documents(spark, path, documents.revise_documents(documents.read_documents(spark, path), revised))
    after = documents.read_documents(spark, path)
    texts = {(r.session_id, r.pos): (r.Default, r.More_friendly, r.More_Concise) for r in documents.expand_responses(after).collect()}
    assert texts["s2", 1] == ("reply 2.1 [first] [third]", "hi [other]", "short")
    assert texts["s4", 4] == ("reply 4.4", "hi", "short [new]")
    assert len(texts) == 15
    now = {r[0]: r[1] for r in after.select("session_id", "document").collect()}
    assert {s for s in now if now[s] != before[s]} == {"s2", "s4"}


def test_revision_keeps_overview_and_unknown_keys(spark, tmp_path, responses, retry):
    path = str(tmp_path / "docs")
    more = responses.withColumn("Signature", F.lit("é, the team")).withColumn("Stars", F.lit(4))
    built = documents.build_documents(more, overview_of(responses), part_rows=2)
    documents.write_documents(built, path, buckets=4)
    whole = documents.read_documents(spark, path)
    requests = spark.createDataFrame([(1, "s4", 3, "warm", "Signature"), (2, "s4", 3, "x", "feedback_id")], REQUEST)
    revised = revise.revise(requests, documents.expand_responses(whole), stand_in, retry=retry)
    before = {(r.session_id, r.part): json.loads(r.document) for r in whole.collect()}
    documents.replace_documents(spark, path, documents.revise_documents(whole, revised))
    after = {(r.session_id, r.part): json.loads(r.document) for r in documents.read_documents(spark, path).collect()}
    before["s4", 1]["Responses"][1]["Signature"] = "é, the team [warm]"
    assert after == before
    assert before["s4", 0]["Overview"]["Summary"] == "all fine" and before["s4", 1]["Responses"][1]["Stars"] == 4


def test_one_answer_documents_keep_the_reply(spark):
    rows = spark.createDataFrame([("s", 0, 7, "the reply", "sum", [], "raw", None)], "session_id string, pos bigint, feedback_id bigint, Response string, Summary string, Positive_Themes array<string>, raw string, error string")
    body = json.loads(documents.build_documents(rows).first().document)
    assert body["Responses"] == [{"feedback_id": 7, "Response": "the reply", "Summary": "sum", "Positive_Themes": []}]


def test_parts_of_another_size_are_refused(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    documents.write_documents(documents.build_documents(responses, part_rows=2), path, buckets=4)
    with pytest.raises(ValueError, match="another size"):
        documents.replace_documents(spark, path, documents.build_documents(responses, part_rows=3))


def test_only_touched_buckets_are_written(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    first = documents.write_documents(documents.build_documents(responses), path, buckets=16)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "docs" / "data").rglob("*.parquet")}
    second = documents.replace_documents(spark, path, documents.build_documents(responses.filter("session_id = 's2'")))
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())
    assert (second.number, second.buckets) == (2, 16)
    assert len({b for b in second.folders if second.folders[b] != first.folders.get(b)}) == 1
    assert documents.read_documents(spark, path).count() == 5
    with pytest.raises(ValueError, match="there are documents"):
        documents.write_documents(documents.build_documents(responses), path)


def revised_rows(spark, rows):
    return spark.createDataFrame(
        [(i, s, f, 200, k, x) for i, s, f, k, x in rows],
        "request_id bigint, session_id string, feedback_id string, status int, modification_key string, revised_text string",
    )


def texts_of(spark, path, at=None):
    return {(r.session_id, r.feedback_id): (r.Default, r.More_friendly) for r in documents.expand_responses(documents.read_documents(spark, path, at=at)).collect()}


def test_revision_finds_its_reply_by_id_though_replies_were_rejected(spark, tmp_path, retry):
    path = str(tmp_path / "docs")
    accepted = spark.createDataFrame(
        [("s", 0, "11", "a", "x"), ("s", 2, "12", "b", "x"), ("s", 3, "13", "c", "x"), ("s", 5, "12", "second of its id", "x"), ("s", 6, "A-7", "d", "x")],
        "session_id string, pos bigint, feedback_id string, Default string, More_friendly string",
    )
    documents.write_documents(documents.build_documents(accepted, part_rows=2), path, buckets=2)
    requests = spark.createDataFrame([(1, "s", "12", "warm", "Default"), (2, "s", "A-7", "cold", "Default"), (3, "s", "99", "x", "Default")], REQUEST.replace("feedback_id bigint", "feedback_id string"))
    # places of the batch, rejected replies counted
    revised = revise.revise(requests, accepted, stand_in, retry=retry, fields=["Default"])
    documents.revise_stored(spark, path, revised)
    stored = documents.expand_responses(documents.read_documents(spark, path)).orderBy("pos").collect()
    assert [(r.feedback_id, r.Default) for r in stored] == [("11", "a"), ("12", "b [warm]"), ("13", "c"), ("12", "second of its id"), ("A-7", "d [cold]")]


def test_revision_without_a_reply_touches_nothing(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    documents.write_documents(documents.build_documents(responses), path, buckets=4)
    revised = revised_rows(spark, [(1, "s1", "77", "Default", "lost"), (2, "nobody", "1", "Default", "lost"), (3, "s1", "1", "Default", "found")])
    placed = documents.place_revisions(documents.read_documents(spark, path), revised)
    assert {(r.session_id, r.id, r.status, r.place) for r in placed.collect()} == {("s1", "77", 404, None), ("nobody", "1", 404, None), ("s1", "1", 200, 1)}
    before = texts_of(spark, path)
    assert documents.revise_stored(spark, path, revised.filter("request_id < 3")).number == 1
    documents.revise_stored(spark, path, revised)
    assert {k for k, v in texts_of(spark, path).items() if v != before[k]} == {("s1", "1")}


def test_two_writers_from_one_version(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    at = documents.write_documents(documents.build_documents(responses), path, buckets=1)
    whole = documents.read_documents(spark, path, at=at)
    ours = revised_rows(spark, [(1, "s2", "1", "Default", "ours")])
    documents.revise_stored(spark, path, revised_rows(spark, [(2, "s2", "1", "More_friendly", "theirs"), (3, "s3", "0", "Default", "theirs")]))
    with pytest.raises(documents.Conflict):
        documents.replace_documents(spark, path, documents.revise_documents(whole, ours), at)
    assert documents.versions(spark, path) == [1, 2]
    documents.revise_stored(spark, path, ours)
    after = texts_of(spark, path)
    assert (after["s2", "1"], after["s3", "0"][0]) == (("ours", "theirs"), "theirs")
    # the first version is still there to be read
    assert texts_of(spark, path, documents.version(spark, path, 1))["s2", "1"] == ("reply 2.1", "hi")


def test_writers_of_different_buckets_do_not_meet(spark, tmp_path, responses):
    path = str(tmp_path / "docs")
    at = documents.write_documents(documents.build_documents(responses), path, buckets=64)
    whole = documents.read_documents(spark, path, at=at)
    one, other = (documents.revise_documents(whole, revised_rows(spark, [(1, s, "0", "Default", "new")])) for s in ("s1", "s4"))
    assert len(set(at.folders)) == 5  # one bucket each
    documents.replace_documents(spark, path, one, at)
    assert documents.replace_documents(spark, path, other, at).number == 3
    after = texts_of(spark, path)
    assert {k for k, v in after.items() if v[0] == "new"} == {("s1", "0"), ("s4", "0")}


def test_killed_write_leaves_the_version_before(spark, tmp_path, responses, monkeypatch):
    path = str(tmp_path / "docs")
    documents.write_documents(documents.build_documents(responses), path, buckets=4)
    before = texts_of(spark, path)

    def killed(*_):
        raise KeyboardInterrupt

    change = revised_rows(spark, [(1, "s2", "1", "Default", "new")])
    with monkeypatch.context() as patch:
        patch.setattr(documents, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            documents.revise_stored(spark, path, change)
    assert texts_of(spark, path) == before and documents.versions(spark, path) == [1]
    documents.revise_stored(spark, path, change)
    documents.remove_old(spark, path, keep=1)
    assert documents.versions(spark, path) == [2] and texts_of(spark, path)["s2", "1"][0] == "new"
    used = {f.split("/")[0] for f in documents.version(spark, path).folders.values()}
    assert {f.name for f in (tmp_path / "docs" / "data").iterdir()} == used


def test_commit_is_for_one_writer_only(spark, tmp_path):
    path = str(tmp_path / "one" / "1.json")
    assert store.commit_text(spark, path, "first é") and not store.commit_text(spark, path, "second")
    assert store.read_text(spark, path) == "first é" and store.names(spark, str(tmp_path / "one")) in (["1.json"], [".1.json.crc", "1.json"])
    assert store.names(spark, str(tmp_path / "none")) == []


def test_failing_model_gives_500(spark, responses, retry):
    class Down:
        def generate(self, prompts):
            raise OSError("down")

    requests = spark.createDataFrame([(1, "s0", 0, "x", "Default")], REQUEST)
    row = revise.revise(requests, responses, Down, retry=retry).first()
    assert (row.status, row.reason, row.revised_text) == (500, "OSError: down", None)


def test_survey_lookup(spark):
    master = spark.createDataFrame(
        [(1, "late", "L", 1, 5), (1, "early", "E", 5, 2), (2, None, None, None, 3)],
        "survey_id bigint, contact string, review_text string, review_rating int, pos bigint",
    )
    requests = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "c"), ("x", "c"), (None, "c")], "survey_id string, comment string")
    got = {r.survey_id: (r.contact, r.review_rating, r.comment_with_review) for r in survey_lookup(requests, master).collect()}
    assert got == {
        "1": ("early", 5, "cE"),
        "2": (None, None, "cNone"),
        "3": (None, None, "cNone"),
        "x": (None, None, "cNone"),
        None: (None, None, "cNone"),
    }
