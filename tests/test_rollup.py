import json
import random

import pytest
from pyspark.sql import functions as F

from rejoinder.testing.stand_in import stand_in
from rejoinder.functions.model import Permanent
from rejoinder.operators import rollup

RESPONSE = "session_id string, pos bigint, feedback_id bigint, Default string, Sentiment string, Positive_Themes array<string>, Negative_Themes array<string>"


def responses(spark, data):
    return spark.createDataFrame(data, RESPONSE)


def test_sentiments(spark):
    data = [
        ("tie", 0, 1, "d", "promoter", None, None),
        ("tie", 1, 2, "d", "non-promoter", None, None),
        ("most", 0, 3, "d", "a", None, None),
        ("most", 1, 4, "d", "a", None, None),
        ("most", 2, 5, "d", "z", None, None),
        ("one", 0, 6, "d", "promoter", None, None),
        ("one", 1, 7, "d", None, None, None),
        ("none", 0, 8, "d", None, None, None),
    ]
    got = {r.session_id: tuple(r)[1:] for r in rollup.sentiment_overview(responses(spark, data)).collect()}
    assert got == {
        "tie": ("promoter", 2, True, 2),
        "most": ("a", 2, True, 3),
        "one": ("promoter", 1, False, 2),
        "none": (None, 0, True, 1),
    }


def test_themes(spark):
    data = [
        ("s", 0, 1, "d", None, ["b", "a"], []),
        ("s", 1, 2, "d", None, ["a", "a"], ["x"]),
        ("t", 0, 3, "d", None, None, None),
    ]
    df = responses(spark, data)
    got = {r.session_id: tuple(r)[1:] for r in rollup.themes_overview(df).collect()}
    assert got == {"s": (0, ["a", "b"], ["x"]), "t": (0, [], [])}
    counts = {(r.kind, r.theme): r.n for r in rollup.theme_rows(df).collect()}
    assert counts == {("positive", "a"): 2, ("positive", "b"): 1, ("negative", "x"): 1}


def test_very_many_themes_come_in_parts(spark):
    data = [("s", i, i, "d", None, [f"t{i}"], []) for i in range(500)] + [("u", 0, 0, "d", None, ["t"], ["n"])]
    got = rollup.themes_overview(responses(spark, data), part_rows=50).collect()
    parts = [r for r in got if r.session_id == "s"]
    assert len(parts) > 3
    assert sorted(t for r in parts for t in r.positive_themes) == sorted(f"t{i}" for i in range(500))
    assert [r.negative_themes for r in got if r.session_id == "u"] == [["n"]]


def test_review_lists_in_order_and_in_parts(spark):
    data = [("s", i, i, f"r{i}", None, None, None) for i in random.Random(1).sample(range(25), 25)]
    df = responses(spark, data).repartition(4)
    whole = rollup.review_lists(df, "Default").first()
    assert whole["items"] == [f"r{i}" for i in range(25)] and whole.reviews == 25
    parts = sorted(rollup.review_lists(df, "Default", part_rows=10).collect(), key=lambda r: r.part)
    assert [r.reviews for r in parts] == [10, 10, 5]
    assert [x for r in parts for x in r["items"]] == whole["items"]


@pytest.mark.parametrize("budget, block", [(1, 2), (50, 3), (200, 8), (10_000, 1000)])
def test_summary_covers_every_reply_whatever_the_tree(spark, retry, budget, block):
    rng = random.Random(3)
    data, want = [], {}
    for session, n in (("big", 90), ("two", 2), ("one", 1)):
        words = 0
        for i in range(n):
            text = " ".join(["w"] * rng.randint(1, 30))
            words += len(text.split())
            data.append((session, i, i, text, None, None, None))
        want[session] = (f"{n} texts with {words} words.", n, False)
    df = responses(spark, data).repartition(5)
    got = rollup.consolidated_summary(df, "Default", stand_in, budget=budget, block_rows=block, retry=retry)
    assert {r.session_id: (r.summary, r.reviews, r.failed) for r in got.collect()} == want


def test_summary_does_not_depend_on_partitions(spark, retry):
    class Tree:
        """Shows how the texts were put together."""

        def generate(self, prompts):
            import json

            out = []
            for p in prompts:
                items = json.loads(p.split("<texts>\n")[1].split("\n</texts>")[0])
                out.append("(" + " ".join(items) + ")")
            return out

    data = [("s", i, i, f"r{i}", None, None, None) for i in range(40)]
    results = set()
    for n in (1, 3, 7):
        df = responses(spark, data).repartition(n)
        got = rollup.consolidated_summary(df, "Default", Tree, budget=12, block_rows=6, retry=retry).first().summary
        assert got.replace("(", "").replace(")", "").split() == [f"r{i}" for i in range(40)]
        results.add(got)
    assert len(results) == 1


def test_summary_of_nothing(spark, retry):
    assert rollup.consolidated_summary(responses(spark, []), "Default", stand_in, retry=retry).count() == 0


def test_failed_summary_is_marked(spark, retry):
    class Down:
        def generate(self, prompts):
            raise OSError("down")

    df = responses(spark, [("s", 0, 0, "a", None, None, None)])
    row = rollup.consolidated_summary(df, "Default", Down, retry=retry).first()
    assert row.failed and row.summary == "" and row.reviews == 1


def test_overview(spark):
    data = [("s", 0, 1, "d", "promoter", ["a"], []), ("s", 1, 2, "d", "promoter", ["b"], ["n"])]
    df = responses(spark, data)
    summary = df.groupBy("session_id").agg(F.lit("sum").alias("summary"))
    row = rollup.overview(df, summary).first()
    assert (row.Summary, row.Sentiment, row.Positive_Themes, row.Negative_Themes) == ("sum", "promoter", ["a", "b"], ["n"])
    assert row.conflict is False and row.reviews == 2


def test_overview_tells_of_a_failed_summary(spark):
    replies = spark.createDataFrame(
        [("a", "promoter", ["x"], []), ("b", "promoter", [], ["y"])],
        "session_id string, Sentiment string, Positive_Themes array<string>, Negative_Themes array<string>",
    )
    summary = spark.createDataFrame([("a", "", True), ("b", "fine", False)], "session_id string, summary string, failed boolean")
    got = {r.session_id: (r.Summary, r.failed) for r in rollup.overview(replies, summary).collect()}
    assert got == {"a": (None, True), "b": ("fine", False)}


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_split_text_loses_nothing_and_keeps_to_the_size(most):
    rng = random.Random(most)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "long-word", ". ", "\n", "!", "é", "  ", "x" * 40]) for _ in range(rng.randrange(40)))
        pieces = rollup.split_text(text, most)
        assert "".join(pieces) == text and all(len(p) <= most for p in pieces) and (all(pieces) or pieces == [""])


def test_split_text_cuts_at_sentences_then_words():
    assert rollup.split_text("One two. Three four. Five", 12) == ["One two. ", "Three four. ", "Five"]
    assert rollup.split_text("one two three", 9) == ["one two ", "three"] and rollup.split_text("abcdefgh", 3) == ["abc", "def", "gh"]


class Measuring:
    """Fails on a prompt whose texts together exceed the budget."""

    def generate(self, prompts):
        for p in prompts:
            texts = json.loads(p.partition("<texts>")[2].partition("</texts>")[0])
            if sum(map(len, texts)) > 100:
                raise Permanent(f"{sum(map(len, texts))} characters")
        return [f"{len(p) % 97} short" for p in prompts]


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_no_prompt_holds_more_than_the_budget(spark, block_rows):
    rng = random.Random(5)
    data = [(f"s{i % 3}", i // 3, " ".join("w" * rng.randrange(1, 12) for _ in range(rng.choice([1, 5, 400])))) for i in range(60)] + [("one", 0, "x" * 5_000), ("none", 0, None)]
    df = spark.createDataFrame(data, "session_id string, pos bigint, t string")
    got = rollup.consolidated_summary(df, "t", Measuring, budget=100, block_rows=block_rows, whole_texts=False).collect()
    assert {r.session_id: (r.reviews, r.failed) for r in got} == {"s0": (20, False), "s1": (20, False), "s2": (20, False), "one": (1, False), "none": (1, False)}


def test_summaries_that_do_not_get_shorter_are_an_error(spark, monkeypatch):
    class Wordy:
        def generate(self, prompts):
            return ["x" * 300 for _ in prompts]

    monkeypatch.setattr(rollup, "LEVELS", 3)
    df = spark.createDataFrame([("s", i, "y" * 40) for i in range(9)], "session_id string, pos bigint, t string")
    with pytest.raises(RuntimeError, match="do not get shorter"):
        rollup.consolidated_summary(df, "t", Wordy, budget=100, whole_texts=False)
