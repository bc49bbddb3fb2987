from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rejoinder.functions import text
from rejoinder.operators.lookups import request_cost
from rejoinder.sources import prices

SAMPLES = ["", " ", "one", " two  words ", "a\tb\nc\r\nd", "no break here", "wide　space", " ", "é ü"]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize("value", SAMPLES)
def test_word_count_as_python_split(spark, value):
    assert one(spark, text.word_count(F.col("x")), value) == len(value.split())


@pytest.mark.parametrize("value", ["AI: hello", "AI: a: b", "no label", "", ": x"])
def test_second_field(spark, value):
    parts = value.split(": ")
    assert one(spark, text.second_field(F.col("x")), value) == (parts[1] if len(parts) > 1 else "")


@pytest.mark.parametrize("value", ["a\n\nb\r\nc", "\n\n", "one", ""])
def test_joined_lines(spark, value):
    assert one(spark, text.joined_lines(F.col("x")), value) == "".join(value.split())


def test_first_line_and_missing_review(spark):
    assert one(spark, text.first_line(F.col("x")), "a\nb") == "a"
    assert one(spark, text.with_review(F.col("x"), F.lit(None).cast("string")), "good") == "goodNone"


@pytest.mark.parametrize("value", [0.125, 0.375, 2.5, 1.005, 7.0])
def test_rounding_half_to_even(spark, value):
    assert spark.range(1).select(text.round_half_even(F.lit(value).cast("decimal(10,4)"))).first()[0] == round(
        Decimal(str(value)), 2
    )


def test_bad_ids_and_numbers_are_null(spark):
    assert one(spark, text.to_survey_id(F.col("x")), "7885020") == 7885020
    assert one(spark, text.to_survey_id(F.col("x")), "x1") is None
    assert one(spark, text.to_number(F.col("x")), "n/a") is None


def test_run_ids(spark):
    df = spark.createDataFrame([("a",), ("a",)], "x string")
    fixed = [r[0] for r in df.select(text.repeatable_run_id(F.col("x"))).collect()]
    drawn = [r[0] for r in df.select(text.random_run_id()).collect()]
    assert fixed[0] == fixed[1] and drawn[0] != drawn[1]
    assert all(len(i) == 32 for i in fixed + drawn)


def test_tokenizer_of_the_users_choice(spark):
    meter = text.tokenizer_meter(lambda: list)
    df = spark.createDataFrame([("abc",), (None,)], "x string")
    assert sorted((r[0] for r in df.select(meter(F.col("x"))).collect()), key=str) == [3, None]


CATALOG = """{
  "embeddings": {"e1": 0.0001, "e2": 0.00002},
  "images": {"i1": {"standard": {"1x1": 0.04, "2x2": 0.08}, "hd": {"1x1": 0.12}}},
  "audio": {"a1": 0.015},
  "chat": {"c1": {"promptPrice": 0.00015, "completionPrice": 0.0002}, "c2": {"promptPrice": 1, "completionPrice": 2}}
}"""


def test_price_catalog(spark, tmp_path):
    (tmp_path / "prices.json").write_text(CATALOG)
    flat = prices.flat_prices(prices.read_catalog(spark, str(tmp_path / "prices.json")))
    got = {tuple(r)[:5]: r.price for r in flat.collect()}
    assert len(got) == 2 + 3 + 1 + 4
    assert got["images", "i1", "hd", "1x1", "price"] == Decimal("0.12")
    assert got["chat", "c1", None, None, "completion"] == Decimal("0.0002")
    both = {r.model: (r.prompt_price, r.completion_price) for r in prices.chat_prices(flat).collect()}
    assert both["c2"] == (1, 2)


def test_catalog_without_some_sections(spark):
    df = spark.createDataFrame([('{"audio": {"a": 1}}',), ("{}",)], "j string")
    assert [r.model for r in prices.flat_prices(prices.parse_catalog(df, "j")).collect()] == ["a"]


def test_cost(spark):
    known = spark.createDataFrame([("m", Decimal("0.5"), Decimal("2"))], "model string, prompt_price decimal(18,8), completion_price decimal(18,8)")
    asked = spark.createDataFrame([(1, "m", "a b c", "d"), (2, "other", "a", "b")], "id int, model string, p string, r string")
    got = {r.id: (r.prompt_cost, r.reply_cost, r.cost) for r in request_cost(asked, known, "p", "r").collect()}
    assert got == {1: (Decimal("1.5"), 2, Decimal("3.5")), 2: (None, None, None)}
    per_thousand = request_cost(asked, known, "p", "r", per=1000).filter("id = 1").first()
    assert float(per_thousand.cost) == 0.0035
