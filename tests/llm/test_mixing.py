import math
import random

import pytest
from pyspark.sql import functions as F

from rejoinder.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def plain_weights(sizes, power):
    total = sum(sizes.values())
    z = sum((n / total) ** power for n in sizes.values())
    return {s: (n / total) ** power / z for s, n in sizes.items()}


def plain_entropy(weights):
    return -sum(w * math.log(w) for w in weights.values())


@pytest.fixture(scope="module")
def made(spark):
    pick = random.Random(3)
    rows = []
    for i in range(3000):
        source = pick.choice(["big"] * 12 + ["mid"] * 4 + ["small", None])
        rows.append((i, " ".join(["w"] * pick.randrange(1, 30)), source))
    rows += [(5000, None, "tiny"), (5001, "", "tiny"), (5002, "a b c", "tiny"), (5002, "a b c", "tiny"), (None, "x y", "small")]
    return rows


def sizes_of(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + max(1, len((text or "").split()))
    return sizes


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", weight double").repartition(4)


def test_target_entropy(spark, made):
    sizes = sizes_of(made)
    found = mixing.exponent(mixing.sources(mixing.keyed(frame(spark, made))), target_entropy=0.8)
    assert plain_entropy(plain_weights(sizes, found)) == pytest.approx(0.8 * math.log(len(sizes)), abs=1e-5)


def test_repetition_limit(spark, made):
    sizes, total = sizes_of(made), sum(sizes_of(made).values())
    table = mixing.sources(mixing.keyed(frame(spark, made)))
    found = mixing.exponent(table, max_repetition=3.0, budget=total)
    assert max(w * total / sizes[s] for s, w in plain_weights(sizes, found).items()) == pytest.approx(3.0, rel=1e-4)
    found = mixing.exponent(table, max_repetition=3.0)
    again = [w / sizes[s] for s, w in plain_weights(sizes, found).items()]
    assert max(again) / min(again) == pytest.approx(3.0, rel=1e-4)


@pytest.mark.parametrize("budget", [None, 9_000, 90_000])
def test_quotas_are_met(spark, made, budget, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 50)
    used = mixing.mixture(frame(spark, made), max_repetition=4.0, budget=budget).cache()
    power = used.first()["exponent"]
    sizes = sizes_of(made)
    weights = plain_weights(sizes, power)
    spent = budget or max(sizes[s] / w for s, w in weights.items())
    got = {r["source"]: r["n"] for r in used.groupBy("_row.source").agg(F.sum("tokens").alias("n")).collect()}
    for source, weight in weights.items():
        # less than one row below the quota, never above it (equal rows are taken together)
        assert -64 < got.get(source, 0) - weight * spent <= 1, source
    if budget is None:
        once = mixing.mixed(frame(spark, made), max_repetition=4.0)
        assert once.columns == ["doc_id", "text", "source", "weight"]
        assert once.select("doc_id").distinct().count() == len({r[0] for r in made})
    # an epoch uses a row at most once
    least = used.filter("_row.doc_id <> 5002").groupBy("_row.doc_id", "epoch").count()
    assert least.agg(F.max("count")).first()[0] == 1


def test_few_sources(spark, made):
    one = frame(spark, [r for r in made if r[2] == "mid"])
    assert mixing.mixed(one, target_entropy=0.9).count() == one.count()
    assert mixing.mixed(one.limit(0), max_repetition=2.0).count() == 0
    same = spark.createDataFrame([(i, "a b", str(i % 4)) for i in range(40)], SCHEMA)
    assert mixing.mixed(same, max_repetition=2.0, target_entropy=0.99).count() == 40


def test_no_python_in_the_plan(spark, made):
    plan = mixing.mixture(frame(spark, made).filter("doc_id > 5"), max_repetition=2.0)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
