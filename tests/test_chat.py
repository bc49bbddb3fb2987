from decimal import Decimal

import pandas as pd
import pytest

from rejoinder.testing.stand_in import StandIn, stand_in
from rejoinder.operators import chat, prompts
from rejoinder.plans.session import tune

MESSAGES = [
    ("1", 0, "user", "first question"),
    ("1", 1, "assistant", "logged answer"),
    ("1", 2, "user", "make it short"),
    ("1", 3, "assistant", "short answer"),
    ("1", 4, "user", "now kinder please"),
    ("2", 0, "user", "hello"),
]


@pytest.fixture
def inputs(spark):
    messages = spark.createDataFrame(MESSAGES, "session_id string, ord bigint, role string, text string")
    sessions = spark.createDataFrame([("1", "11"), ("2", "99")], "session_id string, survey_id string")
    master = spark.createDataFrame(
        [(11, "Ann", " stored review", 4, 0)],
        "survey_id bigint, contact string, review_text string, review_rating int, pos bigint",
    )
    return messages, sessions, master


def first_prompt(session):
    known = session == "1"
    text = MESSAGES[0][3] if known else "hello"
    return prompts.fill_text(
        prompts.REPLY,
        {
            "review": text + (" stored review" if known else "None"),
            "rating": 4 if known else None,
            "history": "",
            "username": "Ann" if known else None,
        },
    )


def test_replies_from_logged_history(inputs, retry):
    got = {(r.session_id, r.ord): r.raw for r in chat.chat_replies(*inputs, stand_in, retry=retry).collect()}
    model = StandIn()
    history = "assistant: logged answer\nuser: make it short\nassistant: short answer"
    want = {
        ("1", 0): model.reply(first_prompt("1")),
        ("2", 0): model.reply(first_prompt("2")),
        ("1", 2): model.reply(prompts.fill_text(prompts.CHAT_REVISE, {"history": "user: first question\nassistant: logged answer", "change": "make it short"})),
        ("1", 4): model.reply(prompts.fill_text(prompts.CHAT_REVISE, {"history": history, "change": "now kinder please"})),
    }
    assert got == want


def test_replay_uses_its_own_replies(inputs, retry):
    """Against the plain loop: one session after the other, one turn after the other."""
    messages, sessions, master = inputs
    asked = messages.filter("role = 'user'").repartition(3)
    got = {(r.session_id, r.ord): r.raw for r in chat.replay_chat(asked, sessions, master, stand_in, retry=retry).collect()}
    model, want = StandIn(), {}
    for session in ("1", "2"):
        history = []
        for s, o, role, text in MESSAGES:
            if s != session or role != "user":
                continue
            if history:
                shown = "\n".join(f"{r}: {t}" for r, t in history[-3:])
                prompt = prompts.fill_text(prompts.CHAT_REVISE, {"history": shown, "change": text})
            else:
                prompt = first_prompt(session)
            want[s, o] = model.reply(prompt)
            history += [("user", text), ("assistant", want[s, o])]
    assert got == want


def test_log_rows(spark, inputs, retry):
    prices = spark.createDataFrame(
        [("m", Decimal("0.1"), Decimal("0.01"))], "model string, prompt_price decimal(18,8), completion_price decimal(18,8)"
    )
    from pyspark.sql import functions as F

    replies = chat.chat_replies(*inputs, stand_in, retry=retry, keep_prompt=True)
    got = {(r.session_id, r.ord): r for r in chat.chat_log_rows(replies, prices, F.lit("m")).collect()}
    first, change = got["1", 0], got["1", 2]
    assert (first.user_feedback, first.modification_needed, first.history) == ("first question", "", "")
    assert (change.user_feedback, change.modification_needed) == ("", "make it short")
    assert change.history.splitlines()[:3] == ["user: first question", "assistant: logged answer", "user: make it short"]
    assert change.history.endswith("assistant: " + change.model_response)
    assert first.cost == Decimal("0.1") * 2 + Decimal("0.01") * len(first.model_response.split())
    assert change.tokens_used == len(change.model_response.split())
    whole = {(r.session_id, r.ord): r for r in chat.chat_log_rows(replies, prices, F.lit("m"), price_whole_prompt=True).collect()}
    assert whole["1", 0].cost > first.cost
    assert {r.cost for r in chat.chat_log_rows(replies, prices, F.lit("x")).collect()} == {None}


def test_long_texts_come_to_a_worker_a_few_at_a_time(spark):
    # 24 MB of text in one partition
    texts = tune(spark).range(0, 240, 1, 1).selectExpr("id", "repeat('x', 100000) as text")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)]})

    got = [r.rows for r in texts.mapInPandas(sizes, "rows long").collect()]
    assert sum(got) == 240 and max(got) <= 60
