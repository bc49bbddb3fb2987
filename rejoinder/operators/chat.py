"""Replies in a chat session and the log rows they leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import shown, token_meter, word_count
from rejoinder.operators.history import history_before, history_text
from rejoinder.operators.inference import MakeClient, batch_inference, run_chain
from rejoinder.operators.lookups import request_cost, survey_lookup
from rejoinder.operators.prompts import CHAT_REVISE, REPLY, fill, fill_text

KEPT_MESSAGES = 3


def _with_survey(turns: DataFrame, sessions: DataFrame, master: DataFrame) -> DataFrame:
    """``sessions`` names the survey of each session."""
    asked = turns.join(sessions.select("session_id", "survey_id"), "session_id", "left")
    return survey_lookup(asked.withColumn("comment", F.col("text")), master)


def chat_replies(
    messages: DataFrame,
    sessions: DataFrame,
    master: DataFrame,
    make_client: MakeClient,
    n: int = KEPT_MESSAGES,
    **calls,
) -> DataFrame:
    """A reply to every user message, with the history the log holds before it.

    The first user message of a session, whatever was said before it, is answered from its survey; later ones ask for a
    change.
    """
    turns = history_before(messages, n).filter(F.col("role") == "user")
    firsts = messages.filter(F.col("role") == "user").groupBy("session_id").agg(F.min("ord").alias("_first"))
    looked_up = _with_survey(turns.join(firsts, "session_id"), sessions, master)
    history = history_text(F.col("history"))
    first = F.col("ord") == F.col("_first")
    reply = fill(
        REPLY,
        {
            "review": F.col("comment_with_review"),
            "rating": F.col("review_rating"),
            "history": history,
            "username": F.col("contact"),
        },
    )
    change = fill(CHAT_REVISE, {"history": history, "change": F.col("text")})
    prompted = looked_up.select(
        "session_id", "ord", "text", "history", first.alias("is_first"),
        F.when(first, reply).otherwise(change).alias("prompt"),
    )
    return batch_inference(prompted, make_client, **calls)


def replay_chat(
    user_messages: DataFrame,
    sessions: DataFrame,
    master: DataFrame,
    make_client: MakeClient,
    n: int = KEPT_MESSAGES,
    **calls,
) -> DataFrame:
    """As ``chat_replies`` where no replies were logged: each reply is history for the next turn."""
    rows = _with_survey(user_messages, sessions, master).select(
        "session_id",
        "ord",
        "text",
        shown(F.col("comment_with_review")).alias("review"),
        shown(F.col("review_rating")).alias("rating"),
        shown(F.col("contact")).alias("username"),
    )

    def rendered(history):
        return "\n".join(f"{role}: {text}" for role, text in history)

    def prompt(history, row):
        if not history:
            slots = {k: row[k] for k in ("review", "rating", "username")}
            return fill_text(REPLY, {**slots, "history": ""})
        return fill_text(CHAT_REVISE, {"history": rendered(history), "change": row["text"]})

    return run_chain(
        rows,
        ["session_id"],
        ["ord"],
        start=lambda row: [],
        prompt=prompt,
        step=lambda history, row, raw: [*history, ("user", row["text"]), ("assistant", raw or "")][-n:],
        make_client=make_client,
        **calls,
    )


def chat_log_rows(
    replies: DataFrame,
    prices: DataFrame,
    model: Column,
    meter: Callable[[Column], Column] = token_meter,
    timestamp: Column | None = None,
    price_whole_prompt: bool = False,
) -> DataFrame:
    """Log rows for answered chat turns.

    A first message goes to ``user_feedback``, a change to ``modification_needed`` with the
    history after the reply. Tokens are counted with ``meter`` for a first reply and in words
    for a change. Only the message is priced, unless ``price_whole_prompt`` (needs ``prompt``).
    """
    first = F.col("is_first")
    after = F.concat(
        F.col("history"),
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("text").alias("text")),
            F.struct(F.lit("assistant").alias("role"), F.col("raw").alias("text")),
        ),
    )
    priced = request_cost(
        replies.withColumn("_price_model", model),
        prices,
        "prompt" if price_whole_prompt else "text",
        "raw",
        "_price_model",
    )
    return priced.select(
        "session_id",
        "ord",
        F.when(first, F.col("text")).otherwise("").alias("user_feedback"),
        F.when(first, F.lit("")).otherwise(F.col("text")).alias("modification_needed"),
        F.when(first, F.lit("")).otherwise(history_text(after)).alias("history"),
        F.col("raw").alias("model_response"),
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
        F.col("latency_s").alias("latency"),
        F.when(first, meter(F.col("raw"))).otherwise(word_count(F.col("raw"))).cast("double").alias("tokens_used"),
        F.col("cost").cast("decimal(18,8)").alias("cost"),
    )
