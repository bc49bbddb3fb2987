"""Whole jobs over feedback rows: prompt, model, parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.flatten import nonempty
from rejoinder.operators.inference import MakeClient, batch_inference
from rejoinder.operators.parse import parse_replies, plain_sentiment
from rejoinder.operators.prompts import prompt_analysis, prompt_direct, prompt_one_reply, prompt_tones
from rejoinder.schemas import ANALYSIS_REPLY, ONE_REPLY, TONE_REPLY

KEYS = ["session_id", "pos", "feedback_id"]


def _job(prompted: DataFrame, make_client: MakeClient, schema, calls: dict) -> DataFrame:
    answered = batch_inference(prompted.select(*KEYS, "prompt"), make_client, **calls)
    parsed = parse_replies(answered, schema)
    if "Sentiment" in schema.fieldNames():
        parsed = parsed.withColumn("Sentiment", plain_sentiment(F.col("Sentiment")))
    return parsed


def review_analysis(
    feedback: DataFrame, questions: Column, make_client: MakeClient, include_policy: bool = True, **calls
) -> DataFrame:
    """Four tones, summary, sentiment and themes per review."""
    return _job(prompt_analysis(feedback, questions, include_policy), make_client, ANALYSIS_REPLY, calls)


def one_reply_analysis(
    feedback: DataFrame, questions: Column, make_client: MakeClient, include_policy: bool = True, **calls
) -> DataFrame:
    """As ``review_analysis`` with one answer, key ``Response``."""
    return _job(prompt_one_reply(feedback, questions, include_policy), make_client, ONE_REPLY, calls)


def tone_replies(
    feedback: DataFrame, questions: Column, make_client: MakeClient, include_policy: bool = True, **calls
) -> DataFrame:
    """Four tones per review and nothing else."""
    return _job(prompt_tones(feedback, questions, include_policy), make_client, TONE_REPLY, calls)


def direct_replies(
    feedback: DataFrame, key: str, column: str, make_client: MakeClient, **calls
) -> DataFrame:
    """A reply to each feedback that has text."""
    asked = prompt_direct(nonempty(feedback.select(key, column), column), column)
    return batch_inference(asked.select(key, "prompt"), make_client, **calls)
