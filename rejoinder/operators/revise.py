"""Revision of stored replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.inference import MakeClient, run_chain
from rejoinder.operators.lookups import match_revisions
from rejoinder.operators.prompts import REVISE, fill_text
from rejoinder.schemas import TONE_KEYS


def revise(
    requests: DataFrame,
    responses: DataFrame,
    make_client: MakeClient,
    fields: list[str] | None = None,
    **calls,
) -> DataFrame:
    """Answer each request: status 200 with the revised text, 404, or 500 with the error.

    Several requests for the same text are applied one after the other by ``request_id``.
    """
    matched = match_revisions(requests, responses, fields or [*TONE_KEYS, "Summary"])

    def prompt(text, row):
        if row["status"] != 200:
            return None
        return fill_text(REVISE, {"text": text, "change": row["modifications"]})

    answered = run_chain(
        matched,
        ["session_id", "feedback_id", "modification_key"],
        ["request_id"],
        start=lambda row: row["stored_text"],
        prompt=prompt,
        step=lambda text, row, raw: text if raw is None else raw,
        make_client=make_client,
        **calls,
    )
    failed = (F.col("status") == 200) & F.col("raw").isNull()
    return (
        answered.withColumn("reason", F.when(failed, F.col("error")).otherwise(F.col("reason")))
        .withColumn("status", F.when(failed, 500).otherwise(F.col("status")))
        .withColumnRenamed("raw", "revised_text")
        .drop("error", "attempts", "latency_s")
    )


def apply_revisions(responses: DataFrame, revised: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Stored replies with the revised texts in place; rows without a revision stay as they are."""
    fields = [f for f in (fields or [*TONE_KEYS, "Summary"]) if f in responses.columns]
    done = revised.filter("status = 200").select(
        "session_id", "feedback_id", "pos", "modification_key", "request_id", "revised_text"
    )
    # at most one text per field and reply
    newest = done.groupBy("session_id", "feedback_id", "pos").agg(
        *[
            F.max_by(
                F.when(F.col("modification_key") == f, F.col("revised_text")),
                F.when(F.col("modification_key") == f, F.col("request_id")),
            ).alias(f"_new_{f}")
            for f in fields
        ]
    )
    joined = responses.join(newest, ["session_id", "feedback_id", "pos"], "left")
    return joined.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).select(*responses.columns)
