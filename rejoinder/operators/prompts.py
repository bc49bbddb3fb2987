"""Prompt texts. A template is filled by columns, so a prompt is one string expression per row."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import shown
from rejoinder.operators.history import history_text

# Slots stand in braces.
REPLY = """Task: reply to a customer.
You answer customers of an online shop. Be polite and helpful.
<review>
{review}
</review>
<rating>{rating}</rating>
Earlier messages:
<history>
{history}
</history>
<customer>{username}</customer>
Write the answer to this customer."""

REPLY_WITHOUT_RATING = REPLY.replace("<rating>{rating}</rating>\n", "")

POLICY = """<rules>
{core}
</rules>
<setting>
{context_first}
{context_last}
</setting>
<addressee>{username}</addressee>
"""

ANALYSIS = """Task: analyse one review.
{policy}<review>
{review}
</review>
<survey>
{survey}
</survey>
<customer>{username}</customer>
Answer the customer in four tones, and from the survey tell how the customer feels.
Give back one JSON object and no other text. Its keys:
Default: the answer. More_friendly: the answer, warmer. More_Professional: the answer, more formal.
More_Concise: the answer, shorter. Summary: what the review says.
Sentiment: promoter or non-promoter. Positive_Themes: list of what went well, may be empty.
Negative_Themes: list of what went badly, may be empty."""

ONE_REPLY = """Task: analyse one review with one answer.
{policy}<review>
{review}
</review>
<survey>
{survey}
</survey>
<customer>{username}</customer>
Answer the customer, and from the survey tell how the customer feels.
Give back one JSON object and no other text. Its keys:
Response: the answer. Summary: what the review says. Sentiment: promoter or non-promoter.
Positive_Themes: list of what went well, may be empty.
Negative_Themes: list of what went badly, may be empty."""

TONES = """Task: answer in four tones.
{policy}<review>
{review}
</review>
<survey>
{survey}
</survey>
<customer>{username}</customer>
Give back one JSON object and no other text. Its keys:
Default: the answer. More_friendly: the answer, warmer. More_Professional: the answer, more formal.
More_Concise: the answer, shorter."""

SUMMARY = """Task: sum up a list of texts.
The texts stand for {count} customers.
<texts>
{texts}
</texts>
Write one summary of at most two sentences that tells how all of these customers feel."""

THEMES = """Task: choose classes.
<classes>
{classes}
</classes>
<comment>
{comment}
</comment>
Choose one or more of the classes for the comment; use no class that is not listed.
Give back one JSON object and no other text. Its keys:
themes_category: list of class names. sentiment: positive, negative or neutral."""

REVISE = """Task: revise a text.
<text>
{text}
</text>
<change>
{change}
</change>"""

CHAT_REVISE = """Task: revise in a chat.
Earlier messages:
<history>
{history}
</history>
<change>
{change}
</change>"""

DIRECT = """Task: answer feedback.
Write a first-class answer to this customer.
<feedback>
{feedback}
</feedback>"""

# Fixed value: output limit of the direct reply.
MAX_OUTPUT_TOKENS = 1024

_SLOT = re.compile(r"\{(\w+)\}")


def pieces(template: str) -> list[tuple[str, bool]]:
    """Template as (text, is_slot) pairs in order."""
    parts = _SLOT.split(template)
    return [(part, i % 2 == 1) for i, part in enumerate(parts) if part]


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    return F.concat(*[shown(slots[text]) if is_slot else F.lit(text) for text, is_slot in pieces(template)])


def fill_text(template: str, slots: Mapping[str, object]) -> str:
    return "".join(str(slots[text]) if is_slot else text for text, is_slot in pieces(template))


def policy(include: bool = True) -> Column:
    if not include:
        return F.lit("")
    return fill(
        POLICY,
        {
            "context_last": F.col("context_last"),
            "context_first": F.col("context_first"),
            "core": F.col("core_prompt"),
            "username": F.col("customer_name"),
        },
    )


def _per_review(feedback: DataFrame, template: str, questions: Column, include_policy: bool) -> DataFrame:
    return feedback.withColumn(
        "prompt",
        fill(
            template,
            {
                "policy": policy(include_policy),
                "review": F.col("review_text"),
                "survey": questions,
                "username": F.col("customer_name"),
            },
        ),
    )


def prompt_analysis(feedback: DataFrame, questions: Column, include_policy: bool = True) -> DataFrame:
    return _per_review(feedback, ANALYSIS, questions, include_policy)


def prompt_one_reply(feedback: DataFrame, questions: Column, include_policy: bool = True) -> DataFrame:
    return _per_review(feedback, ONE_REPLY, questions, include_policy)


def prompt_tones(feedback: DataFrame, questions: Column, include_policy: bool = True) -> DataFrame:
    return _per_review(feedback, TONES, questions, include_policy)


def prompt_reply(turns: DataFrame, with_rating: bool = True) -> DataFrame:
    """Needs ``review``, ``rating``, ``history`` (messages), ``username``."""
    template = REPLY if with_rating else REPLY_WITHOUT_RATING
    slots = {
        "review": F.col("review"),
        "history": history_text(F.col("history")),
        "username": F.col("username"),
    }
    if with_rating:
        slots["rating"] = F.col("rating")
    return turns.withColumn("prompt", fill(template, slots))


def prompt_summary(lists: DataFrame, texts: str = "items", count: str = "reviews") -> DataFrame:
    return lists.withColumn(
        "prompt", fill(SUMMARY, {"count": F.col(count), "texts": F.to_json(F.col(texts))})
    )


def prompt_themes(comments: DataFrame, classes: Column, comment: str = "comment") -> DataFrame:
    return comments.withColumn("prompt", fill(THEMES, {"classes": classes, "comment": F.col(comment)}))


def prompt_revise(matched: DataFrame) -> DataFrame:
    return matched.withColumn(
        "prompt", fill(REVISE, {"text": F.col("stored_text"), "change": F.col("modifications")})
    )


def prompt_chat_revise(turns: DataFrame, change: str = "modifications") -> DataFrame:
    return turns.withColumn(
        "prompt", fill(CHAT_REVISE, {"history": history_text(F.col("history")), "change": F.col(change)})
    )


def prompt_direct(feedback: DataFrame, column: str = "feedback", version: tuple[str, str] | None = None) -> DataFrame:
    """Adds the prompt and ``body``, the request as a chat message in JSON.

    ``version`` is the key and value by which a service tells its message formats apart.
    """
    prompted = feedback.withColumn("prompt", fill(DIRECT, {"feedback": F.col(column)}))
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(
        *([F.lit(version[1]).alias(version[0])] if version else []),
        F.lit(MAX_OUTPUT_TOKENS).alias("max_tokens"),
        F.array(message).alias("messages"),
    )
    return prompted.withColumn("body", F.to_json(body))
