"""Schemas of the documents and tables."""

from pyspark.sql import types as T

# Survey questions of any shape: the JSON text as it stands in the batch.
QUESTIONS = T.StringType()

# A feedback's id may be any JSON value but a list or an object; it is kept as text.
FEEDBACK = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("Review", T.StructType([T.StructField("Text", T.StringType())])),
        T.StructField("Customer", T.StructType([T.StructField("Name", T.StringType())])),
        T.StructField("Surveys", T.ArrayType(T.StructType([T.StructField("Questions", QUESTIONS)]))),
    ]
)

FEEDBACK_BATCH = T.StructType(
    [
        T.StructField("Core Prompt", T.StringType()),
        T.StructField("Context Prompt", T.StringType()),
        T.StructField("Feedback Data", T.ArrayType(FEEDBACK)),
    ]
)

SURVEY_MASTER = T.StructType(
    [
        T.StructField("survey_id", T.LongType()),
        T.StructField("contact", T.StringType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("review_rating", T.IntegerType()),
        T.StructField("pos", T.LongType()),
    ]
)

TONE_KEYS = ["Default", "More_friendly", "More_Professional", "More_Concise"]
THEME_LIST_KEYS = ["Positive_Themes", "Negative_Themes"]


def _reply(texts: list[str], lists: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(k, T.StringType()) for k in texts]
        + [T.StructField(k, T.ArrayType(T.StringType())) for k in lists]
    )


TONE_REPLY = _reply(TONE_KEYS, [])
ANALYSIS_REPLY = _reply([*TONE_KEYS, "Summary", "Sentiment"], THEME_LIST_KEYS)
ONE_REPLY = _reply(["Response", "Summary", "Sentiment"], THEME_LIST_KEYS)
THEME_REPLY = _reply(["sentiment"], ["themes_category"])

RESPONSE = T.StructType([*ANALYSIS_REPLY.fields, T.StructField("feedback_id", T.LongType())])

RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField(
            "Overview", _reply(["Summary", "Sentiment"], THEME_LIST_KEYS)
        ),
        T.StructField("Responses", T.ArrayType(RESPONSE)),
    ]
)

CHAT_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_feedback", T.StringType()),
        T.StructField("modification_needed", T.StringType()),
        T.StructField("history", T.StringType()),
        T.StructField("model_response", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("latency", T.DoubleType()),
        T.StructField("tokens_used", T.DoubleType()),
        T.StructField("cost", T.DecimalType(18, 8)),
    ]
)

DELTA_EVENT = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

PRICE = T.DecimalType(18, 8)

PRICE_CATALOG = T.StructType(
    [
        T.StructField("embeddings", T.MapType(T.StringType(), PRICE)),
        T.StructField(
            "images",
            T.MapType(
                T.StringType(),
                T.MapType(T.StringType(), T.MapType(T.StringType(), PRICE)),
            ),
        ),
        T.StructField("audio", T.MapType(T.StringType(), PRICE)),
        T.StructField(
            "chat",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [T.StructField("promptPrice", PRICE), T.StructField("completionPrice", PRICE)]
                ),
            ),
        ),
    ]
)
