"""From raw documents to token files, in five stages; each works on all rows its predecessor kept.

Every stage is written as Parquet to the shared folder and read again as the next one's documents, so a lost
executor never repeats an earlier stage. All stages but the last return the columns of ``documents``.

Cases: an empty table goes through all stages and gives no rows; a stage that has nothing to reject keeps all. Null and empty texts
are clean and near-duplicates of each other (fingerprint zero), so one of them stays. Null ids are kept and come first in the token
files. Repeated rows are near-duplicates of each other. Texts of any length go through whole. Further columns are carried to the
token files, which read ``doc_id`` and ``text`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rejoinder.llm import decontaminate, mixing, simhash, tokenbin, toxicity
from rejoinder.llm.common import prepared, table
from rejoinder.llm.queries import tokenizer_json
from rejoinder.plans.session import saved

# No source is repeated more than twice on average, and every document is used at least once.
MIX_REPETITION = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5, trained on the labels of the given documents."""
    prepared(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    prepared(spark)
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources up to twice; a document used twice comes twice."""
    prepared(spark)
    return mixing.mixed(docs, max_repetition=MIX_REPETITION)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in order of their ids; what the files say of each."""
    prepared(spark)
    return tokenbin.read_documents(tokenbin.write(docs, tokenizer_json()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("token_output", write_tokens),
]

# A trained classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
