"""The registered queries of this subpackage: thin digests of what the operators give for the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.llm import alignment, chat, decontaminate, fingerprint, html, mixing, pivots, sharding, simhash, tokenbin, tokencount, toxicity, whitening
from rejoinder.llm.common import table
from rejoinder.plans.session import saved

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
MIX_ENTROPY = 0.98
MIX_REPETITION = 4.0
QUERY_EVERY, NEIGHBOURS = 50, 5


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The tokenizer's file, read from the installed package of public tokenizers."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    as_text = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "edited_prefix",
        "next_prefix",
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"), "text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        scores = tokencount.ranked_scores(file.readlines())
    counted = tokencount.counted(docs, scores, public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_pretokens", "n_tokens", F.round("token_score", 3).alias("token_score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "score").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards_of(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tokenbin.write(table(spark, sf_dir, "documents"), tokenizer_json())
    return tokenbin.read_documents(stored)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that reach 98 % of the largest entropy, no source used more than four times, every document used."""
    docs = table(spark, sf_dir, "documents")
    used = mixing.mixture(docs, target_entropy=MIX_ENTROPY, max_repetition=MIX_REPETITION)
    return used.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.source").alias("source"),
        F.col("tokens").alias("n_tokens"),
        F.round("exponent", 6).alias("exponent"),
        F.round("weight", 6).alias("weight"),
        "epoch",
        "block",
        "place",
        "row_place",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn int, role string, text string")
    stored = saved(chat.formatted(chat.linear(given.unionByName(extra))), "chat")
    return chat.digests(stored).drop("leaf")


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as file:
        return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_json(), file.read())


def op12_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pivots.quantised(table(spark, sf_dir, "embeddings"))
    return pivots.top_k(rows, F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS).drop("query_key")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit in a long."""
    found = whitening.whitened(whitening.scaled(table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_fingerprints": op1_prefix_fingerprints,
    "op2_main_text": op2_main_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_vector_shards": op6_vector_shards,
    "op7_token_planes": op7_token_planes,
    "op8_mix_sources": op8_mix_sources,
    "op9_simhash": op9_simhash,
    "op10_reply_trees": op10_reply_trees,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_pivot_top_k": op12_pivot_top_k,
    "op13_whitening": op13_whitening,
}
