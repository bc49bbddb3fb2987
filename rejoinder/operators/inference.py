"""Model calls as a distributed job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.functions.model import ModelClient, Retry, ask
from rejoinder.plans import store
from rejoinder.plans.session import new_path, saved

MakeClient = Callable[[], ModelClient]

_ANSWER = "raw string, error string, attempts int, latency_s double"
_ANSWERS = ["raw", "error", "attempts", "latency_s"]


def call_model(
    prompts: DataFrame, make_client: MakeClient, retry: Retry | None = None, batch_size: int = 32
) -> DataFrame:
    """Answers for a table of (``prompt_hash``, ``prompt``); one client per task. ``permanent`` marks errors that stay."""
    retry = retry or Retry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                some = batch.iloc[at : at + batch_size]
                answers = pd.DataFrame(ask(client, some["prompt"].tolist(), retry), columns=[*_ANSWERS, "permanent"])
                answers.insert(0, "prompt_hash", some["prompt_hash"].to_numpy())
                yield answers

    return prompts.select("prompt_hash", "prompt").mapInPandas(run, f"prompt_hash string, {_ANSWER}, permanent boolean")


def _row_by_row(
    df: DataFrame,
    make_client: MakeClient,
    prompt: str,
    retry: Retry | None,
    batch_size: int,
    max_concurrency: int | None,
    keep_prompt: bool,
) -> DataFrame:
    retry = retry or Retry()
    kept = [f for f in df.schema.fields if keep_prompt or f.name != prompt]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *T._parse_datatype_string(_ANSWER).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            asked = batch[prompt].notna().to_numpy().nonzero()[0]
            out: list = [(None, None, 0, None)] * len(batch)
            for at in range(0, len(asked), batch_size):
                some = asked[at : at + batch_size]
                texts = batch[prompt].iloc[some].tolist()
                for i, answer in zip(some, ask(client, texts, retry), strict=True):
                    out[i] = answer[:4]
            answers = pd.DataFrame(out, columns=_ANSWERS, index=batch.index)
            yield pd.concat([batch[names], answers], axis=1)

    rows = df.repartition(max_concurrency) if max_concurrency else df
    return rows.mapInPandas(run, schema)


def batch_inference(
    df: DataFrame,
    make_client: MakeClient,
    prompt: str = "prompt",
    retry: Retry | None = None,
    batch_size: int = 32,
    max_concurrency: int | None = None,
    keep_prompt: bool = False,
    dedupe: bool = False,
) -> DataFrame:
    """Add ``raw``, ``error``, ``attempts`` and ``latency_s`` to every row of ``df``.

    Every row's prompt is sent in one pass, without a join; ``dedupe=True`` saves the rows first and
    sends equal prompts once. A prompt that keeps failing gives an error row, not a failed job.
    ``max_concurrency`` caps the number of tasks that talk to the model. The result is not
    repeatable with a real model, so save it before it is used twice.
    """
    if not dedupe:
        return _row_by_row(df, make_client, prompt, retry, batch_size, max_concurrency, keep_prompt)
    hashed, distinct = _hashed(df, prompt)
    if max_concurrency:
        distinct = distinct.repartition(max_concurrency)
    answers = call_model(distinct, make_client, retry, batch_size).drop("permanent")
    if not keep_prompt:
        hashed = hashed.drop(prompt)
    return hashed.join(answers, "prompt_hash", "left").drop("prompt_hash")


def _hashed(df: DataFrame, prompt: str) -> tuple[DataFrame, DataFrame]:
    """The saved rows with their ``prompt_hash``, and the distinct prompts."""
    df = saved(df, "prompts")
    # rows without a prompt get no answer; their own hash keeps them from meeting in one task
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    own = F.concat(F.lit("-"), F.xxhash64(*plain).cast("string"))
    hashed = df.withColumn("prompt_hash", F.coalesce(F.sha2(prompt, 256), own))
    distinct = df.select(F.col(prompt).alias("prompt")).filter("prompt is not null").distinct()
    return hashed, distinct.withColumn("prompt_hash", F.sha2("prompt", 256))


# a task's file goes into the table when the task is done, not when the whole job is
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
ANSWER_TABLE = f"prompt_hash string, {_ANSWER}, permanent boolean"


def answers_in(spark: SparkSession, path: str) -> DataFrame:
    """The answers of a durable table, one for each prompt: a reply, or else the error that stays, or else the last one.

    A file comes into a batch's folder whole, when its task is done, so folders of jobs that were killed count as well.
    """
    batches = [f"{path}/{run}/{batch}" for run in store.names(spark, path) for batch in store.names(spark, f"{path}/{run}") if batch.startswith("batch=")]
    if not batches:
        return spark.createDataFrame([], ANSWER_TABLE)
    answers = spark.read.schema(ANSWER_TABLE).parquet(*batches)
    best = F.struct(F.col("raw").isNotNull(), "permanent", "raw", "error", "attempts", "latency_s")
    return answers.groupBy("prompt_hash").agg(F.max(best).alias("_a")).select("prompt_hash", *[f"_a.{c}" for c in (*_ANSWERS, "permanent")])


def durable_inference(
    df: DataFrame,
    make_client: MakeClient,
    path: str,
    prompt: str = "prompt",
    retry: Retry | None = None,
    batch_size: int = 32,
    commit_prompts: int = 10_000,
    max_concurrency: int | None = None,
    keep_prompt: bool = False,
) -> DataFrame:
    """As :func:`batch_inference`, with the answers kept in a table at ``path``.

    Only prompts without an answer there are sent, each distinct one once, about ``commit_prompts`` at a time: a task has its share
    of them and commits its answers when it is done, whatever the others do. So a job that was killed, run again, asks
    only for what had not been committed, and a later job asks nothing that an earlier one has asked. Errors that stay are
    answers too; prompts that ran out of attempts are asked again. It is one Spark job, however many prompts there are; only
    with ``max_concurrency`` the tasks go in micro-batches of so many, each committed before the next one begins.
    """
    spark = df.sparkSession
    hashed, distinct = _hashed(df, prompt)
    known = answers_in(spark, path).filter("raw is not null or permanent").select("prompt_hash")
    missing = saved(distinct.join(known, "prompt_hash", "left_anti"), "missing-prompts")
    count = missing.count()
    if count:
        tasks = max_concurrency or spark.sparkContext.defaultParallelism
        # a task's share, and the number of tasks that gives
        files = -(-count // -(-min(count, commit_prompts) // min(count, tasks)))
        run = f"{path}/run-{uuid.uuid4().hex}"

        def commit(some: DataFrame, number: int) -> None:
            answers = call_model(some, make_client, retry, batch_size)
            answers.write.mode("overwrite").options(**COMMIT_BY_TASK).parquet(f"{run}/batch={number}")

        if max_concurrency is None:
            commit(missing.repartition(files), 0)
        else:
            source = new_path(spark, "prompt-files")
            missing.repartition(files).write.parquet(source)
            (
                spark.readStream.schema(missing.schema)
                .option("maxFilesPerTrigger", min(count, tasks))
                .parquet(source)
                .writeStream.foreachBatch(commit)
                .option("checkpointLocation", new_path(spark, "prompt-checkpoint"))
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
    answers = answers_in(spark, path).drop("permanent")
    if not keep_prompt:
        hashed = hashed.drop(prompt)
    return hashed.join(answers, "prompt_hash", "left").drop("prompt_hash")


def run_chain(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[dict], object],
    prompt: Callable[[object, dict], str | None],
    step: Callable[[object, dict, str | None], object],
    make_client: MakeClient,
    retry: Retry | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Model calls where a call needs the result of the one before it with the same key.

    Keys run side by side, the rows of one key in ``order``. ``start`` gives the state for a
    key's first row, ``prompt`` the text to send (none: no call), ``step`` the state after the
    reply. Rows stream through, so a task holds one Arrow batch and one state, however long
    a key's chain is.
    """
    retry = retry or Retry()
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(_ANSWER).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        carried: dict = {}
        for batch in batches:
            rows = batch.to_dict("records")
            at_key = [tuple(row[k] for k in keys) for row in rows]
            waves: list[list[int]] = []
            seen: dict = {}
            for i, key in enumerate(at_key):
                depth = seen[key] = seen.get(key, -1) + 1
                if depth == len(waves):
                    waves.append([])
                waves[depth].append(i)
            states = carried
            out: list = [(None, None, 0, None)] * len(rows)
            for wave in waves:
                asked = []
                for i in wave:
                    if at_key[i] not in states:
                        states[at_key[i]] = start(rows[i])
                    text = prompt(states[at_key[i]], rows[i])
                    if text is not None:
                        asked.append((i, text))
                for at in range(0, len(asked), batch_size):
                    some = asked[at : at + batch_size]
                    for (i, _), answer in zip(some, ask(client, [t for _, t in some], retry), strict=True):
                        out[i] = answer[:4]
                for i in wave:
                    states[at_key[i]] = step(states[at_key[i]], rows[i], out[i][0])
            if rows:
                carried = {at_key[-1]: states[at_key[-1]]}
            answers = pd.DataFrame(out, columns=_ANSWERS, index=batch.index)
            yield pd.concat([batch, answers], axis=1)

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .select(*columns)
        .mapInPandas(run, schema)
    )
