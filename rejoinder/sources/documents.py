"""Result documents: one JSON document per batch, kept in a versioned Parquet table of buckets.

A version is a small file that names the folder of each bucket; data files are never changed. The version carries the
number of buckets and each document the size of its parts, so a reader needs no settings of its own
and can not use wrong ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.plans import store
from rejoinder.plans.session import saved
from rejoinder.schemas import RESPONSE, RESULT_DOCUMENT

PART_ROWS = 1_000
BUCKETS = 256
# columns of replies that are no part of the reply itself
BOOKKEEPING = {"session_id", "pos", "part", "reply_json", "raw", "error", "attempts", "latency_s", "parse_ok", "missing_keys"}
STORED_RESPONSE = T.StructType(
    [*[f for f in RESPONSE.fields if f.name != "feedback_id"], T.StructField("feedback_id", T.StringType()), T.StructField("Response", T.StringType())]
)


def build_documents(
    responses: DataFrame, overview: DataFrame | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """``document`` per batch: overview, responses in batch order with every field they have, session id.

    A batch of more than ``part_rows`` responses becomes several documents, numbered by
    ``part``; the overview's summary and sentiment are in part 0.
    """
    fields = [c for c in responses.columns if c not in BOOKKEEPING]
    parts = (
        responses.withColumn("part", F.floor(F.col("pos") / part_rows).cast("int"))
        .groupBy("session_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "feedback_id", F.struct(*fields).alias("r")))).alias("_o"))
        .select("session_id", "part", F.transform("_o", lambda x: x["r"]).alias("Responses"))
    )
    if overview is None:
        parts = parts.withColumn("Overview", F.lit(None).cast(RESULT_DOCUMENT["Overview"].dataType))
    else:
        own = overview.select(
            "session_id",
            F.col("part").cast("int").alias("part"),
            F.struct("Summary", "Sentiment", "Positive_Themes", "Negative_Themes").alias("Overview"),
        )
        parts = parts.join(own, ["session_id", "part"], "full")
    return parts.select(
        "session_id",
        "part",
        F.to_json(F.struct("Overview", "Responses", "session_id")).alias("document"),
        F.lit(part_rows).alias("part_rows"),
    )


def expand_responses(documents: DataFrame, id_type: str = "string") -> DataFrame:
    """Response rows of stored documents, with their place among them; ``reply_json`` is the whole reply in JSON.

    Feedback ids are whatever the batch had; ``id_type`` names the type they are wanted in, others become null.
    """
    parsed = documents.select("session_id", "part", "part_rows", F.from_json("document", "Responses array<string>")["Responses"].alias("_r"))
    rows = parsed.select("session_id", "part", "part_rows", F.posexplode("_r").alias("_i", "reply_json"))
    return rows.select(
        "session_id",
        (F.col("part").cast("bigint") * F.col("part_rows") + F.col("_i")).alias("pos"),
        "reply_json",
        F.from_json("reply_json", STORED_RESPONSE).alias("_f"),
    ).select("session_id", "pos", "reply_json", "_f.*").withColumn("feedback_id", F.col("feedback_id").try_cast(id_type))


def _changed(documents: pd.Series, changes: pd.Series) -> pd.Series:
    def one(text, asked):
        body = json.loads(text)
        for change in asked:
            reply = body["Responses"][change["place"]]
            if _as_text(reply.get("feedback_id")) != change["id"]:
                raise ValueError(f"no reply to feedback {change['id']} at its place")
            reply[change["key"]] = change["text"]
        return json.dumps(body, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(t, c) for t, c in zip(documents, changes, strict=True)])


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def place_revisions(documents: DataFrame, revised: DataFrame) -> DataFrame:
    """(session_id, id, key, text, part, place, status): where the stored documents hold the replies that are revised.

    A reply is found by its feedback id, whatever its place; of several with one id the first counts. ``status`` is 404,
    and the place null, when no document of the session has the id. Of several revisions of one text the one with
    the largest ``request_id`` counts.
    """
    done = (
        revised.filter("status = 200")
        .groupBy("session_id", F.col("feedback_id").cast("string").alias("id"), F.col("modification_key").alias("key"))
        .agg(F.max_by("revised_text", "request_id").alias("text"))
    )
    asked = documents.join(done.select("session_id").distinct(), "session_id", "left_semi")
    ids = asked.select("session_id", "part", F.from_json("document", "Responses array<struct<feedback_id string>>")["Responses"]["feedback_id"].alias("_ids"))
    each = ids.select("session_id", "part", F.posexplode("_ids").alias("place", "id"))
    first = each.groupBy("session_id", "id").agg(F.min(F.struct("part", "place")).alias("_at"))
    return done.join(first, ["session_id", "id"], "left").select(
        "session_id", "id", "key", "text", "_at.part", "_at.place", F.when(F.col("_at").isNull(), 404).otherwise(200).alias("status")
    )


def revise_documents(documents: DataFrame, revised: DataFrame) -> DataFrame:
    """The documents that a revision touches, with the revised texts in place; all else in them stays as it is.

    Revisions that :func:`place_revisions` finds no reply for touch nothing.
    """
    placed = place_revisions(documents, revised).filter("status = 200")
    changes = placed.groupBy("session_id", "part").agg(F.collect_list(F.struct("place", "id", "key", "text")).alias("_changes"))
    changed = F.pandas_udf(_changed, "string")
    return documents.join(changes, ["session_id", "part"]).withColumn("document", changed("document", "_changes")).drop("_changes")


def stored_overviews(documents: DataFrame) -> DataFrame:
    parsed = documents.select("session_id", "part", F.from_json("document", T.StructType([RESULT_DOCUMENT["Overview"]])).alias("_d"))
    return parsed.filter("_d.Overview is not null").select("session_id", "part", "_d.Overview.*")


COLUMNS = ["session_id", "part", "document", "part_rows"]
STORED = "session_id string, part int, document string, part_rows int"


class Conflict(Exception):
    """Documents were changed by somebody else since they were read."""


@dataclass(frozen=True)
class Version:
    """What a version of the table consists of: for each bucket that has documents the folder with its files."""

    number: int
    buckets: int
    folders: dict[int, str]


def _bucket(session_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def _commits(path: str) -> str:
    return f"{path}/versions"


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in store.names(spark, _commits(path)) if n.endswith(".json") and not n.startswith(".")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A committed version, the newest by default."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no documents in {path}" if not known else f"no version {number} of {path}")
    number = max(known) if number is None else number
    body = json.loads(store.read_text(spark, f"{_commits(path)}/{number:010d}.json"))
    return Version(number, body["buckets"], {int(b): folder for b, folder in body["folders"].items()})


def _commit(spark: SparkSession, path: str, new: Version) -> bool:
    body = {"buckets": new.buckets, "folders": {str(b): folder for b, folder in sorted(new.folders.items())}}
    return store.commit_text(spark, f"{_commits(path)}/{new.number:010d}.json", json.dumps(body))


def _write(documents: DataFrame, path: str, buckets: int) -> dict[int, str]:
    """Write documents into a folder that nobody else knows yet, one subfolder for each bucket.

    A large bucket is written by as many tasks as its size asks for.
    """
    name = uuid.uuid4().hex
    (
        documents.select(*COLUMNS, _bucket(F.col("session_id"), buckets).alias("bucket"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "session_id", "part")
        .write.partitionBy("bucket")
        .parquet(f"{path}/data/{name}")
    )
    written = [n for n in store.names(documents.sparkSession, f"{path}/data/{name}") if n.startswith("bucket=")]
    return {int(n.removeprefix("bucket=")): f"{name}/{n}" for n in written}


def write_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> Version:
    """Write a new table, version 1. Sessions share ``buckets`` folders, sorted inside a file for skipping."""
    spark = documents.sparkSession
    if versions(spark, path):
        raise ValueError(f"there are documents in {path}")
    first = Version(1, buckets, _write(documents, path, buckets))
    if not _commit(spark, path, first):
        raise Conflict(f"somebody else has written {path}")
    return first


def _read(spark: SparkSession, path: str, at: Version, buckets: list[int]) -> DataFrame:
    folders = [f"{path}/data/{at.folders[b]}" for b in buckets if b in at.folders]
    if not folders:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*folders)


def read_documents(spark: SparkSession, path: str, session_id: str | None = None, at: Version | None = None) -> DataFrame:
    """All documents of a version (default: the newest), or those of one session: then only its bucket is opened.

    Files of a version are never changed, so what was read stays as it is while others write.
    """
    at = at or version(spark, path)
    if session_id is None:
        return _read(spark, path, at, sorted(at.folders))
    own = spark.range(1).select(_bucket(F.lit(session_id), at.buckets)).first()[0]
    return _read(spark, path, at, [own]).filter(F.col("session_id") == session_id)


def replace_documents(spark: SparkSession, path: str, changed: DataFrame, at: Version | None = None) -> Version:
    """Put changed documents in place of the stored ones with the same session and part: a new version.

    ``at`` is the version they were made from. Only the buckets that hold a changed document are read and written, once, into
    a new folder; the version is made by one commit that succeeds for one writer only. A writer that comes second goes on
    from the other's version if that left these buckets alone; else it is a :class:`Conflict` and nothing is changed. A
    write that is killed leaves the version before it.
    """
    at = at or version(spark, path)
    new = saved(changed.select(*COLUMNS), "changed")
    touched = [r[0] for r in new.select(_bucket(F.col("session_id"), at.buckets)).distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return at
    stored = _read(spark, path, at, touched)
    sizes = new.select("session_id", F.col("part_rows").alias("_own")).distinct()
    if stored.join(sizes, "session_id").filter("part_rows <> _own").head(1):
        raise ValueError("documents of a session are cut into parts of another size")
    kept = stored.join(new.select("session_id", "part"), ["session_id", "part"], "left_anti")
    folders = _write(kept.select(*COLUMNS).unionByName(new), path, at.buckets)
    newest = version(spark, path)
    while True:
        if any(newest.folders.get(b) != at.folders.get(b) for b in touched):
            raise Conflict(f"documents of {path} were changed since version {at.number}")
        mine = Version(newest.number + 1, at.buckets, {**newest.folders, **folders})
        if _commit(spark, path, mine):
            return mine
        newest = version(spark, path)


def revise_stored(spark: SparkSession, path: str, revised: DataFrame, attempts: int = 10) -> Version:
    """Put revised texts into the stored documents, of whatever version is the newest when they are committed.

    The change names replies by id, so after another writer's commit it is laid over that writer's documents.
    """
    revised = saved(revised, "revisions")
    for attempt in range(1, attempts + 1):
        at = version(spark, path)
        try:
            return replace_documents(spark, path, revise_documents(read_documents(spark, path, at=at), revised), at)
        except Conflict:
            if attempt == attempts:
                raise
    raise ValueError("attempts must be at least 1")


def remove_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the newest ``keep`` versions and the files that only they have. Not while somebody writes."""
    known = versions(spark, path)
    used = {folder for n in known[-keep:] for folder in version(spark, path, n).folders.values()}
    for number in known[:-keep]:
        store.remove(spark, f"{_commits(path)}/{number:010d}.json")
    for name in store.names(spark, f"{path}/data"):
        for bucket in store.names(spark, f"{path}/data/{name}"):
            if f"{name}/{bucket}" not in used and bucket.startswith("bucket="):
                store.remove(spark, f"{path}/data/{name}/{bucket}")
        if not any(folder.startswith(f"{name}/") for folder in used):
            store.remove(spark, f"{path}/data/{name}")
