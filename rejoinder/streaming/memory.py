"""Session memory on a stream: the last few messages of every session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MEMORY = "ords array<bigint>, roles array<string>, texts array<string>"


def live_history(messages: DataFrame, n: int = 3, forget_after_ms: int | None = None) -> DataFrame:
    """Update stream of (``session_id``, ``last_ord``, ``history``).

    Messages may come in any order. Before the shuffle each Arrow batch keeps the last ``n``
    of every session in it, which is all that can matter, so a hot session stays small.
    A session silent for ``forget_after_ms`` is forgotten; a query with that timer always has a
    next batch, so run it on a processing-time trigger, not until all input is read.
    """

    def last_in_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a message delivered again takes no second place
            once = batch.drop_duplicates(["session_id", "ord"])
            yield once.sort_values("ord").groupby("session_id", sort=False).tail(n)

    def remember(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = {int(o): (o, r, t) for o, r, t in zip(*state.get, strict=True)} if state.exists else {}
        for batch in batches:
            for o, r, t in batch[["ord", "role", "text"]].itertuples(index=False, name=None):
                kept.setdefault(int(o), (o, r, t))
            kept = {o: kept[o] for o in sorted(kept)[-n:]}
        ords, roles, texts = (list(column) for column in zip(*kept.values(), strict=True))
        ords = [int(o) for o in ords]
        state.update((ords, roles, texts))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(
            {"session_id": [key[0]], "last_ord": [ords[-1]], "roles": [roles], "texts": [texts]}
        )

    slim = messages.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("ord").cast("bigint").alias("ord"), "role", "text"
    )
    memory = (
        slim.mapInPandas(last_in_batch, slim.schema)
        .groupBy("session_id")
        .applyInPandasWithState(
            remember,
            "session_id string, last_ord bigint, roles array<string>, texts array<string>",
            _MEMORY,
            "update",
            GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout,
        )
    )
    history = F.zip_with("roles", "texts", lambda r, t: F.struct(r.alias("role"), t.alias("text")))
    return memory.select("session_id", "last_ord", history.alias("history"))
