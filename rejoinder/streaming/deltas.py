"""Putting replies together while their pieces arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rejoinder.operators.deltas import STOP, read_events

# Runs of events that lie side by side: of each the first and last number, its text, and how long each event's piece is;
# ``stop`` is the number of the stop event, -1 before it comes, -2 once the message is given out.
_STATE = "firsts array<bigint>, lasts array<bigint>, texts array<string>, sizes array<array<int>>, stop bigint"
_RUNS = "message_id bigint, first bigint, last bigint, text string, sizes array<int>, stop bigint"
GIVEN_OUT = -2


def join_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events of an Arrow batch, put together where they lie side by side."""
    for batch in batches:
        order = np.lexsort((batch["seq"].to_numpy(), batch["message_id"].to_numpy()))
        ids, seqs, pieces, stops = (batch[c].to_numpy()[order] for c in ("message_id", "seq", "piece", "stop"))
        fresh = np.ones(len(batch), dtype=bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (seqs[1:] != seqs[:-1])
        ids, seqs, pieces, stops = ids[fresh], seqs[fresh], pieces[fresh], stops[fresh]
        edge = np.ones(len(ids), dtype=bool)
        edge[1:] = (ids[1:] != ids[:-1]) | (seqs[1:] != seqs[:-1] + 1)
        at = np.flatnonzero(edge)
        ends = np.append(at[1:], len(ids))
        texts, listed = pieces.tolist(), np.fromiter(map(len, pieces), np.int32, len(pieces))
        yield pd.DataFrame(
            {
                "message_id": ids[at], "first": seqs[at], "last": seqs[ends - 1],
                "text": ["".join(texts[i:j]) for i, j in zip(at.tolist(), ends.tolist())],
                "sizes": [listed[i:j] for i, j in zip(at.tolist(), ends.tolist())],
                "stop": [int(seqs[i:j][stops[i:j]].max(initial=-1)) for i, j in zip(at.tolist(), ends.tolist())],
            }
        )


class _Run:
    """Neighbouring runs being put together."""

    def __init__(self, first: int, last: int, text: str, sizes: np.ndarray):
        self.first, self.last, self.texts, self.sizes = first, last, [text], [sizes]

    def add(self, first: int, last: int, text: str, sizes: np.ndarray) -> None:
        """What this run has already is skipped."""
        known = max(0, self.last + 1 - first)
        if last > self.last:
            self.texts.append(text[int(sizes[:known].sum()) :])
            self.sizes.append(sizes[known:])
            self.last = last


def _merged(runs: list[tuple[int, int, str, np.ndarray]]) -> list[tuple[int, int, str, np.ndarray]]:
    out: list[_Run] = []
    for first, last, text, sizes in sorted(runs, key=lambda r: r[:2]):
        if out and out[-1].last + 1 >= first:
            out[-1].add(first, last, text, sizes)
        else:
            out.append(_Run(first, last, text, sizes))
    return [(r.first, r.last, "".join(r.texts), np.concatenate(r.sizes)) for r in out]


def live_assemble(
    events: DataFrame, payload: str = "payload", first_seq: int = 0, give_up_after_ms: int | None = None
) -> DataFrame:
    """Append stream of (``message_id``, ``text``, ``complete``).

    A message is given out when its stop event and everything before it, from ``first_seq`` on, have arrived, in
    whatever order. What comes behind the stop event, or again, is ignored, before and after the message is given out: of
    one that is given out a mark without text stays. A message that gets no further events for ``give_up_after_ms`` is given
    out as it stands with ``complete`` false; the same timer then removes the mark. A query with that timer always has a
    next batch, so run it on a processing-time trigger; without it the marks stay. Before the shuffle neighbouring
    pieces in an Arrow batch are put in one row.
    """

    def collect(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, stop = [], -1
        if state.exists:
            firsts, lasts, texts, sizes, stop = state.get
            runs = [(f, l, t, np.array(s, dtype=np.int32)) for f, l, t, s in zip(firsts, lasts, texts, sizes, strict=True)]
        if state.hasTimedOut:
            state.remove()
            if stop == GIVEN_OUT:
                return
            yield pd.DataFrame({"message_id": [key[0]], "text": ["".join(r[2] for r in _merged(runs))], "complete": [False]})
            return
        for batch in batches:
            runs += [
                (int(f), int(l), t, np.asarray(s, dtype=np.int32))
                for f, l, t, s in batch[["first", "last", "text", "sizes"]].itertuples(index=False, name=None)
            ]
            stop = stop if stop == GIVEN_OUT else max(stop, int(batch["stop"].max()))
        given_out = stop == GIVEN_OUT
        runs = [] if given_out else _merged(runs)
        whole = next((r for r in runs if r[0] <= first_seq and r[1] >= stop), None) if stop >= 0 else None
        if whole:
            runs, given_out = [], True
        state.update(([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], [r[3].tolist() for r in runs], GIVEN_OUT if given_out else stop))
        if give_up_after_ms:
            state.setTimeoutDuration(give_up_after_ms)
        if whole:
            first, _, text, sizes = whole
            begin, end = int(sizes[: first_seq - first].sum()), int(sizes[: stop + 1 - first].sum())
            yield pd.DataFrame({"message_id": [key[0]], "text": [text[begin:end]], "complete": [True]})

    pieces = read_events(events, payload).select(
        "message_id",
        "seq",
        F.coalesce("piece", F.lit("")).alias("piece"),  # events without text stay, so that gaps can be seen
        F.coalesce(F.col("kind") == STOP, F.lit(False)).alias("stop"),
    )
    return (
        pieces.mapInPandas(join_neighbours, _RUNS)
        .groupBy("message_id")
        .applyInPandasWithState(
            collect,
            "message_id bigint, text string, complete boolean",
            _STATE,
            "append",
            GroupStateTimeout.ProcessingTimeTimeout if give_up_after_ms else GroupStateTimeout.NoTimeout,
        )
    )
