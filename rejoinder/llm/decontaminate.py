"""Benchmark decontamination with a positional inverted index.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A benchmark item gives one
window for every ``window`` consecutive words, or one for all its words if it has fewer.

1. Test terms: the words of the windows. Their number of occurrences in the whole corpus is counted.
2. Index: each document's posting lists (term, positions) of test terms. The lists of the two rarest terms of every
   window are intersected, shifted by the terms' places in the window; where the intersection is empty for all
   windows a document's lists are not stored, since no window can occur in it.
3. Search: over the stored lists, every window's lists are intersected from the rarest on. What is left are the exact
   places of the phrase; ``proximity`` gives the places where the terms occur close together in any order.

The windows are worked through in blocks of at most ``BLOCK_WINDOWS``, each with a pass over the documents to count its
terms and one to index them, so a benchmark of any size needs only one block in memory at a time. Documents are never shuffled; the index is split by document, so a passage that a third of
the documents share is spread like any other row.

Cases: null texts and texts without words have no words, no windows and no hits. Items or documents with the same id
are rows of their own (an item id counts once for a document). Null item ids are skipped, as they cannot be named. An
empty benchmark hits nothing. Of equally rare terms of a window the earlier one counts as rarer. A null ``doc_id`` is a value
like any other. A text of any length is read whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import keyed_as, rows_by_key, slices, text_key, texts_of
from rejoinder.plans.session import saved

# windows by number, with their terms and items
Block = dict[int, tuple[list[bytes], list[str]]]
WINDOW = 10
# windows whose terms are held in memory at a time
BLOCK_WINDOWS = 20_000
#: bytes of words stay, A-Z get small, all others part words
FOLD = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(terms, items): the distinct windows, each with the sorted ids of the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch)):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    items.append(item)
                    terms.append(words[i : i + size])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(terms, pa.list_(pa.string()))], names=["item", "terms"])

    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return (
        rows.mapInArrow(run, "item string, terms array<string>")
        .groupBy("terms")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.monotonically_increasing_id().alias("window"), "terms", "items")
    )


def blocks(found: DataFrame, most: int) -> Iterator[Block]:
    """The windows by number, at most ``most`` at a time."""
    block: Block = {}
    for row in found.toLocalIterator():
        block[row["window"]] = ([t.encode("utf-8", "surrogatepass") for t in row["terms"]], row["items"])
        if len(block) == most:
            yield block
            block = {}
    if block:
        yield block


def term_counts(docs: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of the terms, those of one block, occurs in all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                total.update(filter(shipped.value.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term binary, n bigint")
    return {bytes(r["term"]): r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def by_rarity(terms: list[bytes], counts: dict[bytes, int]) -> list[int]:
    """Places of the window's distinct terms, the rarest in the corpus first."""
    first = {t: i for i, t in reversed(list(enumerate(terms)))}
    return sorted(first.values(), key=lambda i: (counts.get(terms[i], 0), i))


def plan_of(block: Block, counts: dict[bytes, int]) -> dict:
    """A block of windows made ready for one pass over documents, as plain values that any worker can read."""
    terms = {w: own for w, (own, _) in block.items()}
    order = {w: by_rarity(own, counts) for w, own in terms.items()}
    # rarest term -> windows, with the places of the rarest and the second rarest
    anchors: dict[bytes, list[tuple[int, int, int]]] = {}
    for w, places in order.items():
        if all(counts.get(t, 0) for t in terms[w]):
            anchors.setdefault(terms[w][places[0]], []).append((w, places[0], places[min(1, len(places) - 1)]))
    seeds = set(anchors) | {terms[w][b] for at in anchors.values() for w, _, b in at}
    return {"terms": terms, "order": order, "anchors": anchors, "seeds": seeds, "items": {w: items for w, (_, items) in block.items()}}


def candidates(plan: dict, words: list[bytes], near: bool = False) -> set[int]:
    """Windows whose two rarest terms lie as far apart as in the window; with ``near``, that have both terms."""
    lists: dict[bytes, list[int]] = defaultdict(list)
    seeds, terms, found = plan["seeds"], plan["terms"], set()
    for i, w in enumerate(words):
        if w in seeds:
            lists[w].append(i)
    for term in plan["anchors"].keys() & lists.keys():
        for window, a, b in plan["anchors"][term]:
            other = lists.get(terms[window][b])
            if other and (near or not {p - a for p in lists[term]}.isdisjoint([p - b for p in other])):
                found.add(window)
    return found


def index(docs: DataFrame, shipped: Broadcast, near: bool = False) -> DataFrame:
    """(doc_id, text_key, n_words, windows, terms, positions): the posting lists of each document for one block of windows.

    ``windows`` are those whose two rarest lists meet; ``terms`` and ``positions`` are the lists of their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for batch in slices(batches):
            n_words, found, terms, positions = [], [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                met = candidates(plan, words, near)
                lists: dict[bytes, list[int]] = {t: [] for w in met for t in plan["terms"][w]}
                if lists:
                    for i, w in enumerate(words):
                        if w in lists:
                            lists[w].append(i)
                n_words.append(len(words))
                found.append(sorted(met))
                terms.append(list(lists))
                positions.append(list(lists.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.int64())),
                    pa.array(terms, pa.list_(pa.binary())), pa.array(positions, pa.list_(pa.list_(pa.int32()))),
                ],
                names=["doc_id", "text_key", "n_words", "windows", "terms", "positions"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, text_key bigint, n_words bigint, windows array<bigint>, terms array<binary>, positions array<array<int>>"
    )


def exact_starts(terms: list[bytes], order: list[int], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Where the phrase begins: the terms' lists shifted by their places and intersected, the rarest first."""
    # a term that occurs again in the window has to be at all its places
    again = [i for i in range(len(terms)) if i not in set(order)]
    starts = lists[terms[order[0]]] - order[0]
    for i in [*order[1:], *again]:
        if not len(starts):
            break
        own = lists[terms[i]] - i
        starts = starts[np.isin(starts, own, assume_unique=True)]
    return starts


def near_starts(terms: list[bytes], order: list[int], lists: dict[bytes, np.ndarray], slack: int) -> np.ndarray:
    """Places of the rarest term with every other term at most ``len(terms) + slack - 1`` words away."""
    reach = len(terms) + slack - 1
    at = lists[terms[order[0]]]
    for i in order[1:]:
        own = lists[terms[i]]
        if not len(at) or not len(own):
            return at[:0]
        k = np.searchsorted(own, at)
        below = np.abs(at - own[np.maximum(k - 1, 0)])
        above = np.abs(own[np.minimum(k, len(own) - 1)] - at)
        at = at[np.minimum(below, above) <= reach]
    return at


def lists_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int], dict[bytes, np.ndarray]]]:
    """Of each stored document the windows and the posting lists."""
    for found, terms, positions in zip(*(batch.column(c).to_pylist() for c in ("windows", "terms", "positions"))):
        yield found, {t: np.array(p, dtype=np.int64) for t, p in zip(terms, positions)}


def search(stored: DataFrame, shipped: Broadcast) -> DataFrame:
    """(doc_id, text_key, n_words, hits, items): hit word positions and items of each indexed document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for batch in batches:
            hits, named = [], []
            for found, lists in lists_of(batch):
                covered, names = [np.array([], dtype=np.int64)], set()
                for w in found:
                    starts = exact_starts(plan["terms"][w], plan["order"][w], lists)
                    if len(starts):
                        names.update(plan["items"][w])
                        covered.append((starts[:, None] + np.arange(len(plan["terms"][w]))).ravel())
                hits.append(np.unique(np.concatenate(covered)))
                named.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), batch.column("n_words"),
                    pa.array(hits, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string())),
                ],
                names=["doc_id", "text_key", "n_words", "hits", "items"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, text_key bigint, n_words bigint, hits array<bigint>, items array<string>")


def near_places(stored: DataFrame, shipped: Broadcast, slack: int) -> DataFrame:
    """(doc_id, item_id, position) of each indexed document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for batch in batches:
            rows, names, places = [], [], []
            for i, (found, lists) in enumerate(lists_of(batch)):
                hits = {
                    (item, at)
                    for w in found
                    for at in near_starts(plan["terms"][w], plan["order"][w], lists, slack).tolist()
                    for item in plan["items"][w]
                }
                for item, at in sorted(hits):
                    rows.append(i)
                    names.append(item)
                    places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int64())],
                names=["doc_id", "item_id", "position"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, item_id string, position bigint")


def of_blocks(docs: DataFrame, benchmark: DataFrame, window: int, most: int, near: bool, find: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """What ``find`` makes of the index, of all blocks of windows one after the other; an empty benchmark is one empty block.

    A block's results are written before the next one begins, and its windows leave the workers.
    """
    parts = []
    for block in chain(blocks(saved(windows(benchmark, window), "windows"), most), [None]):
        if block is None and parts:
            break
        block = block or {}
        counts = term_counts(docs, {t for terms, _ in block.values() for t in terms}) if block else {}
        shipped = docs.sparkSession.sparkContext.broadcast(plan_of(block, counts))  # one block
        found = find(saved(index(docs, shipped, near), "postings"), shipped)
        parts.append(saved(found.withColumn("block", F.lit(len(parts))), "found"))
        shipped.destroy()
    return reduce(DataFrame.union, parts)


def proximity(docs: DataFrame, phrases: DataFrame, slack: int = 5, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, position): places where all terms of a window of an item lie close together, in any order.

    ``position`` is that of the window's rarest term; each other term is at most ``window + slack - 1`` words away.
    """
    return of_blocks(docs, phrases, window, block_windows, True, lambda stored, shipped: near_places(stored, shipped, slack)).drop("block").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) for every row of ``docs``."""
    keys = ["doc_id", "text_key"]
    # repeated rows have equal results, so they are counted in each block and come back as often at the end
    each = of_blocks(docs, benchmark, window, block_windows, False, search)
    by_block = each.groupBy(*keys, "block").agg(
        F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"), F.first("hits").alias("hits"), F.first("items").alias("items")
    )
    merged = by_block.groupBy(*keys).agg(
        F.first("n_words").alias("n_words"),
        F.first("copies").alias("copies"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return merged.select(*keys, "n_words", "n_hit", "items", again.alias("_copy")).drop("_copy")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without any benchmark window, whole, with their columns as they were."""
    hit = contamination(docs, benchmark, window).filter("n_hit > 0").select("doc_id", "text_key").distinct()
    return rows_by_key(docs).join(hit, keyed_as(hit), "left_anti").select("_row.*")
