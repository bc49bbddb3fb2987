"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the whole corpus.

A byte-level tokenizer (A) of the ``tokenizers`` library encodes a space and the text, a ``sentencepiece`` model (B) the
text, to which it adds the space itself. Each token covers a range of bytes. Where tokens of A and B end at the same
byte lies a shared cut. The cuts are found by divide and conquer: in an interval of tokens the shared end nearest to the
middle is looked for by bisection in the other tokenizer's ends, and both halves go on; an interval without one
is a leaf group. A link is a pair of occurrences, one of A and one of B, whose ranges overlap.

Neither tokenizer joins anything across a single space between two characters that are no white space, so every such space
is a cut known beforehand: the pieces between them are encoded and aligned once for many occurrences, all new pieces of a
batch together, and a text's result is put together from those of its pieces. A text with a piece that does not come
back byte by byte is encoded as one piece.

Documents go by in parts of about ``PART_BYTES`` of text (a longer text is a part of its own). A part is one saved
row: its documents as numbers of pieces, its pieces as numbers of id pairs, and its distinct id pairs with their
counts. Only those pairs meet the corpus-wide counts; these come back to the part as one table, from
which the documents' sums are taken. So no task holds more than a part, and no vocabulary is broadcast.

Cases: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros
and no groups. Special tokens' strings are plain text. Rows with the same ``doc_id`` and null ids are rows of their own, and
repeated texts count as often as they come. Ids of equal counts are all best. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import Pieces, slices
from rejoinder.llm.tokenbin import pack, unpack
from rejoinder.plans.session import saved

PART_BYTES = 16 << 20
# pieces remembered by a task when it begins a part; beyond it the task starts anew
REMEMBERED = 200_000
# new pieces aligned together
TOGETHER = 100_000
# ends tried beside the middle at first; doubled while none is shared
NEAR = 3
CUT = re.compile(r"(?<=\S) (?=\S)")
# white space beside a space: some spaces are no cuts
LOOSE = re.compile(r"\s | \s|^ | \Z")
SPACE = "▁"


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Numbers of the A tokens behind which lies a shared cut, in order.

    Both arrays hold ascending byte offsets. Interval ``i`` has the A tokens ``first[i]`` to ``last[i]``, whose last end is
    shared. All intervals of one depth are worked on together.
    """
    cuts = [last]
    lo, hi = first, last  # ends lo to hi - 1 lie within
    while True:
        open_ = lo < hi
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            return np.sort(np.concatenate(cuts))
        middle = (lo + hi - 1) // 2
        found = np.full(len(lo), -1)
        pending, tried, reach = np.arange(len(lo)), 0, NEAR
        while len(pending):
            away = np.arange(tried, reach)
            steps = np.stack([away, -away], axis=1).ravel()  # the nearest first
            at = middle[pending, None] + steps
            inside = (at >= lo[pending, None]) & (at < hi[pending, None])
            ends = a_ends[np.where(inside, at, 0)]
            match = inside & (b_ends[np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)] == ends)
            best = match.argmax(axis=1)
            hit = match.any(axis=1)
            found[pending[hit]] = at[hit, best[hit]]
            rest = ~hit & inside.any(axis=1)
            pending, tried, reach = pending[rest], reach, 2 * reach
        split = found >= 0
        cut = found[split]
        cuts.append(cut)
        lo, hi = np.concatenate([lo[split], cut + 1]), np.concatenate([cut, hi[split]])


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it can be seen, else the next from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: ids of texts and the bytes of each id."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        vocabulary, byte = self.tokenizer.get_vocab(with_added_tokens=True), byte_letters()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte for c in token):
                self.bytes[i] = bytes(byte[c] for c in token)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]


class WordPieces:
    """Tokenizer B: ids of texts, to which it adds a space, and the bytes of each id."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        size, name = self.model.get_piece_size(), self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[1:-1], 16)]) if self.model.is_byte(i) else name(i).replace(SPACE, " ").encode() for i in range(size)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and where each list begins, with the end of the last."""
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=starts[1:])
    return np.fromiter(chain.from_iterable(ids), np.int64, starts[-1]), starts


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b << 32) | a


class Aligner:
    """Numbers distinct pieces of text and remembers what the two tokenizers make of each."""

    def __init__(self, tokenizer_json: str, model: bytes):
        self.a, self.b = ByteLevel(tokenizer_json), WordPieces(model)
        self.lengths = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        # an id as it is written within a list, and as the last of its list
        texts = [[f"{i},", f"{i}|"] for i in range(len(self.a.bytes))] + [[f"{i},", f"{i};"] for i in range(len(self.b.bytes))]
        self.written = np.array(texts, dtype=object)
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()
        self.sizes = np.zeros((0, 3), dtype=np.int64)  # A tokens, B tokens, groups
        self.right = np.zeros(0, dtype=bool)
        self.groups: list[str] = []  # with a ";" behind each group
        self.links = np.zeros(0, dtype=np.int64)  # id pairs of all pieces
        self.link_ends = np.zeros(1, dtype=np.int64)

    def words(self, text: str) -> list[str]:
        return CUT.split(text) if LOOSE.search(text) else text.split(" ")

    def learn(self) -> None:
        new = self.known.take_new()
        for at in range(0, len(new), TOGETHER):
            self.learn_some(new[at : at + TOGETHER])

    def learn_some(self, words: list[str]) -> None:
        both = [flat(t.encode(words)) for t in (self.a, self.b)]
        wanted = [(" " + w).encode("utf-8", "surrogatepass") for w in words]
        joined = b"".join(wanted)
        size = np.fromiter(map(len, wanted), np.int64, len(words))
        ends = [np.cumsum(length[ids]) for length, (ids, _) in zip(self.lengths, both)]
        whole = all(
            len(e) and e[-1] == len(joined) and np.array_equal(e[starts[1:] - 1], np.cumsum(size)) and (starts[1:] > starts[:-1]).all()
            and b"".join(map(t.bytes.__getitem__, ids.tolist())) == joined
            for t, e, (ids, starts) in zip((self.a, self.b), ends, both)
        )
        right = np.ones(len(words), dtype=bool)
        if not whole:
            for t, (ids, starts) in zip((self.a, self.b), both):
                got = ids.tolist()
                for i, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    right[i] &= y > x and b"".join(map(t.bytes.__getitem__, got[x:y])) == wanted[i]
            # the others have no tokens
            kept = np.flatnonzero(right)
            for k, (ids, starts) in enumerate(both):
                n = np.where(right, np.diff(starts), 0)
                own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in kept]) if len(kept) else np.zeros(0, dtype=np.int64)
                both[k] = ids[own], np.concatenate([[0], np.cumsum(n)])
            ends = [np.cumsum(length[ids]) for length, (ids, _) in zip(self.lengths, both)]
        self.add(both, ends, right)

    def add(self, both: list[tuple[np.ndarray, np.ndarray]], ends: list[np.ndarray], right: np.ndarray) -> None:
        (a_ids, a_starts), (b_ids, b_starts) = both
        a_ends, b_ends = ends
        cuts = shared_cuts(a_ends, b_ends, a_starts[:-1][right], a_starts[1:][right] - 1)
        offsets = a_ends[cuts]
        b_cuts = np.searchsorted(b_ends, offsets)
        # tokens of A and B of each group, one after the other
        a_first, b_first = np.concatenate([[0], cuts[:-1] + 1])[: len(cuts)], np.concatenate([[0], b_cuts[:-1] + 1])[: len(cuts)]
        a_n, b_n = cuts - a_first + 1, b_cuts - b_first + 1
        last_a, last_b = np.zeros(len(a_ids), dtype=np.int64), np.zeros(len(b_ids), dtype=np.int64)
        last_a[cuts], last_b[b_cuts] = 1, 1
        out = np.empty(len(a_ids) + len(b_ids), dtype=object)
        out[np.arange(len(a_ids)) + np.repeat(b_first, a_n)] = self.written[a_ids, last_a]
        out[np.arange(len(b_ids)) + np.repeat(cuts + 1, b_n)] = self.written[len(self.a.bytes) + b_ids, last_b]
        edges = a_starts + b_starts
        listed = out.tolist()
        groups = ["".join(listed[x:y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        # between two neighbouring ends of either kind lies one link
        every = np.union1d(a_ends, b_ends)
        links = pair_of(a_ids[np.searchsorted(a_ends, every)], b_ids[np.searchsorted(b_ends, every)])
        in_group = np.searchsorted(cuts, a_starts)
        n_groups = np.diff(in_group)
        n_a, n_b = np.diff(a_starts), np.diff(b_starts)
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups], axis=1)])
        self.right = np.concatenate([self.right, right])
        self.groups += groups
        self.links = np.concatenate([self.links, links])
        self.link_ends = np.concatenate([self.link_ends, self.link_ends[-1] + np.cumsum(n_a + n_b - n_groups)])

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The pieces of each text; none for a text without tokens."""
        number = self.known.__getitem__
        found = []
        for text in texts:
            words = self.words(text) if text else []
            found.append(np.fromiter(map(number, words), np.int64, len(words)))
        self.learn()
        odd = [i for i, f in enumerate(found) if not self.right[f].all()]
        for i in odd:
            found[i] = np.array([number(texts[i])])
        self.learn()
        for i in odd:
            found[i] = found[i][self.right[found[i]]]
        return found


class Part:
    """Documents of one part, gathered until it is full."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.pieces = 0, [], []

    def add(self, ids: pa.Array, pieces: list[np.ndarray], size: int) -> None:
        self.ids.append(ids)
        self.pieces += pieces
        self.bytes += size

    def row(self, part: int, aligner: Aligner) -> pa.RecordBatch:
        ends = np.cumsum(np.fromiter(map(len, self.pieces), np.int64, len(self.pieces)))
        sequence = np.concatenate(self.pieces)
        used, local = np.unique(sequence, return_inverse=True)
        first, last = aligner.link_ends[used], aligner.link_ends[used + 1]
        n = last - first
        reached = np.cumsum(n)
        own = aligner.links[np.repeat(first - (reached - n), n) + np.arange(n.sum())]
        pairs, of_link = np.unique(own, return_inverse=True)
        times = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(times, of_link, np.repeat(np.bincount(local, minlength=len(used)), n))
        sums = sums_of(aligner.sizes[sequence], ends)
        groups = []
        for p in self.pieces:
            text = "".join(map(aligner.groups.__getitem__, p.tolist()))
            groups.append(sha256(text[:-1].encode()).hexdigest() if text else "")
        ids = pa.concat_arrays(self.ids)
        whole = lambda array: pa.ListArray.from_arrays([0, len(array)], array)
        numbers = lambda array: pa.array([pack(array.astype(np.uint32))], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part]), whole(ids), *[whole(pa.array(c)) for c in sums.T], whole(pa.array(groups, pa.string())), whole(pa.array(ends)),
                numbers(local), whole(pa.array(n)), numbers(of_link), whole(pa.array(pairs)), whole(pa.array(times)),
            ],
            names=["part", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ends", "pieces", "piece_links", "links", "pair", "times"],
        )


def sums_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, of which some may be empty."""
    total = np.concatenate([np.zeros((1, values.shape[1]), dtype=values.dtype), np.cumsum(values, axis=0)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)]


def parts(docs: DataFrame, tokenizer_json: str, model: bytes, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each part of the documents: see the module's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((tokenizer_json, model))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, n = None, Part(), 0
        task = TaskContext.get().partitionId() << 32
        for batch in slices(batches, most=part_bytes // 4):
            aligner = aligner or Aligner(*shipped.value)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if part.ids and part.bytes + size > part_bytes:
                yield part.row(task + n, aligner)
                part, n = Part(), n + 1
                if len(aligner.known) > REMEMBERED:
                    aligner.forget()
            part.add(batch.column("doc_id"), aligner.numbered(texts), size)
        if part.ids:
            yield part.row(task + n, aligner)

    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        f"part bigint, doc_id array<{kind}>, {longs}, groups_sha256 array<string>, ends array<bigint>, pieces binary, piece_links array<bigint>, "
        "links binary, pair array<bigint>, times array<bigint>",
    )


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold the id pair, and whether no other has more with its B id.

    ``pair`` has the B id in its upper and the A id in its lower 32 bits.
    """
    each = stored.select(F.explode(F.arrays_zip("pair", "times")).alias("_p")).select("_p.pair", "_p.times")
    totals = saved(each.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    most = totals.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("n").alias("most"))
    return totals.join(most, F.shiftright("pair", 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, tokenizer_json: str, model: bytes, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = saved(parts(docs, tokenizer_json, model, part_bytes), "aligned-parts")
    own = stored.select(F.col("part").alias("of_part"), F.posexplode("pair").alias("pos", "pair"))
    rated = own.join(pair_counts(stored), "pair").select("of_part", "pos", "n", "best")
    return (
        stored.drop("pair", "times")
        .groupBy("part")
        .cogroup(rated.groupBy("of_part"))
        .applyInArrow(
            documents_of_part,
            f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        )
    )


def documents_of_part(part: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one part, with sums over its links: ``pairs`` are those of the part, in any order."""
    row = {c: part.column(c)[0] for c in part.column_names}
    whole = lambda name: row[name].values.to_numpy(zero_copy_only=False)
    # a link, whether it is best, and its count
    value = np.zeros((pairs.num_rows, 3), dtype=np.int64)
    order = pairs.column("pos").to_numpy()
    value[:, 0] = 1
    value[order, 1] = pairs.column("best").to_numpy(zero_copy_only=False)
    value[order, 2] = pairs.column("n").to_numpy()
    links = unpack(row["links"].as_py()).astype(np.int64)
    of_piece = sums_of(value[links], np.cumsum(whole("piece_links")).astype(np.int64))
    sums = sums_of(of_piece[unpack(row["pieces"].as_py()).astype(np.int64)], whole("ends"))
    return pa.table(
        [row["doc_id"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups")], *map(pa.array, sums.T), row["groups_sha256"].values],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    )


