"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for every prefix, the sum of its code points times powers of a base, modulo a prime. The
difference of two entries, brought to the same power, is the hash of the span between them, so the equality of any two
spans is one comparison, and the longest common extension of two places is found by binary search over lengths.

A fingerprint has the hash of the whole text and a sketch: the ``SKETCH`` smallest scrambled hashes among all spans of
``SPAN`` code points, each read off the prefix arrays (the text begins behind ``SPAN`` - 1 blanks of its own, so that
every code point ends one span). The likeness of two fingerprints is the Dice share of common spans, estimated from the
smallest hashes of both sketches together; it is 1 for equal texts and about 2/3 if the last third differs.

Cases: a null text is an empty one; empty texts are equal to each other and have likeness 0 to any other. Rows with
the same ``doc_id`` come in order of their text; a null ``doc_id`` comes last. Texts of any length are read in pieces.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import partitions, slices, texts_of
from rejoinder.plans.session import saved

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_357, 1_903_147_021)
SPAN = 12
SKETCH = 64
# code points compared at first when two texts are held against each other
FIRST_STEP = 64
# code points worked on at a time
PIECE = 1 << 18


def mod(x: np.ndarray) -> np.ndarray:
    """Remainder by the Mersenne prime of values under 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base and of its inverse, as many as the longest piece needs."""

    def __init__(self, base: int, count: int):
        self.base, self.inverse = base, pow(base, -1, int(PRIME))
        self.up, self.down = self.row(self.base, count), self.row(self.inverse, count)

    @staticmethod
    def row(base: int, count: int) -> np.ndarray:
        out = np.ones(count, dtype=np.uint64)
        done = 1
        while done < count:  # the known part times the next power doubles it
            step = min(done, count - done)
            out[done : done + step] = mod(out[:step] * np.uint64(pow(base, done, int(PRIME))))
            done += step
        return out


class Prefixes:
    """Prefix arrays of one text for both bases."""

    def __init__(self, codes: np.ndarray, powers: list[Powers]):
        self.powers = powers
        values = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for p in powers:
            # fewer than 2**33 terms under 2**31 fit
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(mod(values * p.up[: len(codes)]), out=sums[1:])
            self.sums.append(mod(sums))

    def spans(self, starts: np.ndarray, length: int | np.ndarray) -> list[np.ndarray]:
        """Hashes of the spans, brought to the power of their first code point."""
        return [mod(mod(s[starts + length] + PRIME - s[starts]) * p.down[starts]) for s, p in zip(self.sums, self.powers)]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        a, b = self.spans(np.array([i]), length), other.spans(np.array([j]), length)
        return all(x[0] == y[0] for x, y in zip(a, b))

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest equal spans that begin at ``i`` here and at ``j`` in the other text."""
        low, high = 0, min(len(self.sums[0]) - 1 - i, len(other.sums[0]) - 1 - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values, so that the smallest ones are a fair sample."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    def __init__(self):
        self.powers = [Powers(b, PIECE + SPAN) for b in BASES]

    def smallest(self, codes: np.ndarray, begin: int, end: int, kept: np.ndarray) -> np.ndarray:
        """The smallest distinct scrambled hashes among ``kept`` and the spans that end at ``begin`` to ``end``."""
        for at in range(begin, end, PIECE - SPAN):
            to = min(at + PIECE - SPAN, end)
            piece = np.zeros(to - at + SPAN - 1, dtype=np.uint32)  # blanks are 0, and code points count from 1
            lead = max(0, SPAN - 1 - at)
            piece[lead:] = codes[at - (SPAN - 1 - lead) : to] + np.uint32(1)
            a, b = Prefixes(piece, self.powers).spans(np.arange(to - at), SPAN)
            found = scramble((a << np.uint64(31)) | b)
            if len(found) > 4 * SKETCH:
                # equal spans may fill the smallest ones, so take more until enough are distinct
                want = 2 * SKETCH
                while True:
                    few = np.unique(np.partition(found, want - 1)[:want]) if want < len(found) else np.unique(found)
                    if len(few) >= SKETCH or want >= len(found):
                        break
                    want *= 4
                found = few
            kept = np.unique(np.concatenate([kept, found]))[:SKETCH]
        return kept

    def prefix(self, codes: np.ndarray, begin: int, state: tuple[int, int]) -> tuple[int, int]:
        """The prefix hashes at the end, from those at ``begin``."""
        out = list(state)
        for at in range(begin, len(codes), PIECE):
            values = codes[at : at + PIECE].astype(np.uint64) + np.uint64(1)
            for k, p in enumerate(self.powers):
                part = int(mod(values * p.up[: len(values)]).sum()) % int(PRIME)
                out[k] = (out[k] + part * pow(p.base, at, int(PRIME))) % int(PRIME)
        return out[0], out[1]

    def begin(self, codes: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
        """Prefix hashes and sketch of a text, to be carried on."""
        return self.prefix(codes, 0, (0, 0)), self.smallest(codes, 0, len(codes), np.array([], dtype=np.uint64))

    def carry_on(self, codes: np.ndarray, begin: int, state: tuple[tuple[int, int], np.ndarray]) -> bytes:
        """The fingerprint of a text whose first ``begin`` code points gave the state."""
        return pack(len(codes), self.prefix(codes, begin, state[0]), self.smallest(codes, begin, len(codes), state[1]))

    def fingerprint(self, codes: np.ndarray) -> bytes:
        return self.carry_on(codes, len(codes), self.begin(codes))


def pack(length: int, whole: tuple[int, int], sketch: np.ndarray) -> bytes:
    """Length, hashes of the whole text, and the upper halves of the sketch's values in ascending order."""
    head = np.array([length >> 32, length & 0xFFFFFFFF, *whole], dtype=">u4").tobytes()
    return head + (sketch >> np.uint64(32)).astype(">u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1: 1 for equal texts, else the estimated Dice share of common spans."""
    if a == b:
        return 1.0
    x, y = np.unique(np.frombuffer(a[16:], dtype=">u4")), np.unique(np.frombuffer(b[16:], dtype=">u4"))
    if not len(x) or not len(y):
        return 0.0
    small = np.unique(np.concatenate([x, y]))[:SKETCH]
    common = np.isin(small, x, assume_unique=True) & np.isin(small, y, assume_unique=True)
    jaccard = common.sum() / len(small)
    return float(2 * jaccard / (1 + jaccard))


def common_prefix(a: np.ndarray, b: np.ndarray, powers: list[Powers], begin: int = 0) -> int:
    """How many code points two texts share from ``begin`` on, by their prefix hashes: in steps of growing length as
    long as these are equal, then by binary search within the first that is not. The first few are just compared."""
    most = min(len(a), len(b))
    at, step = min(begin + FIRST_STEP, most), 4 * FIRST_STEP
    other = np.flatnonzero(a[begin:at] != b[begin:at])
    if len(other):
        return int(other[0])
    while at < most:
        to = min(at + step, most)
        one, other = Prefixes(a[at:to], powers), Prefixes(b[at:to], powers)
        shared = to - at if one.equal(0, other, 0, to - at) else one.common_extension(0, other, 0)
        at += shared
        if shared < to - (at - shared):
            break
        step = min(2 * step, PIECE)
    return at - begin


def edited_text(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Document:
    """A text with its fingerprint, and the state before its last third."""

    def __init__(self, doc_id: object, text: str, hasher: Hasher):
        self.doc_id, self.text, self.hasher, self.codes = doc_id, text, hasher, code_points(text)
        self.kept = len(text) - len(text) // 3
        self.state = hasher.begin(self.codes[: self.kept])
        self.print = hasher.carry_on(self.codes, self.kept, self.state)

    def row(self, following: str, next_print: bytes, next_codes: np.ndarray | None = None) -> tuple:
        """What is said of the document once the text behind it is known."""
        edited = edited_text(self.text, following)
        codes = self.codes if edited == self.text else code_points(edited)
        edited_print = self.print if edited == self.text else self.hasher.carry_on(codes, self.kept, self.state)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.print, edited_print), likeness(self.print, next_print)
        # the edited text is the same up to its last third
        edited_prefix = self.kept + common_prefix(self.codes, codes, self.hasher.powers, self.kept)
        next_prefix = common_prefix(self.codes, code_points(following) if next_codes is None else next_codes, self.hasher.powers)
        return self.doc_id, len(self.text), digest, self.print, edited_print, *near, edited_prefix, next_prefix


def described(docs: DataFrame) -> DataFrame:
    """(part, doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, edited_prefix, next_prefix, head, head_fp,
    tail): one row a document. The two prefixes are the lengths that the text shares with the edited and the next one.

    Parts hold descending ranges of ``doc_id``. The last document of a part waits for the first of the next: it comes
    with its text in ``tail`` and without what needs its neighbour. The first one's text is in ``head``, its fingerprint in
    ``head_fp``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hasher = TaskContext.get().partitionId(), Hasher()
        waiting, first, id_type = None, None, None
        for batch in slices(batches, most=4 << 20):
            rows, id_type = [], batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                now = Document(doc_id, text, hasher)
                if waiting is None:
                    first = (text, now.print)
                else:
                    rows.append((part, *waiting.row(text, now.print, now.codes), None, None, None))
                waiting = now
            yield as_batch(rows, id_type)
        if waiting is not None:
            yield as_batch([(part, waiting.doc_id, len(waiting.text), None, waiting.print, *[None] * 5, *first, waiting.text)], id_type)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"part int, doc_id {kind}, {RESULT}, head string, head_fp binary, tail string")


RESULT = "n_chars bigint, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, edited_prefix bigint, next_prefix bigint"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "edited_prefix", "next_prefix"]


def as_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    fields = [
        ("part", pa.int32()), ("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()),
        ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("edited_prefix", pa.int64()), ("next_prefix", pa.int64()), ("head", pa.string()), ("head_fp", pa.binary()), ("tail", pa.string()),
    ]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns ``COLUMNS`` for every document. One shuffle of the texts.

    The next document is that of the next smaller ``doc_id``; the first one follows the last.
    """
    found = saved(described(docs), "fingerprints")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one row for each part, of which there are as many as shuffle partitions
    heads = found.filter("head is not null").select("part", F.struct("head", "head_fp").alias("own"))
    tails = found.filter("tail is not null").select("part", "doc_id", "tail", F.col("fp").alias("tail_fp"))
    order = Window.orderBy("part")
    follow = F.coalesce(F.lead("own").over(order), F.first("own").over(order))
    ends = tails.join(heads, "part").select("doc_id", "tail", "tail_fp", follow.alias("follow"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i in range(batch.num_rows):
                doc = Document(batch.column("doc_id")[i].as_py(), batch.column("tail")[i].as_py(), hasher)
                row = doc.row(batch.column("head")[i].as_py(), batch.column("head_fp")[i].as_py())
                yield as_batch([(0, *row, None, None, None)], batch.schema.field("doc_id").type).select(COLUMNS)

    last = ends.select("doc_id", "tail", "follow.*").mapInArrow(run, f"doc_id {kind}, {RESULT}")
    return found.filter("tail is null").select(*COLUMNS).union(last)
