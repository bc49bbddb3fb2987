"""Toxicity of whole texts by a support vector machine on a subsequence string kernel.

The kernel compares two strings by the subsequences of three letters they share; a letter skipped in between costs
a factor ``DECAY``, so an insult with inserted, dropped or changed characters stays close to itself. Landmarks are the
words that mark toxic training texts best and those of clean training texts that look most like them. The Nystroem map
turns a string's kernel values at the landmarks into a vector, and one linear machine with squared hinge loss is
trained on these.

A text's sentences are cut into segments: the letters of each word, the runs of letters between punctuation, windows
of long words, and single letters joined ("i d i o t"). A sentence has its text's label and is decided by
its most toxic segment, so the machine learns from segments that stand for their sentence: the marking words of toxic texts
against the strongest segments of clean ones, which are looked up again with the machine of the round before. The machine is
linear in the subsequences, so its decision on a string is a sum of one weight for each of them, over the string's norm.

A text is decided by its most toxic segment and by how many segments a hundred words are on the toxic side. How these
two are weighed, and the threshold, come from decisions on training texts by machines that have not seen them, one for each of
``PARTS`` folds: of the thresholds with the fewest errors one near the clean side, as obfuscated insults lie there.

Only labels of rows that :func:`held_out` leaves are learned from, at most ``SAMPLE_ROWS`` of them, chosen by a hash of
the id. All rows are scored, and no pair of string and landmark is skipped.

Cases: null and empty texts have no segments and get the score of a text without any; without labelled rows, or any word
that marks toxic ones, every score is 0, and with toxic labels alone it is 1. Null labels are no labels; an id labelled
twice counts as toxic if one of its labels is; labels of a null id are not used, but such rows are scored. Of landmarks of
equal weight the first in alphabetical order are taken. Repeated rows are rows of their own. A text of any length is read whole, a
batch at a time. All other columns pass through; the score replaces a column of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import Pieces, replaced, slices, text_key, texts_of, with_column
from rejoinder.plans.session import saved

ORDER = 3
DECAY = 0.85
# marking words and clean words that look like them
LANDMARKS, LOOK_ALIKES = 96, 96
# how many standard deviations above chance a word's share of toxic texts has to be: see mark_words
SURELY, LEAST = 1.64, 1.0
SAMPLE_ROWS = 20_000
FOLDS = 5
# folds of the training rows that choose the threshold; share of the way from the clean side where it lies
PARTS, TOLERANT = 3, 0.25
# of clean training texts the strongest segments, and how many distinct ones a machine learns from
STRONGEST, HARDEST = 3, 8_000
STRENGTH = 3e-4
# letters of a segment; windows are laid over longer words, with room for so many letters put into a landmark
PIECE = 16
GAPS = 2
SHORTEST_LANDMARK, LONGEST_LANDMARK = 4, 12
# strings measured at a time, letters of a very long word
PAIRS = 1_024
SOME = 2_000
# subsequences of the landmarks' letters that are looked up in an array, 4 bytes each
DENSE = 4_000_000
# words remembered by a task before it starts anew
REMEMBERED = 150_000
# bytes of text that a task works on at a time
TEXTS = 2 << 20
NOT_LETTERS = re.compile(r"[\W\d_]+")
# by length: a plain dict, which workers get with the functions that use it
PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring only; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letters(words: list[str]) -> np.ndarray:
    """Code points of each string, at most ``PIECE``, filled up with zeros."""
    return np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)


def kernel(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each row's string with that of ``others`` (one, or one for each row)."""
    others = np.broadcast_to(others, (len(rows), others.shape[-1]))
    length = rows.shape[1] - (rows[:, ::-1] != 0).argmax(axis=1)
    order, total = np.argsort(length, kind="stable"), np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS):  # strings of about one length at a time
        own = order[at : at + PAIRS]
        total[own] = kernel_of_some(rows[own, : max(1, length[own[-1]])].T, others[own].T)
    return total


def kernel_of_some(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """As above for strings in columns. ``levels[i]`` are sums over i + 1 shared letters by where the last one lies."""
    rows, others = np.ascontiguousarray(rows), np.ascontiguousarray(others)
    width, count = others.shape
    decay, used = np.float32(DECAY), others != 0
    apart = np.arange(width)[:, None] - np.arange(width)
    fade = np.where(apart >= 0, DECAY ** np.maximum(apart, 0), 0).astype(np.float32)
    levels = [np.zeros((width, count), dtype=np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(count, dtype=np.float32)
    for letter in rows:
        same = ((letter == others) & used).astype(np.float32) * (decay * decay)
        total += np.einsum("ij,ij->j", same[1:], levels[-1][:-1])
        for i in range(ORDER - 2, -1, -1):
            gain = same
            if i:
                gain = np.zeros_like(same)
                np.multiply(same[1:], levels[i - 1][:-1], out=gain[1:])
            levels[i] *= decay
            levels[i] += fade @ gain
    return total.astype(np.float64)


def own_kernel(rows: np.ndarray) -> np.ndarray:
    return kernel(rows, rows)


def subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a string of that length, and what each counts."""
    if length not in PLACES:
        at = np.array(list(combinations(range(length), ORDER)), dtype=np.int64).reshape(-1, ORDER).T
        PLACES[length] = at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)
    return PLACES[length]


class Weights:
    """A row of numbers for each known subsequence; a string's sums of them, over its norm, in columns."""

    def __init__(self, letters: np.ndarray, known: np.ndarray, table: np.ndarray):
        self.letters, self.known, self.table = letters, known, table
        # the row of each subsequence, the last one for unknown ones, if the alphabet is of usual size
        size = (len(letters) + 1) ** ORDER
        self.rows = None
        if size <= DENSE:
            self.rows = np.full(size, len(known), dtype=np.int32)
            self.rows[known] = np.arange(len(known))

    def keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each subsequence; those with an unknown letter get one that is not known."""
        place = np.searchsorted(self.letters, codes)
        own = np.where(self.letters[np.minimum(place, len(self.letters) - 1)] == codes, place + 1, 0) if len(self.letters) else np.zeros(codes.shape, dtype=np.int64)
        key = own[:, at[0]]
        for letter in at[1:]:
            key = key * (len(self.letters) + 1) + own[:, letter]
        return key

    def sums(self, strings: list[str]) -> np.ndarray:
        """Strings of at most ``PIECE`` letters. Only those without a known subsequence are left out: theirs are 0."""
        found = np.zeros((len(strings), self.table.shape[1]))
        if not len(self.known) or not strings:
            return found
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(length, kind="stable")
        for size in range(ORDER, PIECE + 1):
            own = order[np.searchsorted(length[order], size) : np.searchsorted(length[order], size, "right")]
            for at in range(0, len(own), PAIRS):
                some = own[at : at + PAIRS]
                found[some] = self.some([strings[i] for i in some.tolist()], size)
        return found

    def some(self, strings: list[str], size: int) -> np.ndarray:
        """Strings of one length."""
        codes = letters(strings)
        places, fade = subsequences(size)
        keys = self.keys(codes, places)
        if self.rows is not None:
            row = self.rows[keys]
        else:
            row = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            row = np.where(self.known[row] == keys, row, len(self.known))
        out = np.zeros((len(strings), self.table.shape[1]))
        near = np.flatnonzero((row < len(self.known)).any(axis=1))
        row, step = row[near], max(1, (1 << 20) // (len(fade) * self.table.shape[1]))
        for at in range(0, len(near), step):
            out[near[at : at + step]] = fade @ self.table[row[at : at + step]]
        out[near] /= np.sqrt(own_kernel(codes[near]))[:, None]
        return out


class Landmarks(Weights):
    """The landmarks' subsequences, so that a string is held against all of them at once."""

    def __init__(self, words: list[str]):
        codes = letters(words)
        norms = own_kernel(codes) if words else np.zeros(0)
        super().__init__(np.unique(codes[codes > 0]), np.zeros(0, dtype=np.int64), np.zeros((1, len(words)), dtype=np.float32))
        keys, values, landmark = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        for j, word in enumerate(words):
            places, fade = subsequences(min(len(word), PIECE))
            keys.append(self.keys(codes[j][None], places)[0])
            values.append(fade / np.sqrt(norms[j]))
            landmark.append(np.full(len(fade), j))
        known, row = np.unique(np.concatenate(keys), return_inverse=True)
        table = np.zeros((len(known) + 1, len(words)), dtype=np.float32)
        np.add.at(table, (row, np.concatenate(landmark)), np.concatenate(values))
        super().__init__(self.letters, known, table)
        self.words = words

    def gram(self) -> np.ndarray:
        return self.sums(self.words)

    def machines(self, weights: np.ndarray, bias: np.ndarray, sizes: list[int]) -> dict:
        """Machines given by weights of the landmarks, as weights of subsequences: plain arrays that any worker can read."""
        return {"letters": self.letters, "known": self.known, "weights": (self.table @ weights).astype(np.float32), "bias": np.asarray(bias, dtype=np.float64), "sizes": sizes}


class Segments:
    """Decisions of one or more machines on the segments of texts; each distinct word of a task is decided once, and words
    that differ in the marks around their letters only are decided together."""

    def __init__(self, machines: dict):
        self.weights = Weights(machines["letters"], machines["known"], machines["weights"])
        self.bias = np.asarray(machines["bias"], dtype=np.float64)
        self.sizes = machines["sizes"]
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()
        self.values = np.zeros((0, len(self.bias)))
        self.runs, self.run_values = Pieces(), np.zeros((0, len(self.bias)))
        self.single = np.zeros(0, dtype=bool)
        self.lettered = np.zeros(0, dtype=bool)
        self.strings: list[str | list[str]] = []  # what was decided; of windows the strongest for each machine

    def decide(self, strings: list[str]) -> np.ndarray:
        return self.weights.sums(strings) + self.bias

    def windows(self, word: str) -> list[str]:
        """At each letter a window of each landmark's length and with gaps."""
        return [word[i : i + n] for n in self.sizes if n < len(word) for i in range(len(word) - n + 1)] or [word]

    def strongest(self, runs: list[str], spelled: bool = False) -> tuple[np.ndarray, list[str]]:
        """The largest decisions over runs of letters, alone and joined, and the strings that have them."""
        best, names = np.full(len(self.bias), -np.inf), [""] * len(self.bias)
        glued = spelled or len(runs) > 1
        for whole, as_windows in [*((r, False) for r in runs if len(runs) > 1), ("".join(runs), glued)]:
            for at in range(0, len(whole), SOME):  # of a very long word some letters at a time
                part = whole[at : at + SOME + PIECE]
                strings = [part] if len(part) <= PIECE else []
                strings += self.windows(part) if as_windows or not strings else []
                found = self.decide(strings)
                for m, i in enumerate(found.argmax(axis=0).tolist()):
                    if found[i, m] > best[m]:
                        best[m], names[m] = found[i, m], strings[i]
        return best, names

    def learn(self) -> None:
        words = self.known.take_new()
        if not words:
            return
        runs = [[r for r in NOT_LETTERS.split(w) if r] if not w.isalpha() else [w] for w in words]
        plain = [i for i, r in enumerate(runs) if len(r) == 1 and len(r[0]) <= PIECE]
        values = np.tile(self.bias, (len(words), 1))
        at = [self.runs[runs[i][0]] for i in plain]
        self.run_values = np.concatenate([self.run_values, self.decide(self.runs.take_new())])
        values[plain] = self.run_values[at]
        strings: list[str | list[str]] = [r[0] if len(r) == 1 else "" for r in runs]
        for i, r in enumerate(runs):
            if len(r) > 1 or r and len(r[0]) > PIECE:
                values[i], strings[i] = self.strongest(r)
        self.values = np.concatenate([self.values, values])
        self.strings += strings
        self.single = np.concatenate([self.single, [sum(map(len, r)) == 1 for r in runs]])
        self.lettered = np.concatenate([self.lettered, [bool(r) for r in runs]])

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        number = self.known.__getitem__
        found = [np.fromiter(map(number, words), np.int64, len(words)) for words in (t.lower().split() for t in texts)]
        self.learn()
        return found

    def spelled(self, text: str, at: np.ndarray) -> list[tuple[np.ndarray, list[str]]]:
        """Runs of single letters, joined."""
        single = self.single[at]
        if np.count_nonzero(single) < ORDER:
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        runs = [(s, e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - s >= ORDER]
        words = text.lower().split() if runs else []
        return [self.strongest([NOT_LETTERS.sub("", "".join(words[s:e]))], True) for s, e in runs]

    def strong(self, extra: list[tuple[np.ndarray, list[str]]], at: np.ndarray, m: int) -> list[str]:
        """The strongest distinct segments of a text for a machine."""
        own = np.unique(at)
        best = own[np.argsort(-self.values[own, m], kind="stable")[:STRONGEST]].tolist()
        named = [(self.values[i, m], self.strings[i] if isinstance(self.strings[i], str) else self.strings[i][m]) for i in best]
        named += [(v[m], strings[m]) for v, strings in extra]
        return [s for _, s in sorted(named, key=lambda x: (-x[0], x[1]))[:STRONGEST] if len(s) >= ORDER]

    def facts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, list[str]]], np.ndarray]]:
        """For each text and machine the largest decision and the segments on the toxic side a hundred words; then its spelled
        words and the numbers of all others."""
        for text, at in zip(texts, self.numbered(texts)):
            extra = self.spelled(text, at)
            values = np.concatenate([self.values[at], *[v[None] for v, _ in extra]])
            largest = values.max(axis=0, initial=-np.inf, where=np.isfinite(values)) if len(values) else self.bias
            per_hundred = (values > 0).sum(axis=0) / (np.count_nonzero(self.lettered[at]) / 100 + 1)
            yield np.maximum(largest, self.bias), per_hundred, extra, at


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(toxic, text, part): distinct labelled texts outside the held-out fold, of at most ``sample_rows`` ids."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most sample_rows ids
    rows = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).withColumn("_key", text_key())
    one = rows.groupBy("_key").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    return one.select("toxic", "text", F.pmod(F.xxhash64("_key"), F.lit(PARTS)).cast("int").alias("part"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, part, toxic, n): in how many training texts a word of usual length stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, int]] = Counter()
        for batch in slices(batches):
            for toxic, part, text in zip(batch.column("toxic").to_pylist(), batch.column("part").to_pylist(), texts_of(batch)):
                clean = {NOT_LETTERS.sub("", w) for w in set(text.lower().split())}
                seen.update((w, part, toxic) for w in clean if SHORTEST_LANDMARK <= len(w) <= LONGEST_LANDMARK)
        columns = list(zip(*seen)) or [(), (), ()]
        types = (pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, types), pa.array(list(seen.values()), pa.int64())], names=["word", "part", "toxic", "n"])

    return rows.mapInArrow(run, "word string, part int, toxic int, n bigint").groupBy("word", "part", "toxic").agg(F.sum("n").alias("n"))


def mark_words(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None, most: int) -> list[tuple[str, float, int, int]]:
    """Marking words with how surely they mark, and the toxic and clean texts they stand in.

    The words whose odds of standing in toxic texts over clean ones stay above chance when ``SURELY`` standard deviations are
    taken off. ``without`` leaves out a part.
    """
    size = lambda toxic: sum(n for (part, t), n in sizes.items() if t == toxic and part != without) + 1.0
    of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    kept = counts if without is None else counts.filter(F.col("part") != without)
    words = kept.groupBy("word").agg(of(1).alias("a"), of(0).alias("b")).filter("a > 0")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    surely = F.log(a / size(1)) - F.log(b / size(0)) - SURELY * F.sqrt(1 / a + 1 / b)
    top = words.withColumn("z", surely).filter(F.col("z") > LEAST).orderBy(F.desc("z"), "word").limit(most)
    return [(r["word"], r["z"], r["a"], r["b"]) for r in top.collect()]


def measured(rows: DataFrame, machines: dict) -> list:
    """For each training text what its machines say: ``SAMPLE_ROWS`` rows at most, each with some segments of clean texts."""
    shipped = rows.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = None
        for batch in slices(batches, most=TEXTS):
            segments = segments or Segments(shipped.value)
            largest, dense, strong, marks = [], [], [], batch.column("toxic").to_pylist()
            for toxic, (most, per_hundred, extra, at) in zip(marks, segments.facts(texts_of(batch))):
                largest.append(most.tolist())
                dense.append(per_hundred.tolist())
                strong.append([[] if toxic else segments.strong(extra, at, m) for m in range(len(most))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"), batch.column("part"), pa.array(largest, pa.list_(pa.float64())), pa.array(dense, pa.list_(pa.float64())),
                    pa.array(strong, pa.list_(pa.list_(pa.string()))),
                ],
                names=["toxic", "part", "largest", "dense", "strong"],
            )

    return rows.mapInArrow(run, "toxic int, part int, largest array<double>, dense array<double>, strong array<array<string>>").collect()


def machine(features: np.ndarray, signs: np.ndarray, times: np.ndarray, strength: float = STRENGTH, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes of equal weight; Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    cost = times / np.where(signs > 0, 2 * max(1, times[signs > 0].sum()), 2 * max(1, times[signs < 0].sum()))
    w = np.zeros(x.shape[1])
    ridge = strength * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        active = signs * (x @ w) < 1
        xa = x[active] * cost[active, None]
        step = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ signs[active])
        if np.allclose(step, w, atol=1e-10):
            break
        w = step
    return w[:-1], float(w[-1])


def nystroem(gram: np.ndarray) -> np.ndarray:
    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    return axes / np.sqrt(np.maximum(size, 1e-4)) @ axes.T


def fitted(marks: list[tuple[str, float, int, int]], clean: Counter) -> tuple[list[str], np.ndarray, float]:
    """Landmarks, their weights and the bias of one machine: marking words against segments of clean texts."""
    words = [w for w, *_ in marks]
    # the clean words that look most like marks have been met most often
    alike = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if w not in set(words)][:LOOK_ALIKES]
    landmarks = Landmarks([*words, *alike])
    instances = [*[(w, 1.0, a) for w, _, a, _ in marks], *[(w, -1.0, b) for w, _, _, b in marks if b], *[(w, -1.0, n) for w, n in sorted(clean.items())]]
    strings, signs, times = map(list, zip(*instances))
    root = nystroem(landmarks.gram())
    w, bias = machine(landmarks.sums(strings) @ root, np.array(signs), np.array(times, dtype=np.float64))
    return landmarks.words, root @ w, bias


def together(each: list[tuple[list[str], np.ndarray, float]], sizes: list[int]) -> dict:
    """Several machines over the union of their landmarks."""
    words = sorted({w for own, _, _ in each for w in own})
    place = {w: i for i, w in enumerate(words)}
    weights = np.zeros((len(words), len(each)))
    for m, (own, values, _) in enumerate(each):
        weights[[place[w] for w in own], m] = values
    return Landmarks(words).machines(weights, np.array([bias for *_, bias in each]), sizes)


def clean_segments(got: list, m: int) -> Counter:
    """The ``HARDEST`` strongest segments of clean texts that machine ``m`` may learn from, with how many texts have them."""
    return Counter(dict(Counter(s for r in got if r["toxic"] == 0 and r["part"] != m - 1 for s in r["strong"][m]).most_common(HARDEST)))


def joined(largest: np.ndarray, dense: np.ndarray) -> np.ndarray:
    return np.stack([largest, np.log1p(4 * dense)], axis=-1)


def fewest_errors(decided: np.ndarray, toxic: np.ndarray) -> float:
    """The lowest of the thresholds with the fewest errors: between two neighbouring decisions, nearer to the clean one."""
    values = np.unique(decided)
    wrong = np.array([(decided[toxic] < v).sum() + (decided[~toxic] >= v).sum() for v in [*values, np.inf]])
    at = int(wrong.argmin())
    above = values[at] if at < len(values) else values[-1] + 1
    below = values[at - 1] if at else values[0] - 1
    return float(below + TOLERANT * (above - below))


CONSTANT = {"constant": 0.0}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> dict:
    """The model: plain arrays and numbers."""
    rows = saved(training_rows(docs, labels, sample_rows), "toxic-training")
    sizes = {(r["part"], r["toxic"]): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    if {toxic for _, toxic in sizes} == {1}:
        return {"constant": 1.0}
    counts = saved(word_counts(rows), "toxic-words")
    # the first machine learns from all parts, each other one from all but one
    marks = [mark_words(counts, sizes, without, landmarks) for without in [None, *range(PARTS)]]
    if not marks[0]:
        return CONSTANT
    lengths = [len(w) for w, *_ in marks[0]]
    windows = list(range(min(lengths), min(PIECE, max(lengths) + GAPS) + 1))
    each = []
    for own in marks:
        known = Landmarks([w for w, *_ in own])
        surely = np.array([z for _, z, *_ in own])
        each.append((known.words, np.linalg.solve(known.gram() + 0.1 * np.eye(len(own)), surely) if own else surely, -1.0))
    seen = [Counter() for _ in marks]
    for _ in range(2):
        got = measured(rows, together(each, windows))
        for m, own in enumerate(marks):
            seen[m] |= clean_segments(got, m)
            each[m] = fitted(own, seen[m]) if own and seen[m] else each[m]
    got = measured(rows, together(each, windows))
    toxic = np.array([r["toxic"] > 0 for r in got])
    # of each text what the machine says that has not seen it
    unseen = joined(np.array([r["largest"][r["part"] + 1] for r in got]), np.array([r["dense"][r["part"] + 1] for r in got]))
    mix = np.maximum(logistic(unseen, toxic)[:-1], 0.0)
    mix = mix / mix.sum() if mix.sum() > 0 else np.array([1.0, 0.0])
    decided = unseen @ mix
    slope = max(float(logistic(decided[:, None], toxic)[0]), 1e-3)
    return {**together(each[:1], windows), "mix": mix, "threshold": fewest_errors(decided, toxic), "slope": slope}


def logistic(values: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Slopes and shift of the curve from decisions to probabilities, with smoothed targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([values, np.ones((len(values), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - target) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` and the score of the whole text."""
    if "constant" in model:
        return docs.withColumn(name, F.lit(model["constant"]))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, segments = shipped.value, None
        for batch in slices(batches, most=TEXTS):
            segments = segments or Segments(model)
            facts = [(most[0], dense[0]) for most, dense, *_ in segments.facts(texts_of(batch))]
            decided = joined(*np.array(facts).T) @ model["mix"]
            values = 1 / (1 + np.exp(-np.clip(model["slope"] * (decided - model["threshold"]), -500, 500)))
            yield replaced(batch, name, pa.array(values, pa.float64()))

    return docs.mapInArrow(run, with_column(docs, name, T.DoubleType()))


def reject(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with their columns as they were."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).filter(F.col(name) < threshold).select(*docs.columns)
