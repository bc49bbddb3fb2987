"""Token counts under a unigram model, with work shared in a trie.

A pre-token's best segmentation into pieces is found by forward scores: the best score of a prefix is the best over the last piece
of the score before it plus the piece's own. Scores of a prefix are the same for all pre-tokens that begin with it, so the
distinct pre-tokens of a task are inserted in a trie whose nodes keep them; a node's scores are computed once, and the node where a
pre-token ends stores its number of tokens. A document's count is the sum over its pre-tokens.

Documents are never shuffled: each task has a trie of its own, begun anew beyond ``MOST_NODES`` nodes, which changes no count.

Cases: null and empty texts have no pre-tokens and no tokens. Of segmentations with equal scores the one with fewer tokens counts.
A byte that no piece covers is a token with the score ``UNKNOWN``. Repeated rows are rows of their own. A text of any
length is read whole. Other columns pass through.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rejoinder.llm.common import Pieces, replaced, slices, texts_of

UNKNOWN = -25.0
MOST_NODES = 1_000_000


def ranked_scores(lines: list[bytes]) -> dict[bytes, float]:
    """Log probabilities by rank (one over rank + 1, normalised) for a vocabulary file of base64 pieces and ranks."""
    pieces = [(base64.b64decode(piece), int(rank)) for piece, rank in (line.split() for line in lines if line.strip())]
    total = math.log(sum(1 / (rank + 1) for _, rank in pieces))
    return {piece: -math.log(rank + 1) - total for piece, rank in pieces}


class Trie:
    """Nodes are numbers; node 0 is the empty prefix."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.best, self.tokens = [0.0], [0]

    def insert(self, word: bytes) -> tuple[int, float]:
        """Number of tokens and score of the word; only nodes that are new are computed."""
        node, path = 0, [0]
        child, best, tokens, get = self.child, self.best, self.tokens, self.scores.get
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(best)
                top, fewest = best[path[-1]] + UNKNOWN, tokens[path[-1]] + 1
                for start in range(max(0, end - self.longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        before = path[start]
                        score += best[before]
                        count = tokens[before] + 1
                        if score > top or (score == top and count < fewest):
                            top, fewest = score, count
                best.append(top)
                tokens.append(fewest)
            path.append(node)
        return tokens[node], best[node]


class Counter:
    def __init__(self, scores: dict[bytes, float], pattern: str):
        self.scores, self.cut = scores, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.trie, self.known = Trie(self.scores), Pieces()
        self.tokens, self.score = np.array([], dtype=np.int64), np.array([], dtype=np.float64)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and score of each text."""
        if len(self.trie.best) > MOST_NODES:
            self.forget()
        number = self.known.__getitem__
        numbered = [np.array(list(map(number, self.cut(t))), dtype=np.int64) for t in texts]
        new = [self.trie.insert(p.encode("utf-8", "surrogatepass")) for p in self.known.take_new()]
        if new:
            tokens, score = zip(*new)
            self.tokens, self.score = np.concatenate([self.tokens, tokens]), np.concatenate([self.score, score])
        sizes = np.array(list(map(len, numbered)), dtype=np.int64)
        return sizes, np.array([self.tokens[n].sum() for n in numbered]), np.array([self.score[n].sum() for n in numbered])


COLUMNS = ("n_pretokens", "n_tokens", "token_score")


def counted(docs: DataFrame, scores: dict[bytes, float], pattern: str) -> DataFrame:
    """All rows and columns of ``docs``, then ``COLUMNS`` of the whole text, which take the place of columns of their names."""
    shipped = docs.sparkSession.sparkContext.broadcast((scores, pattern))  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in slices(batches):
            counter = counter or Counter(*shipped.value)
            sizes, tokens, score = counter.count(texts_of(batch))
            for name, values, kind in zip(COLUMNS, (sizes, tokens, score), (pa.int64(), pa.int64(), pa.float64())):
                batch = replaced(batch, name, pa.array(values, kind))
            yield batch

    taken = {c.lower() for c in COLUMNS}
    kinds = (T.LongType(), T.LongType(), T.DoubleType())
    own = [f for f in docs.schema.fields if f.name.lower() not in taken]
    return docs.mapInArrow(run, T.StructType([*own, *map(T.StructField, COLUMNS, kinds)]))
