"""Token ids in a compressed binary file format, in order of ``doc_id``.

Texts are encoded with a tokenizer of the ``tokenizers`` library; each document's ids are followed by an end
id. Ids are cut into blocks of fixed size, and a block is transposed into bit planes (all lowest bits, all second
bits, ...) or byte planes. Every plane of a block is compressed with zstandard on its own; planes above the
highest used one are not stored. A chunk holds the blocks of a run of whole documents and begins with a table
of its blocks, so one block can be read alone.

A chunk is one row of a Parquet table in a shared folder, which gives it an atomic commit and a place that all
executors reach: ``part, chunk, first, n_ids, payload, doc_ids, counts``. Parts hold ascending ranges of
``doc_id``; ``first`` counts the ids of the part before the chunk. The chunk index is these columns without
``payload``.

Cases: a null text is an empty one and has the end id alone. A null ``doc_id`` comes first. Rows with
the same ``doc_id`` come in order of their text. A very long text is a chunk of its own. Other columns are not read.
An empty table gives no chunk.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import partitions, slices, texts_of
from rejoinder.plans.session import saved

END_ID = 0
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
MAGIC = b"PLN1"
HEADER = "<4sBIQI"  # magic, bits per plane, ids per block, ids, blocks
# the mark behind documents; a text that has it is encoded whole
END = "\x1f"
# bytes hashed at a time, and the base of the hash
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
LETTERS = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
# white space of ASCII but for the space and the line end, and that beyond ASCII
RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE = "".join(chr(c) for c in range(128, 0x3001) if chr(c).isspace())
BLANKS = frozenset(map(ord, " \n" + RARE))
# words encoded in one go
RUN = 100
# pieces of text remembered with their ids; beyond it a worker starts anew
REMEMBERED = 1_000_000


class Encoder:
    """Encodes texts with a tokenizer of byte-level pieces, each distinct piece of text once.

    The tokenizer's own pattern always parts two tokens before a single space, at a single line end and
    before a full stop or comma that ends a word. So the pieces cut there have the ids they have within the text. A
    text with neighbouring white space, a special token's string or our mark is encoded whole.

    Pieces are told apart by a polynomial hash, and compared byte by byte with the piece that has been encoded; a batch in
    which two pieces share a hash is encoded whole.
    """

    def __init__(self, tokenizer_json: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s\s", END, *map(re.escape, self.special)]))
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.begins = np.array([names.get(i, "").startswith("\u0120") for i in range(max(names) + 1)])
        self.end_id = end_id
        self.up, self.down = (np.ones(SEGMENT + 1, dtype=np.uint64) for _ in range(2))
        for powers, base in ((self.up, BASE), (self.down, pow(BASE, -1, 1 << 64))):
            powers[1:] = base
            np.multiply.accumulate(powers, out=powers)
        self.forget()

    def forget(self) -> None:
        """Piece 0 is the mark behind a document."""
        mark = np.array([ord(END)], dtype=np.uint8)
        self.hashes, self.numbers = self.hash(mark, np.array([0]), np.array([1])), np.array([0])
        self.letters, self.places, self.lengths = mark, np.array([0]), np.array([1])  # bytes of the known pieces
        self.flat, self.sizes = np.array([self.end_id], dtype=np.uint32), np.array([1], dtype=np.int64)

    def is_plain(self, text: str) -> bool:
        if not any(c in text for c in RARE) and (text.isascii() or not any(c in text for c in WIDE)):
            # the only white space is spaces and line ends
            return not any(c in text for c in ("  ", " \n", "\n ", "\n\n", *self.special))
        return not self.odd.search(text)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.array(list(chain.from_iterable(got)), dtype=np.uint32), sizes

    @staticmethod
    def starts(data: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of documents with a mark behind each."""
        apart = (data == 10) | (data == ord(END))
        begin = apart | (data == 32)
        begin[1:] |= apart[:-1]
        begin[:1] = True
        marks = np.flatnonzero((data == 46) | (data == 44) | (data == 33) | (data == 63))
        marks = marks[(marks > 1) & (marks + 1 < len(data))]
        behind, first, second = data[marks + 1], data[marks - 2], data[marks - 1]
        # letters and digits of ASCII, and Latin letters of two bytes, of which every Unicode version says the same
        word = LETTERS[second] | ((second >= 0x80) & (first >= 0xC3) & (first <= 0xC8) & (second != 0x97) & (second != 0xB7))
        begin[marks[word & ((behind == 32) | (behind == 10) | (behind == ord(END)))]] = True
        return np.flatnonzero(begin)

    def hash(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A polynomial in the bytes of each piece, modulo 2**64; the pieces lie within one segment."""
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            values = data.astype(np.uint64)
            values += np.uint64(1)
            values *= self.up[: len(data)]
            np.cumsum(values, out=sums[1:])
            found = (sums[starts + lengths] - sums[starts]) * self.down[starts]
            return found ^ (found >> np.uint64(29)) ^ (lengths.astype(np.uint64) << np.uint64(48))

    def learn(self, pieces: list[bytes], hashes: np.ndarray) -> None:
        """Encode new pieces, in ascending order of their hashes, words behind a space many at a time: the one token with the
        space starts each."""
        ends_blank = (p[-1] in BLANKS if p[-1] < 128 else p.decode("utf-8")[-1].isspace() for p in pieces)
        joined = np.array([p[0] == 32 and len(p) > 1 and not b for p, b in zip(pieces, ends_blank)], dtype=bool)
        words = [p for p, j in zip(pieces, joined.tolist()) if j]
        runs = [b"".join(words[i : i + RUN]).decode("utf-8") for i in range(0, len(words), RUN)]
        run_ids, _ = self.each(runs)
        starts = np.flatnonzero(self.begins[run_ids])
        other_ids, other_sizes = self.each([p.decode("utf-8") for p, j in zip(pieces, joined.tolist()) if not j])
        sizes = np.zeros(len(pieces), dtype=np.int64)
        sizes[joined] = np.diff(np.append(starts, len(run_ids)))
        sizes[~joined] = other_sizes
        from_run = np.repeat(joined, sizes)
        flat = np.empty(len(from_run), dtype=np.uint32)
        flat[from_run], flat[~from_run] = run_ids, other_ids
        numbers = len(self.sizes) + np.arange(len(pieces))
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.places = np.concatenate([self.places, len(self.letters) + np.cumsum(lengths) - lengths])
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(pieces), dtype=np.uint8)])
        self.lengths = np.concatenate([self.lengths, lengths])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.numbers = np.insert(self.hashes, at, hashes), np.insert(self.numbers, at, numbers)

    def numbered(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray | None:
        """The number of each piece; None if two pieces share a hash."""
        lengths = np.diff(starts, append=len(data))
        found, first, place = np.unique(self.hash(data, starts, lengths), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        new = np.flatnonzero(self.hashes[at] != found)
        if len(new):
            whole = data.tobytes()
            begin, size = starts[first[new]].tolist(), lengths[first[new]].tolist()
            self.learn([whole[b : b + n] for b, n in zip(begin, size)], found[new])
            at = np.searchsorted(self.hashes, found)
        numbers = self.numbers[at][place]
        if not np.array_equal(self.lengths[numbers], lengths):
            return None
        places = np.repeat(self.places[numbers] - starts, lengths)
        places += np.arange(len(data))
        known = self.letters[places]
        return numbers if np.array_equal(known, data) else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has, its end id included."""
        if len(self.sizes) > REMEMBERED:
            self.forget()
        plain = list(map(self.is_plain, texts))
        data = np.frombuffer("".join([t + END for t, p in zip(texts, plain) if p]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts = self.starts(data)
        bounds = [0]
        while bounds[-1] < len(starts):  # pieces of about one segment at a time
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(starts, starts[bounds[-1]] + SEGMENT, "right")) - 1))
        parts = []
        for a, b in zip(bounds, bounds[1:]):
            begin, end = starts[a], starts[b] if b < len(starts) else len(data)
            part = self.numbered(data[begin:end], starts[a:b] - begin) if end - begin <= SEGMENT else None
            if part is None:
                plain = [False] * len(texts)
                break
            parts.append(part)
        if not any(plain):
            whole, sizes = self.each(texts)
            own = np.split(whole, np.cumsum(sizes)[:-1])
            end = np.array([self.end_id], dtype=np.uint32)
            return np.concatenate([x for d in own for x in (d, end)]), sizes + 1
        at = np.concatenate(parts)
        sizes = self.sizes[at]
        reached = np.cumsum(sizes)
        places = np.cumsum(self.sizes) - self.sizes
        ids = self.flat[np.repeat(places[at] - (reached - sizes), sizes) + np.arange(sizes.sum())]
        counts = np.diff(reached[at == 0], prepend=0)
        if all(plain):
            return ids, counts
        whole, whole_sizes = self.each([t for t, p in zip(texts, plain) if not p])
        own = iter(np.split(ids, np.cumsum(counts)[:-1]))
        others = iter(np.split(whole, np.cumsum(whole_sizes)[:-1]))
        end = np.array([self.end_id], dtype=np.uint32)
        docs = [next(own) if p else np.concatenate([next(others), end]) for p in plain]
        return np.concatenate(docs), np.array(list(map(len, docs)), dtype=np.int64)


def kept_encoder(shipped: dict, end_id: int) -> Encoder:
    """The encoder of a worker, with the pieces its earlier tasks have learned: a worker unpacks a broadcast once, so what is put
    into it stays for the next task."""
    if "encoder" not in shipped:
        shipped["encoder"] = Encoder(shipped["tokenizer"], end_id)
    return shipped["encoder"]


def pack(ids: np.ndarray, plane_bits: int = 8, block_ids: int = BLOCK_IDS, level: int = 1) -> bytes:
    """A chunk: header, a table of block sizes and plane sizes, the compressed planes."""
    compress = zstandard.ZstdCompressor(level=level).compress
    blocks = []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        used = -(-max(1, int(block.max()).bit_length()) // plane_bits)
        if plane_bits == 1:
            planes = [compress(np.packbits((block >> np.uint32(b)).astype(np.uint8) & 1).tobytes()) for b in range(used)]
        else:
            planes = [compress((block >> np.uint32(8 * b)).astype(np.uint8).tobytes()) for b in range(used)]
        blocks.append(struct.pack(f"<B{used}I", used, *map(len, planes)) + b"".join(planes))
    table = struct.pack(f"<{len(blocks)}I", *map(len, blocks))
    return struct.pack(HEADER, MAGIC, plane_bits, block_ids, len(ids), len(blocks)) + table + b"".join(blocks)


def unpack_block(payload: bytes, number: int) -> np.ndarray:
    magic, plane_bits, block_ids, n_ids, n_blocks = struct.unpack_from(HEADER, payload)
    if magic != MAGIC or not 0 <= number < n_blocks:
        raise ValueError("no such block")
    sizes = struct.unpack_from(f"<{n_blocks}I", payload, struct.calcsize(HEADER))
    at = struct.calcsize(HEADER) + 4 * n_blocks + sum(sizes[:number])
    count = min(block_ids, n_ids - number * block_ids)
    (used,) = struct.unpack_from("<B", payload, at)
    lengths = struct.unpack_from(f"<{used}I", payload, at + 1)
    at += 1 + 4 * used
    ids = np.zeros(count, dtype=np.uint32)
    expand = zstandard.ZstdDecompressor().decompress
    for b, length in enumerate(lengths):
        plane = np.frombuffer(expand(payload[at : at + length]), dtype=np.uint8)
        if plane_bits == 1:
            plane = np.unpackbits(plane, count=count)
        ids |= plane.astype(np.uint32) << np.uint32(b * plane_bits)
        at += length
    return ids


def unpack(payload: bytes) -> np.ndarray:
    n_blocks = struct.unpack_from(HEADER, payload)[4]
    return np.concatenate([np.array([], dtype=np.uint32), *[unpack_block(payload, b) for b in range(n_blocks)]])


def chunks(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int = END_ID,
    plane_bits: int = 8,
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """The rows of the file format. One shuffle: texts into ranges of ``doc_id``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast({"tokenizer": tokenizer_json})  # the tokenizer's file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), None
        chunk, first, held, doc_ids, counts = 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {
                "part": [part], "chunk": [chunk], "first": [first], "n_ids": [len(ids)],
                "payload": [pack(ids, plane_bits, block_ids)], "doc_ids": [pa.concat_arrays(doc_ids)],
                "counts": [np.concatenate(counts)],
            }
            return pa.RecordBatch.from_pydict(row, schema=form)

        form = None
        for batch in slices(batches, most=4 << 20):
            encoder = encoder or kept_encoder(shipped.value, end_id)
            form = form or pa.schema([
                ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                ("payload", pa.binary()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("counts", pa.list_(pa.int64())),
            ])
            ids, sizes = encoder.encode(texts_of(batch))
            held.append(ids)
            doc_ids.append(batch.column("doc_id"))
            counts.append(sizes)
            size = sum(map(len, held))
            if size >= chunk_ids:
                yield flush()
                chunk, first, held, doc_ids, counts = chunk + 1, first + size, [], [], []
        if held:
            yield flush()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(max(8, partitions(spark) // 2), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(
        run, f"part int, chunk int, first bigint, n_ids bigint, payload binary, doc_ids array<{kind}>, counts array<bigint>"
    )


def write(docs: DataFrame, tokenizer_json: str, **options: int) -> DataFrame:
    """Write the chunks to the shared folder; the stored table."""
    return saved(chunks(docs, tokenizer_json, **options), "token-chunks")


def read_documents(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document, from the stored planes."""
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("payload")[i].as_py()).astype("<u4")
                sizes = batch.column("counts")[i].values.to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                offset = batch.column("offset")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(starts + offset), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row for each part, of which there are as many as shuffle partitions
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(offsets), F.col("part") == F.col("_part")).select(
        "doc_ids", "counts", "payload", (F.col("base") + F.col("first")).alias("offset")
    )
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
