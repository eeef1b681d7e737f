"""Token-ID output: best-fit-decreasing packing into fixed-length rows.

Texts become token ids by a public byte-level vocabulary (its file's path is a parameter; the file
is read on the driver and broadcast, at most a few MB). Each task gathers documents until
``BUFFER`` tokens, splits those that are longer than a row into pieces without loss, sorts the
pieces by length and puts each into the fullest row with room for it. Free room is found in a
segment tree over the capacities: leaf c holds the number of rows that have exactly c left, so
the smallest sufficient capacity is one descent.

A packed row has ``length`` ids (the rest is the end token), the cumulative lengths of its segments, the
position of each token within its segment (it restarts at 0), and per segment the document and the
offset of its first token in that document. Reading the segments of a document in order of offset gives
its ids back. Tasks depend on their input alone, so a task that is run again writes the same rows.

Defined cases: null and empty texts have no tokens and no segment, so no row names them; a null
doc_id is carried as null; repeated rows are packed each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

TOKENIZER = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
BUFFER = 1 << 21
#: Bytes of text whose pieces are held at once, the mark at which texts are cut, and (by RE2) texts that can't be:
#: those with white space other than space and line feed, with repeated white space that forms tokens, or with the mark.
SLICE = 1 << 22
CUT = "\x01"
TANGLED = r"[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x01]|  | \n|\n |\n\n\n|\n\n\z"
SCHEMA = "shard int, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tokenizer:
    """Ids of texts as little-endian 16-bit numbers.

    A token never reaches over a single line feed, nor from a letter to the space after it, so texts are
    cut before spaces and around line feeds. The distinct pieces of a call are encoded together, each
    once, and Arrow takes their ids to the pieces' places, so a word costs no Python object where it is
    repeated. Nothing is kept between calls: a vocabulary that grows with the input costs no memory.
    Texts with other or repeated white space, which does form tokens, are encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        if max(ranks.values()) >= 0xFFFF:  # the end token has the next id
            raise ValueError("16-bit ids are too small for this vocabulary and its end token")
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.whole("\n")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    def learn(self, words: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as bytes."""
        blank = pc.is_in(words, pa.array(["", " ", "\n"], words.type))
        plain = words.filter(pc.invert(blank))
        if len(plain) and len(self.feed) == 1:
            ids = self.whole(pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), pa.scalar("\n", plain.type))[0].as_py())
            cuts = np.flatnonzero(ids == self.feed[0])
            if len(cuts) == len(plain) - 1:
                ends = 2 * (np.append(cuts, len(ids)) - np.arange(len(plain)))
                known = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(np.append(0, ends).astype("<i8")), pa.py_buffer(np.delete(ids, cuts))])
                few = pa.array([self.whole(w).tobytes() for w in words.filter(blank).to_pylist()], known.type)
                order = np.argsort(np.argsort(blank.to_numpy(zero_copy_only=False), kind="stable"))
                return pa.concat_arrays([known, few]).take(pa.array(order))
        return pa.array([self.whole(w).tobytes() for w in words.to_pylist()], pa.large_binary())

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.match_substring_regex(texts, TANGLED)
        cut = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(hard)), " ", CUT + " "), "\n", CUT + "\n" + CUT)
        lines = pc.split_pattern(cut, CUT)
        words = lines.flatten().dictionary_encode()
        _, at, data = self.learn(words.dictionary).take(words.indices).buffers()
        at = np.frombuffer(at, "<i8")[lines.offsets.to_numpy()] // 2
        ids, easy = np.frombuffer(data or b"", "<u2"), iter(range(len(lines)))
        return [self.whole(text.as_py()) if h else ids[at[i := next(easy)] : at[i + 1]] for text, h in zip(texts, hard.to_pylist(), strict=True)]


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``most`` bytes of text, or one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


class Capacities:
    """A segment tree over 0..length: how many open rows have exactly c tokens left."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row): an open row with the smallest capacity of at least ``need``."""
        node = need + self.size
        if not self.count[node]:
            while True:  # up to the first right sibling that has rows
                if node == 1:
                    return None
                if not node & 1 and self.count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.size
        self._add(left, -1)
        return left, self.rows[left].pop()

    def _add(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of item indices; items are at most ``length`` long."""
    free, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        hit = free.take(lengths[i])
        if hit is None:
            hit = (length, len(rows))
            rows.append([])
        rows[hit[1]].append(i)
        if hit[0] > lengths[i]:
            free.put(hit[0] - lengths[i], hit[1])
    return rows


def _packed(docs: list[tuple[int | None, np.ndarray]], length: int, end: int):
    """Rows of one buffer, as (n, ids, positions, cumulative lengths, doc_ids, offsets)."""
    parts = [(d, at, ids[at : at + length]) for d, ids in docs for at in range(0, len(ids), length)]
    for row in best_fit_decreasing([len(p[2]) for p in parts], length):
        ids, positions = np.full(length, end, "<u2"), np.zeros(length, "<u4")
        ends = [0]
        for i in row:
            piece = parts[i][2]
            ids[ends[-1] : ends[-1] + len(piece)] = piece
            positions[ends[-1] : ends[-1] + len(piece)] = np.arange(len(piece))
            ends.append(ends[-1] + len(piece))
        yield ends[-1], ids.tobytes(), positions.tobytes(), ends, [parts[i][0] for i in row], [parts[i][1] for i in row]


def packed(documents: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of all documents; ids are 16-bit and positions 32-bit little-endian.

    Positions restart at 0 with each segment. Tokenising, packing and writing are one narrow pass.
    """
    held = documents.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    schema = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Tokenizer(held.value), max(held.value.values()) + 1
        shard, count, docs, tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal count, docs, tokens
            rows = list(_packed(docs, length, end))
            docs, tokens = [], 0
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                columns = [[shard] * len(some), list(range(count, count + len(some))), *map(list, zip(*some, strict=True))]
                count += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in (some for rows in pieces(batches, 1 << 14) for some in slices(rows)):
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text")), strict=True):
                if len(ids):
                    docs.append((d, ids))
                    tokens += len(ids)
                if tokens >= buffer:
                    yield from flush()
        if docs:
            yield from flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
