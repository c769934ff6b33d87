"""Byte-level BPE by a rank queue over a hierarchical bitmap.

Each merge rank owns a bucket with the positions whose pair has that rank. Which buckets hold anything is kept in two
levels of wide bit words, so the lowest rank is two find-first-set steps away however long the pre-token is. Positions
form a linked list; a merge relinks two neighbours and re-files at most two pairs. Entries that a later merge has
overtaken are not searched for and deleted, they are skipped when their turn comes.

Spark splits the texts into pre-tokens; a task then merges each pre-token of an Arrow batch that is new to its worker
once, and puts the ids of the texts together column by column.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, frame, fresh, gather, portions, text

#: Pre-tokens of the texts that are worked on at once, unless one text alone has more.
AT_ONCE = 1 << 19


class RankQueue:
    """Positions by rank. ``pop`` gives the lowest rank and, in it, the leftmost position."""

    def __init__(self, ranks: int):
        self.shift = (max(ranks - 1, 1).bit_length() + 1) // 2
        self.within = (1 << self.shift) - 1
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (((ranks - 1) >> self.shift) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            word = rank >> self.shift
            self.low[word] |= 1 << (rank & self.within)
            self.top |= 1 << word
        heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """(-1, -1) if there is nothing left."""
        top = self.top
        if not top:
            return -1, -1
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        rank = word << self.shift | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            bits &= bits - 1
            self.low[word] = bits
            if not bits:
                self.top = top & (top - 1)
        return rank, position


class Codec:
    """The ranks of one vocabulary file and what this worker has encoded with them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.binary())
        self.digits = pa.array([str(i) for i in range(size)])
        self.queue = RankQueue(size)
        #: Ids as 4 bytes each.
        self.known: Memo[bytes] = Memo(64 << 20)

    def merge(self, piece: bytes) -> list[int]:
        find = self.ranks.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        push, pop = self.queue.push, self.queue.pop
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        filed: list[int | None] = [None] * n  # the rank under which the pair that begins here is filed now
        for i in range(n - 1):
            filed[i] = rank = find(piece[i : i + 2])
            if rank is not None:
                push(rank, i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if filed[i] != rank:
                continue
            gone = after[i]
            after[i] = end = after[gone]
            filed[gone] = None
            if end < n:
                before[end] = i
                filed[i] = rank = find(piece[i : after[end]])
                if rank is not None:
                    push(rank, i)
            else:
                filed[i] = None
            left = before[i]
            if left >= 0:
                filed[left] = rank = find(piece[left:end])
                if rank is not None:
                    push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and where each row begins (with the end of the last)."""
        spelled = words.flatten().dictionary_encode()
        known, found = self.known, []
        for word in spelled.dictionary.to_pylist():
            ids = known.held.get(word)
            if ids is None:
                ids = np.array(self.merge(word.encode()), np.int32).tobytes()
                known.put(word, ids, len(ids))
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        taken = np.asarray(spelled.indices, np.int64)
        ids, ends = gather(flat, np.concatenate([[0], np.cumsum(sizes)]), taken)
        return ids, ends[np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker, so that what it remembers outlives a task."""
    return Codec(path)


def pre_tokens(column: Column, pattern: str) -> Column:
    """The matches of ``pattern``, in which \\s is Unicode white space."""
    return F.regexp_extract_all(column, F.lit(f"(?U){pattern}"), F.lit(0))


def with_column(docs: DataFrame, kept: list[str], name: str, kind: str, inputs: Column, make) -> DataFrame:
    """The columns ``kept`` of ``docs`` and ``name``, which ``make`` gives for the lists of ``inputs``; no other goes through Python.

    ``kept`` are matched without regard to case and may have any names; one named like ``name`` is replaced.
    """
    kept = [c for c in kept if c.lower() != name.lower()]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    names = [*rows.columns, name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, AT_ONCE):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(part.column(part.num_columns - 1))], names=names)

    wide = docs.select(*(F.col(f"`{c}`") for c in kept), inputs.alias(fresh(rows, "_input")))
    return wide.mapInArrow(run, f"{fields}{', ' if kept else ''}`{name}` {kind}")


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with the array of token ids of ``column``.

    Null counts as empty, an empty text has no ids. One row per row of ``docs``, repeated ones too; an empty table gives
    none. Kept columns stay as they are whatever their names; one that is named like ``ids`` is replaced. A text of any
    length is encoded whole, in one task; only what is kept goes through Python, so leave the text out where it isn't wanted.
    """

    def make(words: pa.ListArray) -> pa.Array:
        found, ends = codec(path).encode(words)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))

    return with_column(docs, docs.columns if keep is None else keep, ids, "array<int>", pre_tokens(text(column), pattern), make)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of an array of ids; null and empty arrays give no bytes. A column named like ``out`` is replaced."""

    def make(found: pa.ListArray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())])
        return joined(codec(path).pieces, found.flatten().to_numpy(), ends, b"")

    return with_column(docs, docs.columns, out, "binary", F.col(ids), make)


def joined(values: pa.Array, at: np.ndarray, ends: np.ndarray, between: bytes | str) -> pa.Array:
    """For each row, the values that its part of ``at`` points to, with ``between`` between them."""
    rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(at)))
    return pc.binary_join(rows, pa.scalar(between, values.type))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of what they decode to, in one pass and without a shuffle.

    One row per row of ``docs``, whatever its doc_id and other columns; a null or empty text has 0 tokens and the digests of
    nothing; an empty table gives none. A text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in portions(batch, 1, AT_ONCE):
                ids, ends = own.encode(part.column(1))
                named = joined(own.digits, ids, ends, ",")
                decoded = joined(own.pieces, ids, ends, b"")
                yield frame(DIGESTS, [part.column(0), np.diff(ends), list(map(sha256, named)), list(map(sha256, decoded))])

    return docs.select("doc_id", pre_tokens(text(), pattern).alias("words")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def sha256(value: pa.Scalar) -> str:
    return hashlib.sha256(value.as_buffer()).hexdigest()
