"""Vectors as short codes: one codebook for each part of a vector, trained and searched in integers.

Components are scaled and floored to integers, so that sums don't depend on the order in which tasks add them and each
run gives the same codes. Codebooks are small by their parameters (``parts`` times ``entries`` entries) whatever the
number of vectors. For each round the driver builds a kd-tree of each codebook and broadcasts them; tasks search the
trees for all vectors of an Arrow batch at once and add up what falls to each entry; Spark adds the tasks' sums, and
the driver gets one row an entry.

A search goes down to each vector's own leaf first, then through the tree again with the vectors that a node's box is
no farther from than the best entry so far. Boxes that are just as far are entered too, since an entry there with a
lower index wins the tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .exact import heavy_above

LEAF = 8
#: Vectors that are searched for at once.
AT_ONCE = 1 << 13
#: All integers below it are exact as doubles, so products of matrices are.
EXACT = 1 << 53


class Tree(NamedTuple):
    """A kd-tree over the rows of ``entries``. Node 0 is the root; an inner node has ``left`` and ``left + 1`` below it.

    A leaf (``left`` is 0) holds the entries ``order[first:last]``, by index. ``low`` and ``high`` are the boxes of nodes.
    """

    entries: np.ndarray
    order: np.ndarray
    left: np.ndarray
    axis: np.ndarray
    split: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


def tree(entries: np.ndarray) -> Tree:
    """Nodes are halved at the median of their widest side until they hold ``LEAF`` entries."""
    order = np.arange(len(entries))
    nodes, at = [[0, 0, 0, 0, len(entries)]], 0  # left, axis, split, first, last
    while at < len(nodes):
        _, _, _, first, last = nodes[at]
        own = order[first:last]
        if last - first > LEAF:
            axis = int(np.argmax(np.ptp(entries[own], axis=0)))
            own = own[np.argsort(entries[own, axis], kind="stable")]
            order[first:last] = own
            middle = (last - first) // 2
            nodes[at][:3] = len(nodes), axis, int(entries[own[middle - 1], axis])
            nodes += [[0, 0, 0, first, first + middle], [0, 0, 0, first + middle, last]]
        else:
            order[first:last] = np.sort(own)
        at += 1
    left, axis, split, first, last = np.array(nodes, np.int64).T
    held = [entries[order[a:b]] for a, b in zip(first, last, strict=True)]
    return Tree(entries, order, left, axis, split, first, last, np.array([h.min(axis=0) for h in held]), np.array([h.max(axis=0) for h in held]))


def nearest(t: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``points`` the index of its nearest entry, of equally near ones the lowest, and the squared distance.

    All in integers, as doubles where those are exact; farther than a long can tell is an error.
    """
    reach = 2 * max(int(np.abs(points).max(initial=0)), int(np.abs(t.entries).max(initial=0)))
    if points.shape[1] * reach * reach >= 1 << 62:
        raise ValueError("components are too large for squared distances in 64 bits")
    kind = np.float64 if points.shape[1] * reach * reach < EXACT else np.int64
    q, entries, low, high = (a.astype(kind) for a in (points, t.entries, t.low, t.high))
    q_norm, norm = (q * q).sum(axis=1), (entries * entries).sum(axis=1)
    best, index = np.full(len(q), 1 << 62, kind), np.full(len(q), len(entries))

    def enter(node: int, at: np.ndarray) -> None:
        own = t.order[t.first[node] : t.last[node]]
        far = q_norm[at, None] + norm[own] - 2 * (q[at] @ entries[own].T)
        place = far.argmin(axis=1)
        far, found = far[np.arange(len(at)), place], own[place]
        better = (far < best[at]) | (far == best[at]) & (found < index[at])
        best[at[better]], index[at[better]] = far[better], found[better]

    home = np.zeros(len(q), np.int64)
    while (t.left[home] > 0).any():
        inner = np.flatnonzero(t.left[home] > 0)
        node = home[inner]
        home[inner] = t.left[node] + (points[inner, t.axis[node]] > t.split[node])
    for leaf in np.unique(home):
        enter(leaf, np.flatnonzero(home == leaf))
    stack = [(0, np.arange(len(q)))]
    while stack:
        node, at = stack.pop()
        outside = np.maximum(np.maximum(low[node] - q[at], q[at] - high[node]), 0)
        at = at[(outside * outside).sum(axis=1) <= best[at]]
        if t.left[node]:
            stack += [(t.left[node] + 1, at), (t.left[node], at)]
        elif (at := at[home[at] != node]).size:
            enter(node, at)
    return index, best.astype(np.int64)


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null and no component that isn't finite."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    if len(column) and (np.asarray(column.value_lengths()) != width).any():
        raise ValueError(f"not all vectors have {width} components")
    scaled = np.floor(column.flatten().to_numpy().astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) >= 1 << 31:
        raise ValueError("components are too large for squared distances in 64 bits")
    return scaled.astype(np.int64).reshape(len(column), width)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(first, AT_ONCE)


class Codebooks(NamedTuple):
    """``entries[part]`` is a matrix of integers, one row an entry; ``scale`` is what components were multiplied by."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for row in part.tolist() for x in row).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding") -> Codebooks | None:
    """Codebooks of the finite vectors of ``vectors``; None if there are none.

    They begin as the parts of the ``entries`` vectors with the smallest ids (null last, ties by vector; fewer if there are
    fewer vectors). Each round gives every part to its nearest entry and makes each entry the floored mean of its parts;
    an entry without parts stays. The vectors are read once a round; sums are longs, and an overflow is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte for each part")
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col(column))).select(F.col(id_column).alias("id"), F.col(column).alias("v"))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        return None
    width = len(start[0]["v"])
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    side = width // parts
    cube = integers(pa.array([r["v"] for r in start], pa.list_(pa.float64())), width, scale).reshape(len(start), parts, side)
    books = [cube[:, p].copy() for p in range(parts)]
    names = [f"s{k}" for k in range(side + 1)]  # the last is the number of parts
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([tree(b) for b in books])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, len(shared.value[0].entries), side + 1), np.int64)
            for batch in portions(batches):
                points = integers(batch.column(0), width, scale).reshape(batch.num_rows, parts, side)
                for p in range(parts):
                    index, _ = nearest(shared.value[p], points[:, p])
                    np.add.at(sums[p], index, np.column_stack([points[:, p], np.ones(len(points), np.int64)]))
            part, entry = np.nonzero(sums[:, :, -1])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), *(pa.array(sums[part, entry, k]) for k in range(side + 1))], names=["part", "entry", *names])

        tasks = kept.select("v").mapInArrow(run, "part long, entry long, " + ", ".join(f"{n} long" for n in names))
        for row in tasks.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names)).collect():
            *sums, count = (row[n] for n in names)
            books[row["part"]][row["entry"]] = [s // count for s in sums]
        shared.destroy()
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], column: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The columns ``keep`` of the finite vectors with ``code``, a byte for each part, and ``error``, the squared distances of all parts.

    A column of ``keep`` that is named like one of the two is replaced. No shuffle.
    """
    kept = [c for c in keep if c.lower() not in (code.lower(), error.lower())]
    rows = vectors.where(finite(F.col(column)))
    wide = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(column).alias(fresh(rows.select(*(f"`{c}`" for c in kept)), "_vector")))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.schema[: len(kept)])
    side = books.entries[0].shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast([tree(b) for b in books.entries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            points = integers(batch.column(batch.num_columns - 1), side * len(books.entries), books.scale).reshape(batch.num_rows, len(books.entries), side)
            found = [nearest(t, points[:, p]) for p, t in enumerate(shared.value)]
            codes = np.column_stack([index for index, _ in found]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(far for _, far in found))], names=[*kept, code, error])

    return wide.mapInArrow(run, f"{fields}`{code}` binary, `{error}` long")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """``codes`` with the vector that each code stands for, null where it is null; a column named like ``out`` is replaced."""
    digit = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    entries = [F.lit([[x / books.scale for x in row] for row in part.tolist()]) for part in books.entries]
    return codes.withColumn(out, F.when(F.col(code).isNotNull(), F.concat(*(F.get(e, digit(p)) for p, e in enumerate(entries)))))


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every row of ``vectors(vec_id, embedding, label)`` with a finite vector.

    Rows whose vector is null or has a null, a NaN or an infinity are dropped. Null and repeated ids are rows like any
    others. label_error adds up the errors of a label, of all null labels together. Empty vectors have code 0 and no error;
    vectors of different lengths, or too large for exact distances in 64 bits, are an error. An empty table gives no rows,
    other columns are of no account.
    """
    books = train(vectors)
    if books is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = cut(encode(vectors.select("vec_id", "label", "embedding"), books, ["vec_id", "label"]))
    sums = cut(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    # Fewer than HEAVY labels are heavy, at some 40 bytes each; their rows stay where they are.
    most, same = heavy_above(rows.count()), F.col("label").eqNullSafe(F.col("_label"))
    large = F.broadcast(sums.where(F.col("_n") > most))
    near = rows.join(large, same)
    small = rows.join(large, same, "left_anti").join(sums.where(F.col("_n") <= most), same)
    return near.unionByName(small).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
