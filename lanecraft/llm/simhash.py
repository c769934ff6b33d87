"""Near-duplicates by SimHash and BK-trees.

A fingerprint is the majority of the hash bits of a text's word shingles. Texts are linked if their fingerprints
differ in at most ``RADIUS`` bits. Equal fingerprints are one node from the start. The 64 bits are cut into ``PARTS``
bytes; two fingerprints within the radius agree on at least ``PARTS - RADIUS`` of them. So each fingerprint goes to one
shard for each choice of that many bytes, and every link lies within some shard. In a shard only 16 bits are free,
so it holds at most 65,536 fingerprints, whatever the corpus; each is put into a BK-tree in turn, after a search that
follows only edges whose label is within the radius of the distance to the parent. A shard gives back a spanning
forest, so as many links as it has fingerprints at most.

The trees go to the tasks with their shards, by a shuffle, as all trees together grow with the corpus and have no size
for which broadcasting them is safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frame, fresh, strings, with_row
from .components import components
from .exact import heavy_above

WORDS = 3
RADIUS = 2
PARTS = 8
SEED = 42


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, signed; bit i is set if it is in more than half of the shingles' hashes. 0 for a text without words."""
    found = text.encode().lower().split()  # of bytes: only A-Z change, and only blanks and 0x09 to 0x0D split
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        shingles = [line[a:b] for a, b in zip(begins[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 65536):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + 65536]], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(shingles))
    return int(bits.view(">i8")[0])


PRINTS = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64())])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, doc_id and print (long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frame(PRINTS, [batch.column(0), batch.column(1), [fingerprint(t, words) for t in strings(batch.column(2))]])

    return with_row(docs).select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, print long")


class Tree:
    """A BK-tree: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, value: int):
        self.value = value
        self.children: dict[int, Tree] = {}

    def near(self, value: int, radius: int) -> tuple[list[int], Tree, int]:
        """The values within ``radius``, and where ``value`` belongs: a node and the distance to it."""
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            distance = (node.value ^ value).bit_count()
            if distance <= radius:
                found.append(node.value)
            children = node.children
            if len(children) <= 2 * radius:
                stack += [child for d, child in children.items() if abs(d - distance) <= radius]
            else:
                stack += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
        node = self
        while (child := node.children.get(distance := (node.value ^ value).bit_count())) is not None:
            node = child
        return found, node, distance


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within ``radius`` that connect what all such links between the (different) ``values`` connect."""
    tree, links = Tree(values[0]), []
    group = {values[0]: values[0]}

    def top(v: int) -> int:
        while group[v] != v:
            group[v] = v = group[group[v]]
        return v

    for value in values[1:]:
        near, node, distance = tree.near(value, radius)
        node.children[distance] = Tree(value)
        group[value] = value
        for other in near:
            if (root := top(other)) != top(value):
                group[root] = top(value)
                links.append((value, other))
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a, b of the different values of ``prints(print)`` that connect all values within ``radius`` of each other."""
    if not 0 <= radius < PARTS:
        raise ValueError(f"radius {radius} needs more than {PARTS} parts")
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(PARTS), PARTS - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*(F.col("print").bitwiseAND(F.lit(m)) for m in signed))
    shards = prints.select("print", F.posexplode(choices).alias("choice", "shard"))
    shards = shards.repartition("choice", "shard").sortWithinPartitions("choice", "shard", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            part = tuple(np.concatenate([a, batch.column(i).to_numpy().astype(np.int64)]) for i, a in zip((1, 2, 0), left, strict=True))
            starts = bounds(part)
            yield found(part, starts)
            left = tuple(a[starts[-1] :] for a in part)
        if len(left[0]):
            yield found(left, np.append(bounds(left), len(left[0])))

    def bounds(part: tuple[np.ndarray, ...]) -> np.ndarray:
        """Where shards begin."""
        if not len(part[0]):
            return np.zeros(1, np.int64)
        return np.concatenate([[0], np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1])

    def found(part: tuple[np.ndarray, ...], starts: np.ndarray) -> pa.RecordBatch:
        pairs: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(starts) > 1).tolist():
            pairs += forest([v & 0xFFFFFFFFFFFFFFFF for v in part[2][starts[k] : starts[k + 1]].tolist()], radius)
        ends = np.array(pairs, np.uint64).reshape(-1, 2).astype(np.int64)
        return frame(LINKS, [ends[:, 0], ends[:, 1]])

    return shards.select("print", "choice", "shard").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """_row, doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that links lead to, the row's own included; rows without id count only if all
    of a component have none, which then is null. Texts without words, null ones too, have fingerprint 0 and are linked like
    others; repeated rows are rows like any. A text of any length is read whole, its shingles hashed in portions. Other
    columns don't matter; an empty table gives none.
    ``docs`` must come straight from files or a checkpoint.
    """
    prints = cut(fingerprints(docs, words))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(links(nodes.select("print"), radius)).withColumnRenamed("node", "print")
    joined = cut(joined.join(nodes, "print"))
    of = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = joined.join(of, "component").select("print", "component_id")
    ids = cut(nodes.join(of, "print", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id")))
    # Few fingerprints have more rows than this, at some 30 bytes each; their rows stay where they are.
    most = heavy_above(nodes.agg(F.sum("n")).first()[0] or 0)
    often = F.broadcast(ids.where(F.col("n") > most))
    rest = prints.join(often, "print", "left_anti").join(ids.where(F.col("n") <= most), "print")
    return prints.join(often, "print").unionByName(rest).select("_row", "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``docs``, with its columns as they are: the one with the smallest doc_id (null last), of those the first row."""
    row = fresh(docs, "_row")
    groups = near_groups(docs, words, radius).withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    key = F.coalesce(F.col("component_id"), F.lit(2**63 - 1))
    stay = groups.groupBy(key.alias("_key"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_own"))
    stay = stay.agg(F.min(F.struct("_id", "_row")).alias("first")).select(F.col("first._row").alias(row))
    return with_row(docs, row).join(stay, row, "left_semi").drop(row)
