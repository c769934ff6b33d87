"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target of words. A document of a source with target t and size s is taken floor(t / s) times, and
once more with probability t / s - floor(t / s). Which ones is not left to chance alone: within a cell of a source the
vector of these probabilities is moved along directions that change neither their sum nor the sum of the words, until
each direction hits 0 or 1 for some document. With two totals to hold, at most two documents of a cell stay between 0
and 1; the next round puts those of many cells together, and so on until a source has one cell. What is left there is
the landing problem: a few documents, rounded so that the source's words come nearest to its target.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, text, with_row

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more than this many times.
MOST = 3
#: Documents of a cell on average.
CELL = 500
#: Sources, at some 50 bytes each, up to which their targets are broadcast.
FEW_SOURCES = 100_000
#: A probability this near to 0 or 1 is there.
NEAR = 1e-9


def word_count(column: str = "text"):
    return F.regexp_count(text(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: the total shared by weight, no target above ``most`` times its size.

    Sources are ordered by code point, null last, and weigh as ``weights`` repeat. What a full source can't hold goes to
    the others by weight. Sources that fill up first have the least room per weight, so in that order one running sum
    shows which are full: those whose room per weight is below the level that the rest would reach. One row per source
    is all that is held together here. If the total is 0 all targets are.
    """
    whole = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    room = F.col("source_size") * most
    before = whole.orderBy(room / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(room).over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    held = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("level", level)
    held = held.withColumn("full", room / F.col("weight") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct((room / F.col("weight")).alias("r"), "rank", "level"))).over(whole)["level"]
    return held.withColumn("target", F.when(F.col("full"), room.cast("double")).otherwise(rest * F.col("weight"))).select("source", "source_size", "target")


#: A source is left as it is when its words are within this share of its target; so many times one is brought nearer at most.
CLOSE, EXCHANGES = 0.001, 6


def flight(chance: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """``chance`` moved with its sum and the sum of ``chance * sizes`` held, until at most 2 entries are between 0 and 1.

    Each step moves three entries along the null space of the two constraints, as far as the first bound, to the one
    side or the other with the odds that keep each entry's expectation.
    """
    p = chance.tolist()
    w = sizes.tolist()
    random = np.random.default_rng(seed).random
    open_ = [i for i, x in enumerate(p) if NEAR < x < 1 - NEAR]  # taken from the end: long documents first, short ones are left
    active: list[int] = []
    while True:
        while len(active) < 3 and open_:
            active.append(open_.pop())
        if len(active) < 3:
            break
        i, j, k = active
        step = (w[k] - w[j], w[i] - w[k], w[j] - w[i])  # (1, 1, 1) x (w_i, w_j, w_k)
        if step == (0, 0, 0):
            step = (1.0, -1.0, 0.0)
        up = min(((1 - p[a]) if d > 0 else p[a]) / abs(d) for a, d in zip(active, step, strict=True) if d)
        down = min((p[a] if d > 0 else (1 - p[a])) / abs(d) for a, d in zip(active, step, strict=True) if d)
        move = up if random() * (up + down) < down else -down
        for a, d in zip(active, step, strict=True):
            x = p[a] + move * d
            p[a] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
        active = [a for a in active if 0 < p[a] < 1]
    return np.array(p)


def landing(chance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The few entries between 0 and 1 set to 0 or 1 so that the words come nearest to the sum held, then the count."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    goal, count = float((chance[left] * sizes[left]).sum()), float(chance[left].sum())
    tries = ([m >> b & 1 for b in range(len(left))] for m in range(1 << len(left)))
    best = min(tries, key=lambda t: (abs(float(np.dot(t, sizes[left])) - goal), abs(sum(t) - count), t))
    out = chance.copy()
    out[left] = best
    return out


def _cells(rows: DataFrame, cells: int, last: bool) -> DataFrame:
    """One round of flights (with the landing in the last one) over ``rows(source, _row, size, chance, cells)``.

    The draws of a cell follow from its source, its number and its round, so cells are independent of each other.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "_row"], kind="stable")
        sizes = group["size"].to_numpy(np.float64)
        moved = flight(group["chance"].to_numpy(), sizes, zlib.crc32(repr((key[0], int(key[1]), cells)).encode()))
        group["chance"] = landing(moved, sizes) if last else moved
        return group[["source", "_row", "size", "chance", "cells"]]

    spread = F.pmod(F.xxhash64("_row"), F.greatest(F.ceil(F.col("cells") / F.lit(float(cells))), F.lit(1)))
    schema = "source string, _row long, size long, chance double, cells long"
    return rows.groupBy("source", spread.cast("long").alias("cell")).applyInPandas(run, schema)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_row, doc_id, size, source_size, target and copies (how often the mix takes it) of every row of ``docs``.

    Null texts count as empty; documents of size 0 are taken like others and add no words. A null source is a source.
    Repeated rows are rows like any, sizes may tie, texts of any length are counted whole, and other columns don't matter.
    An empty table gives none. Reruns over the same files agree: draws depend on the rows' places and sizes alone.
    ``docs`` must come straight from files or a checkpoint.
    """
    sized = cut(with_row(docs).select("_row", "doc_id", "source", word_count().alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = targets(totals.select("source", "source_size"), weights, most)
    shares = cut(shares.join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    held = F.broadcast if shares.count() <= FEW_SOURCES else lambda df: df
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rated = sized.join(held(shares.withColumn("ratio", ratio).withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # A ratio just below a whole number because of rounding is that number.
    whole = F.floor(F.col("ratio") + NEAR)
    rated = rated.withColumn("base", whole).withColumn("chance", F.greatest(F.col("ratio") - whole, F.lit(0.0)))
    rest = rated.where(F.col("chance") > 0).select("source", "_row", "size", "chance", F.ceil(F.col("n") / CELL).alias("cells"))
    largest = shares.agg(F.max("n")).first()[0] or 0
    done, group = [], 1
    while True:
        # The cells of a source shrink by CELL / 2 a round, as a cell leaves two documents.
        last = math.ceil(math.ceil(largest / CELL) / group) <= 1
        rest = cut(_cells(rest, group, last))
        done.append(rest.where("chance = 1").select("_row"))
        if last:
            break
        rest = rest.where("chance > 0 AND chance < 1")
        group *= CELL // 2
    more = done[0]
    for part in done[1:]:
        more = more.unionByName(part)
    taken = rated.join(more.withColumn("_more", F.lit(1)), "_row", "left")
    taken = cut(taken.withColumn("copies", (F.col("base") + F.coalesce("_more", F.lit(0))).cast("long")))
    for _ in range(EXCHANGES):
        step = cut(_exchange(taken, most, held))
        if step.isEmpty():
            break
        # At most one row a source, as few as those.
        taken = taken.join(held(step), F.col("_row") == F.col("_picked"), "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_picked", "_step")
    return taken.select("_row", "doc_id", "size", "source_size", "target", "copies")


def _exchange(taken: DataFrame, most: int, held) -> DataFrame:
    """One more step of the landing, where a source's words are still off its target because of long documents: _picked and _step.

    In each source that is off by more than CLOSE of its target the one document is taken once more, or once less, whose
    size is nearest to what is missing, or too much, if that brings the source nearer.
    """
    off = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("off"), F.first("target").alias("goal"))
    off = off.withColumnRenamed("source", "s").where(F.abs("off") > CLOSE * F.col("goal")).drop("goal")
    able = F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    miss = F.abs(F.col("size") - F.abs(F.col("off")))
    pick = taken.join(held(off), F.col("source").eqNullSafe(F.col("s"))).where(able & (miss < F.abs(F.col("off"))))
    pick = pick.groupBy("s").agg(F.min(F.struct(miss.alias("miss"), "_row", F.signum("off").cast("long").alias("_step"))).alias("p"))
    return pick.select(F.col("p._row").alias("_picked"), "p._step")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns as they are, as often as it is taken."""
    row, often = fresh(docs, "_row"), fresh(docs, "_often")
    taken = copies(docs, weights, most).where("copies > 0").select(F.col("_row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(often))
    return with_row(docs, row).join(taken, row).withColumn(often, F.explode(often)).drop(often, row)
