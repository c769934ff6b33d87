"""Reachability and cheapest paths over a whole graph by overlays of cells.

The plane is cut into cells. In one pass a task a cell finds what it costs to cross the cell, from each node at which a
link enters it to each at which one leaves it. Those crossings and the links between cells are the next level's graph,
which is cut into cells ``FAN`` times as wide, and so on until a level has no more than ``most`` links. So the number of
Spark jobs goes with the logarithm of the plane, not with the hops of a path, and what a task holds is a cell's part of one
level: street corners on a square kilometre, or crossings of a few cells.

A question climbs from its start's cell to the top, is answered there among the few links that are left, and descends
to its goal's cell. What it finds is a chain of crossings, which are unpacked level by level into links of the graph.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search

UNIT, FAN = 100_000_000, 4
#: Questions that a task of a cell answers, about; beyond it the cell's links are given to several tasks.
TOGETHER = 2000
LINK, LEAVES, ENTERS, SEED = range(4)
GRAPH = "mode string, src long, dst long, cost double, level int"
CHAIN = "array<struct<level:int,src:bigint,dst:bigint,cost:double>>"
STEP = pa.list_(pa.struct([("level", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("cost", pa.float64())]))


class Overlay(NamedTuple):
    """``graphs[k](mode, src, dst, cost, level)`` is the graph of level k. A link of level 0 is one of the whole graph's, one of
    level j + 1 a crossing of a cell of level j. ``size`` is the width of the smallest cells in hundred-thousandths of a degree."""

    graphs: list[DataFrame]
    size: int

    @property
    def top(self) -> int:
        return len(self.graphs) - 1

    def step(self, k: int) -> int:
        return self.size * FAN**k

    def cell(self, node: str, k: int) -> Column:
        return F.expr(f"({node} div {UNIT} div {self.step(k)}) * 4294967296L + {node} % {UNIT} div {self.step(k)}")

    def within(self, k: int) -> DataFrame:
        """The links of level k that stay in their ``cell``."""
        return self.graphs[k].withColumn("cell", self.cell("src", k)).where(F.col("cell") == self.cell("dst", k))

    def between(self, k: int) -> DataFrame:
        return self.graphs[k].where(self.cell("src", k) != self.cell("dst", k))

    def leaving(self, k: int) -> DataFrame:
        """The nodes at which a link leaves its ``cell``."""
        return self.between(k).select("mode", self.cell("src", k).alias("cell"), F.col("src").alias("node")).distinct()


def build(edges: DataFrame, size: int = 1000, most: int = 100_000) -> Overlay:
    """The overlay of ``edges(mode, src, dst, cost)``; node ids tell where they are. An empty graph has an empty level above it."""
    found = Overlay([edges.select("mode", "src", "dst", "cost", F.lit(0).alias("level")).checkpoint()], size)
    while True:
        k = found.top
        across = found.between(k)
        ends = across.select("mode", found.cell("src", k).alias("cell"), F.col("src").alias("src"), F.lit(LEAVES).alias("kind")).unionByName(
            across.select("mode", found.cell("dst", k).alias("cell"), F.col("dst").alias("src"), F.lit(ENTERS).alias("kind"))
        )
        rows = found.within(k).select("mode", "cell", "src", "dst", "cost", F.lit(LINK).alias("kind")).unionByName(ends.distinct(), allowMissingColumns=True)
        crossings = rows.groupBy("mode", "cell").applyInArrow(_crossings, "mode string, src long, dst long, cost double")
        found.graphs.append(across.unionByName(crossings.withColumn("level", F.lit(k + 1))).checkpoint())
        if found.graphs[-1].count() <= most:
            return found


def _columns(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def _parts(table: pa.Table) -> tuple[search.Links, dict[int, list[int]]]:
    """The links among the rows, and the nodes of the other kinds."""
    own, nodes = [], defaultdict(list)
    for kind, src, dst, cost in zip(*_columns(table, "kind", "src", "dst", "cost"), strict=True):
        if kind == LINK:
            own.append((src, dst, cost))
        else:
            nodes[kind].append(src)
    return search.links(*(zip(*own, strict=True) if own else ((), (), ()))), nodes


def _crossings(key: tuple, table: pa.Table) -> pa.Table:
    out, nodes = _parts(table)
    leaves, rows = nodes[LEAVES], []
    for start in nodes[ENTERS]:
        cost = search.cheapest(out, {start: 0.0}, leaves).cost if start in out else {}
        rows += [(start, end, cost[end]) for end in leaves if end in cost and end != start]
    src, dst, cost = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"mode": pa.array([key[0].as_py()] * len(rows), pa.string()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "cost": pa.array(cost, pa.float64())})


# --- reachability


def _spread(links: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """mode and node of what ``seeds(*keys, node)`` reach along ``links(*keys, src, dst)``; a task for each group that has seeds."""
    at = keys.index("mode")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out, nodes = _parts(table)
        found = sorted(search.reached(out, nodes[SEED]))
        return pa.table({"mode": pa.array([key[at].as_py()] * len(found), pa.string()), "node": pa.array(found, pa.int64())})

    own = links.join(seeds.select(*keys).distinct(), keys, "left_semi").select(*keys, "src", "dst", "cost", F.lit(LINK).alias("kind"))
    rows = own.unionByName(seeds.select(*keys, F.col("node").alias("src"), F.lit(SEED).alias("kind")), allowMissingColumns=True)
    return rows.groupBy(*keys).applyInArrow(run, "mode string, node long")


def reachable(o: Overlay, starts: DataFrame) -> DataFrame:
    """mode and node of all that ``starts(mode, node)`` lead to along directed links, the starts included.

    Up: what the starts reach within their cells, and of it the nodes at which a link leaves. At the top all is reached in
    one task a mode, which holds at most the top's links. Down: each cell with reached nodes spreads them.
    """
    celled = lambda nodes, k: nodes.select("mode", "node", o.cell("node", k).alias("cell"))
    seeds = [starts.select("mode", "node").distinct().checkpoint()]
    for k in range(o.top):
        there = _spread(o.within(k), celled(seeds[k], k), ["mode", "cell"])
        leaving = o.leaving(k).select("mode", "node")
        seeds.append(there.join(leaving, ["mode", "node"], "left_semi").checkpoint())
    found = _spread(o.graphs[o.top], seeds[o.top], ["mode"])
    for k in reversed(range(o.top)):
        own = found.unionByName(seeds[k]).distinct().checkpoint()
        found = _spread(o.within(k), celled(own, k), ["mode", "cell"])
    return found.distinct()


# --- paths


class _Level(NamedTuple):
    out: search.Links
    level: dict[tuple[int, int], int]


def _level(src: list[int], dst: list[int], cost: list[float], level: list[int]) -> _Level:
    out, levels = {}, {}
    for s, d, c, lev in zip(src, dst, cost, level, strict=True):
        held = out.setdefault(s, {})
        if d not in held or c < held[d]:
            held[d], levels[s, d] = c, lev
    return _Level(out, levels)


def _steps(graph: _Level, path: list[int]) -> list[dict]:
    return [{"level": graph.level[a, b], "src": a, "dst": b, "cost": graph.out[a][b]} for a, b in zip(path, path[1:], strict=False)]


LABEL = "mode string, pair long, goal long, node long, cost double, chain " + CHAIN
LABELS = pa.schema([("mode", pa.string()), ("pair", pa.int64()), ("goal", pa.int64()), ("node", pa.int64()), ("cost", pa.float64()), ("chain", STEP)])


def _labelled(graph: _Level, mode: str, rows: Iterator[tuple], goals, steps) -> pa.Table:
    """From the seeds ``(pair, goal, node, cost, chain)`` of each pair the labels of ``goals(goal)``; ``steps(found, end)`` is what a chain gets."""
    asked: dict[int, tuple[int, dict]] = {}
    for pair, goal, node, cost, chain in rows:
        held = asked.setdefault(pair, (goal, {}))[1]
        if node not in held or cost < held[node][0]:
            held[node] = (cost, chain)
    out = []
    for pair, (goal, seeds) in asked.items():
        ends = goals(goal)
        found = search.cheapest(graph.out, {n: c for n, (c, _) in seeds.items()}, ends)
        for end in ends:
            if end in found.cost:
                path = found.path(end)
                out.append((mode, pair, goal, end, found.cost[end], [*seeds[path[0]][1], *steps(path)]))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, LABELS.types, strict=True)], schema=LABELS)


def _in_cells(o: Overlay, k: int, seeds: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Labels of ``ends(mode, cell, node)`` for all seeds in their cell of level k; without ``ends``, of the nodes on the way to the goal.

    ``seeds`` have the columns of LABEL and ``cell``. On the way are the nodes in the goal's cell of the level below, or the goal.
    """
    step, below, onward = k + 1, o.step(k - 1) if k else 0, ends is None

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind")
        own, asked, last = (table.filter(pc.equal(kinds, kind)) for kind in (LINK, SEED, LEAVES))
        graph = _level(*_columns(own, "src", "dst", "cost", "level"))
        leaves = last.column("src").to_pylist()
        if onward and below:
            near = defaultdict(list)
            for n in sorted({*graph.out, *(d for held in graph.out.values() for d in held), *asked.column("src").to_pylist()}):
                near[n // UNIT // below, n % UNIT // below].append(n)
            goals = lambda goal: near[goal // UNIT // below, goal % UNIT // below]
        else:
            goals = (lambda goal: [goal]) if onward else (lambda goal: leaves)
        crossed = lambda path: [{"level": step, "src": path[0], "dst": path[-1], "cost": None}] if len(path) > 1 else []
        return _labelled(graph, key[0].as_py(), zip(*_columns(asked, "pair", "goal", "src", "cost", "chain"), strict=True), goals, crossed)

    keys = ["mode", "cell", "salt"]
    shares = seeds.groupBy("mode", "cell").agg(F.ceil(F.count_distinct("pair") / TOGETHER).cast("int").alias("shares"))
    every = lambda df: df.join(shares, ["mode", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    rows = every(o.within(k)).select(*keys, "src", "dst", "cost", "level", F.lit(LINK).alias("kind"))
    salted = seeds.join(shares, ["mode", "cell"]).withColumn("salt", F.pmod("pair", "shares").cast("int"))
    rows = rows.unionByName(salted.select(*keys, F.col("node").alias("src"), "cost", "pair", "goal", "chain", F.lit(SEED).alias("kind")), allowMissingColumns=True)
    if ends is not None:
        rows = rows.unionByName(every(ends).select(*keys, F.col("node").alias("src"), F.lit(LEAVES).alias("kind")), allowMissingColumns=True)
    return rows.groupBy(*keys).applyInArrow(run, LABEL)


def _at_top(o: Overlay, seeds: DataFrame) -> DataFrame:
    """Labels of the nodes of the top graph in the goal's cell below it. The top is broadcast, which ``build`` has counted."""
    spark, below = seeds.sparkSession, o.step(o.top - 1)
    graphs: dict[str, list] = defaultdict(lambda: [[], [], [], []])
    for row in o.graphs[o.top].collect():
        for held, value in zip(graphs[row["mode"]], (row["src"], row["dst"], row["cost"], row["level"]), strict=True):
            held.append(value)
    shared = spark.sparkContext.broadcast(dict(graphs))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        graph = _level(*shared.value.get(key[0].as_py(), [[], [], [], []]))
        near = defaultdict(list)
        for n in sorted({*graph.out, *(d for held in graph.out.values() for d in held)}):
            near[n // UNIT // below, n % UNIT // below].append(n)
        goals = lambda goal: near[goal // UNIT // below, goal % UNIT // below]
        return _labelled(graph, key[0].as_py(), zip(*_columns(table, "pair", "goal", "node", "cost", "chain"), strict=True), goals, lambda path: _steps(graph, path))

    salted = seeds.withColumn("salt", F.pmod(F.xxhash64("pair"), F.ceil(F.lit(max(seeds.select("mode", "pair").distinct().count(), 1) / TOGETHER))))
    return salted.groupBy("mode", "salt").applyInArrow(run, LABEL)


def _unpacked(o: Overlay, steps: DataFrame) -> DataFrame:
    """``steps(mode, pair, at, level, src, dst, cost)`` with all crossings as the links they are made of; ``at`` orders a pair's steps."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind")
        own, asked = (table.filter(pc.equal(kinds, kind)) for kind in (LINK, SEED))
        graph = _level(*_columns(own, "src", "dst", "cost", "level"))
        by_start = defaultdict(list)
        for src, dst in zip(*_columns(asked, "src", "dst"), strict=True):
            by_start[src].append(dst)
        rows = []
        for src, ends in by_start.items():
            found = search.cheapest(graph.out, {src: 0.0}, ends)
            rows += [(src, dst, _steps(graph, found.path(dst))) for dst in ends]
        src, dst, parts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"mode": pa.array([key[0].as_py()] * len(rows), pa.string()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "parts": pa.array(parts, STEP)})

    for level in range(o.top, 0, -1):
        steps = steps.checkpoint()
        some = steps.where(F.col("level") == level)
        asked = some.select("mode", "src", "dst").distinct().withColumn("cell", o.cell("src", level - 1))
        links = o.within(level - 1).join(asked.select("mode", "cell").distinct(), ["mode", "cell"], "left_semi")
        rows = links.select("mode", "cell", "src", "dst", "cost", "level", F.lit(LINK).alias("kind")).unionByName(asked.withColumn("kind", F.lit(SEED)), allowMissingColumns=True)
        parts = rows.groupBy("mode", "cell").applyInArrow(run, f"mode string, src long, dst long, parts {CHAIN}")
        opened = some.join(parts, ["mode", "src", "dst"]).select("mode", "pair", "at", F.posexplode("parts").alias("place", "p"))
        opened = opened.select("mode", "pair", F.concat("at", F.array("place")).alias("at"), "p.*")
        steps = steps.where(F.col("level") != level).unionByName(opened)
    return steps


def routes(o: Overlay, pairs: DataFrame) -> DataFrame:
    """Cheapest paths: mode, pair, idx, node and cost (from the start) for each node on the path of each of ``pairs(mode, pair, src, dst)``.

    A pair without a path has no rows; one whose ends are one node has that node. ``pair`` tells pairs of a mode apart. Of
    paths that cost the same any one may be found. Pairs are dealt to tasks of their cells, so that many of one cell share
    its links, and are salted where they are more than TOGETHER.
    """
    pairs = pairs.select("mode", "pair", "src", "dst").checkpoint()
    start = pairs.select("mode", "pair", F.col("dst").alias("goal"), F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.array().cast(CHAIN).alias("chain"))
    seeds = [start]
    for k in range(o.top):
        celled = seeds[k].withColumn("cell", o.cell("node", k))
        seeds.append(_in_cells(o, k, celled, o.leaving(k)).checkpoint())
    found = _at_top(o, seeds[o.top])
    for k in reversed(range(o.top)):
        # What came from above into the goal's cell, and what never left it.
        own = found.unionByName(seeds[k].where(o.cell("node", k) == o.cell("goal", k)))
        found = _in_cells(o, k, own.withColumn("cell", o.cell("goal", k)), None).checkpoint()
    steps = found.select("mode", "pair", F.posexplode("chain").alias("place", "s")).select("mode", "pair", F.array("place").alias("at"), "s.*")
    w = Window.partitionBy("mode", "pair").orderBy("at")
    ends = _unpacked(o, steps).select("mode", "pair", F.row_number().over(w).alias("idx"), F.col("dst").alias("node"), F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cost"))
    first = found.select("mode", "pair").join(pairs, ["mode", "pair"]).select("mode", "pair", F.lit(0).alias("idx"), F.col("src").alias("node"), F.lit(0.0).alias("cost"))
    return first.unionByName(ends)
