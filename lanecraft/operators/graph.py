"""The street graph: directed edges with costs, nodes, snapping, reachability and shortest paths."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets
from lanecraft.functions.once import once

from . import search, spatial

FLAT = streets.flat


def shared_folder(spark: SparkSession) -> str:
    """The folder for what all executors share: the session's checkpoint folder, which must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at


def with_class(ways: DataFrame, t: streets.Tags = FLAT) -> DataFrame:
    """``ways`` with the columns of its classification and ``item``.

    In steps, each a projection whose columns the next one names: written as one expression, what they share would be
    spelled out again at each use, beyond what a generated method can hold.
    """
    first, found, level, item = _class_steps(t)
    return ways.withColumns(first).withColumns(found).withColumn("path_level", level).withColumn("item", item).drop(*first)


@once
def _class_steps(t: streets.Tags) -> tuple[dict[str, Column], dict[str, Column], Column, Column]:
    first = {"_lane": streets.lane_kind(t), "_speed": streets.number(t("maxspeed")), "_lanes": streets.number(t("lanes"))}
    found = streets.classified(t, F.col("_lane"), F.col("_speed"), F.col("_lanes"))
    found.pop("path_level")
    flags = ("car_free", "bike_priority", "bike_infra", "speed_kmh")
    return first, found, streets.path_level(F.col("lts"), *map(F.col, flags)), streets.item(t, F.col("path_level"))


@once
def _decision() -> dict[str, Column]:
    return streets.decision(F.col("path_level"), F.col("item"), F.col("surface_"), F.col("smoothness_"), F.col)


def decided(classed: DataFrame, modes: DataFrame) -> DataFrame:
    """Every way under every mode: accepted_, reason, walks, kmh and mult. ``modes`` is a handful of rows."""
    wide = classed.join(F.broadcast(modes))
    return wide.withColumns(_decision())


def edges(decided: DataFrame, preferred: Column, elevation: tuple[Column, Column] | None = None, avoid: DataFrame | None = None, t: streets.Tags = FLAT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Directed edges mode, src, dst (snapped node ids), dist, cost, way_id, is_walking, ord, and ``keep`` of their way; repeated pairs still there.

    Ways for walking only are walked; refused ways are walked if they may be, else dropped. A way whose item isn't
    ``preferred`` is ridden no faster than the slow speed. A steep way is walked if it may be, else dropped. The other direction is there unless
    the way is one-way. ``avoid(way_id)`` are left out. No shuffle but for ``avoid``.
    """
    ways = decided.where(F.size("coords") >= 2)
    if avoid is not None:
        ways = ways.join(avoid.select("way_id").distinct(), "way_id", "left_anti")
    on_foot = streets.walking_only(t)
    ways = ways.where(on_foot | F.col("accepted_") | streets.bridge_walkable(t))
    slow = F.col("item").isNotNull() & ~preferred & ~F.col("walks")
    ride = F.when(slow, F.least("kmh", "slow_kmh")).otherwise(F.col("kmh"))
    kmh = F.when(on_foot | ~F.col("accepted_"), F.col("walk_kmh")).otherwise(ride)
    walking = on_foot | ~F.col("accepted_") | F.col("walks")
    mult = F.when(on_foot | ~F.col("accepted_"), 1.0).otherwise(F.col("mult"))
    if elevation is not None:
        steep = F.coalesce(geo.gradient_percent(elevation[1] - elevation[0], geo.length(F.col("coords"))) > F.col("gradient_cap"), F.lit(False)) & ~walking
        kmh, mult, walking = F.when(steep, F.col("walk_kmh")).otherwise(kmh), F.when(steep, 1.0).otherwise(mult), walking | steep
        ways = ways.where(~steep | streets.bridge_walkable(t))
    ways = ways.select("mode", "way_id", "coords", kmh.alias("kmh"), walking.alias("is_walking"), mult.alias("mult"), streets.one_way(t).alias("single"), *keep)
    legs = F.transform(F.sequence(F.lit(1), F.size("coords") - 1), lambda i: F.struct(i.alias("seg"), F.element_at("coords", i).alias("a"), F.element_at("coords", i + 1).alias("b")))
    ways = ways.select("mode", "way_id", "kmh", "is_walking", "mult", "single", *keep, F.inline(legs))
    ways = ways.withColumn("dist", geo.haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")))
    ways = ways.withColumn("cost", F.col("dist") / (F.col("kmh") / 3.6) * F.col("mult"))
    both = F.array(F.struct(F.lit(0).alias("back"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.lit(1).alias("back"), F.col("b").alias("src"), F.col("a").alias("dst")))
    ways = ways.select("mode", "way_id", "seg", "dist", "cost", "is_walking", *keep, F.inline(F.when(F.col("single"), F.slice(both, 1, 1)).otherwise(both)))
    order = F.struct("way_id", "seg", "back").alias("ord")
    return ways.select("mode", node_id("src").alias("src"), node_id("dst").alias("dst"), "dist", "cost", "way_id", "is_walking", order, F.col("src").alias("src_point"), F.col("dst").alias("dst_point"), *keep)


def node_id(point: str) -> Column:
    """A vertex as one number: fixed-point coordinates of five decimals."""
    lat, lng = geo.half_up(F.col(f"{point}.lat") * 1e5), geo.half_up(F.col(f"{point}.lng") * 1e5)
    return ((lat + 9_000_000) * F.lit(100_000_000).cast("long") + (lng + 18_000_000)).cast("long")


def last_edges(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One edge for each pair of nodes of a mode: the last in the order of ways, segments and directions.

    With ``tasks`` the edges are dealt to that many by their pair of nodes, so that each sorts its share of them once; else
    Spark says how many.
    """
    if tasks is not None:
        edges = edges.repartition(tasks, "mode", "src", "dst")
    best = F.max_by(F.struct("dist", "cost", "way_id", "is_walking"), "ord")
    return edges.groupBy("mode", "src", "dst").agg(best.alias("e")).select("mode", "src", "dst", "e.*")


def nodes(edges: DataFrame) -> DataFrame:
    """Nodes of each mode with the coordinates that came first."""
    ends = edges.select("mode", "ord", F.col("src").alias("node"), F.col("src_point").alias("p"), F.lit(0).alias("end")).unionByName(
        edges.select("mode", "ord", F.col("dst").alias("node"), F.col("dst_point").alias("p"), F.lit(1).alias("end"))
    )
    return ends.groupBy("mode", "node").agg(F.min_by(F.struct("p.lat", "p.lng"), F.struct("ord", "end")).alias("p")).select("mode", "node", "p.lat", "p.lng")


def snapped(points: DataFrame, nodes: DataFrame, reach_m: float = 1000.0) -> DataFrame:
    """``points(point, mode, lat, lng)`` with the nearest of ``nodes(mode, node, lat, lng)`` within ``reach_m``, ties to the smaller node; none: null.

    By growing rings of cells, see ``spatial.rings``.
    """
    found = spatial.rings(points, nodes, ["point", "mode"], "node", reach_m, same=("mode",))
    return found.select("point", "mode", "node", F.col("far").alias("metres"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """mode and node of all that ``starts(mode, node)`` lead to along directed edges, the starts included: over the whole graph, by its overlay."""
    from . import overlay

    return overlay.reachable(overlay.build(edges.select("mode", "src", "dst", F.lit(1.0).alias("cost"))), starts)


def reachable_in_regions(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same for ``edges(mode, region, src, dst)`` that stay in their region and ``starts(mode, region, node)``: one task for a region's graph."""

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        links = defaultdict(list)
        for s, d in zip(graph["src"].tolist(), graph["dst"].tolist(), strict=True):
            links[s].append(d)
        seen = set(asked["node"].tolist())
        stack = list(seen)
        while stack:
            for node in links.get(stack.pop(), ()):
                if node not in seen:
                    seen.add(node)
                    stack.append(node)
        mode = asked["mode"].iloc[0] if len(asked) else None
        return pd.DataFrame({"mode": [mode] * len(seen), "node": sorted(seen)})

    links = edges.select("mode", "region", "src", "dst").distinct()
    return links.groupBy("mode", "region").cogroup(starts.groupBy("mode", "region")).applyInPandas(run, "mode string, node long")


def routes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cheapest paths: a row mode, pair, idx, node, cost (from the start) for each node on the path of each of ``pairs(mode, region, pair, src, dst)``.

    ``edges(mode, region, src, dst, cost)``: a region's graph of a mode goes to one task, so regions are bounded (a
    city's tiles); there are as many tasks as modes and regions. A pair without a path has no rows. ``overlay.routes``
    finds paths in graphs of any size.
    """

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        links, out = search.links(*(graph[c].tolist() for c in ("src", "dst", "cost"))), []
        for start, group in asked.groupby("src"):
            found = search.cheapest(links, {start: 0.0}, group["dst"].tolist())
            for mode, pair, goal in zip(group["mode"], group["pair"], group["dst"], strict=True):
                if goal in found.cost:
                    out += [(mode, pair, i, node, found.cost[node]) for i, node in enumerate(found.path(goal))]
        return pd.DataFrame(out, columns=["mode", "pair", "idx", "node", "cost"])

    pairs = pairs.toDF(*pairs.columns)  # new columns even where pairs come from the edges
    return edges.groupBy("mode", "region").cogroup(pairs.groupBy("mode", "region")).applyInPandas(run, "mode string, pair long, idx int, node long, cost double")


def legs_joined(legs: DataFrame) -> DataFrame:
    """Legs ``(trip, leg, idx, node, km, seconds)`` as one path a trip: all but the first leg lose their first point."""
    w = Window.partitionBy("trip").orderBy("leg", "idx")
    return legs.where((F.col("leg") == 0) | (F.col("idx") > 0)).withColumn("at", F.row_number().over(w) - 1)
