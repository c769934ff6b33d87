"""Whole routes and what one asks of them: requests end to end, the ways of a path, runs, samples and manoeuvres."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets
from lanecraft.sources import dims

from . import graph, search, segments, spatial


def ways_on_path(steps: DataFrame) -> DataFrame:
    """What each way adds up to on the path of ``steps(route, idx, way_id, dist, cost, is_walking)``, and its place by first use.

    Division is IEEE's: a way whose edges take no time, as of a rider who stands still, has a speed of NaN.
    """
    sums = steps.groupBy("route", "way_id").agg(F.count("*").alias("edges"), F.sum("dist").alias("metres"), F.sum("cost").alias("seconds"), F.bool_or("is_walking").alias("walked"), F.min("idx").alias("first"))
    place = F.row_number().over(Window.partitionBy("route").orderBy("first"))
    still = F.col("metres") * F.lit(float("inf"))  # NaN of 0 metres
    return sums.withColumns({"kmh": F.when(F.col("seconds") == 0, still).otherwise(F.try_divide("metres", "seconds")) * 3.6, "place": place}).drop("first")


def way_runs(steps: DataFrame) -> DataFrame:
    """Runs of neighbouring steps of one way: route, run, way_id, edges, metres and seconds."""
    w = Window.partitionBy("route").orderBy("idx")
    found = segments.islands(steps, "route", "idx", F.col("way_id").eqNullSafe(F.lag("way_id").over(w)), "run")
    return found.groupBy("route", "run").agg(F.first("way_id").alias("way_id"), F.count("*").alias("edges"), F.sum("dist").alias("metres"), F.sum("cost").alias("seconds"))


def ways_at(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """``points`` with way_id of all ways that have one of ``vertices(way_id, lat, lng)`` there, to five decimals."""
    snap = lambda c: geo.half_up(F.col(c) * 1e5).cast("long")
    there = vertices.select("way_id", snap("lat").alias("_ilat"), snap("lng").alias("_ilng")).distinct()
    return points.withColumns({"_ilat": snap("lat"), "_ilng": snap("lng")}).join(there, ["_ilat", "_ilng"]).drop("_ilat", "_ilng")


def in_graph(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """``expected(way_id)`` with whether the graph has an edge of that way."""
    held = edges.select("way_id").distinct().withColumn("routable", F.lit(True))
    return expected.join(held, "way_id", "left").select("way_id", F.coalesce("routable", F.lit(False)).alias("routable"))


def strided(points: DataFrame, most: int) -> DataFrame:
    """Every k-th of a route's ``points(route, idx)`` and the last, with k so that about ``most`` are left."""
    sizes = points.groupBy("route").agg(F.count("*").alias("_n"))
    stride = F.greatest(F.floor((F.col("_n") + (most - 1)) / most), F.lit(1))
    return points.join(sizes, "route").where((F.col("idx") % stride == 0) | (F.col("idx") == F.col("_n") - 1)).drop("_n")


def manoeuvre_points(manoeuvres: DataFrame, points: DataFrame) -> DataFrame:
    """``manoeuvres(route, id, begin_idx)`` with lat and lng of the point at which their shape begins, the route's first if that is null."""
    at = points.select("route", F.col("idx").alias("_at"), "lat", "lng")
    asked = manoeuvres.withColumn("_at", F.coalesce("begin_idx", F.lit(0)).cast("long"))
    return asked.join(at, ["route", "_at"], "left").drop("_at")


EDGE = ("src", "dst", "dist", "cost", "way_id", "is_walking", "item")
PATH = "route long, idx int, src long, dst long, dist double, cost double, way_id long, is_walking boolean, item string, graph_nodes long, graph_edges long"
#: Requests that a task routes over one graph, about, and from how many on landmarks pay.
TOGETHER, LANDMARKS_FROM = 1024, 16
#: From how many requests of one start on a search that reaches everything pays, instead of one for each goal.
SEARCH_FROM = 4
#: Ways of a task.
WAYS = 2000


class _Corridor:
    """The graph of a corridor, held once for all its requests."""

    def __init__(self, rows: pa.Table):
        src, dst, cost = (rows.column(c).to_pylist() for c in ("src", "dst", "cost"))
        self.edges = {pair: at for at, pair in enumerate(zip(src, dst, strict=True))}
        self.out = search.links(src, dst, cost)
        self.into = {d for _, d in self.edges}
        self.nodes = np.array(sorted({n for pair in self.edges for n in pair}), np.int64)
        self.lat, self.lng = self.nodes // 100_000_000 / 1e5 - 90, self.nodes % 100_000_000 / 1e5 - 180
        self.leaving = np.isin(self.nodes, np.fromiter(self.out, np.int64, len(self.out)))
        self.speed = max((d / c for d, c in zip(rows.column("dist").to_pylist(), cost, strict=True) if c > 0), default=1.0) or 1.0
        self.starts: dict[tuple[float, float], int | None] = {}

    def nearest(self, lat: float, lng: float, among: np.ndarray, reach_m: float) -> int | None:
        """The node among those of a mask that is nearest, of equally near ones the smallest id; None if it is farther than ``reach_m``."""
        if not among.any():
            return None
        x = np.sin(np.radians(self.lat[among] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(self.lat[among])) * np.sin(np.radians(self.lng[among] - lng) / 2) ** 2
        far = 2 * geo.EARTH_M * np.arctan2(np.sqrt(x), np.sqrt(1 - x))
        best = int(far.argmin())
        return int(self.nodes[among][best]) if far[best] <= reach_m else None

    def start(self, lat: float, lng: float, reach_m: float) -> int | None:
        """The nearest node that an edge leaves."""
        if (lat, lng) not in self.starts:
            self.starts[lat, lng] = self.nearest(lat, lng, self.leaving, reach_m)
        return self.starts[lat, lng]

    def paths(self, start: int, ends: list[tuple[float, float]], reach_m: float, landmarks: search.Landmarks | None) -> Iterator[list[int] | None]:
        """A path from ``start`` for each of ``ends``, to the nearest node that one can end at: it is reached and has a link into it; only the start itself if there is none."""
        whole = search.cheapest(self.out, {start: 0.0}) if len(ends) >= SEARCH_FROM else None
        held = (whole.cost.keys() if whole else search.reached(self.out, [start])) & self.into or {start}
        mask = np.isin(self.nodes, np.fromiter(held, np.int64, len(held)))
        goals: dict[tuple[float, float], int | None] = {}
        for end in ends:
            if end not in goals:
                goals[end] = self.nearest(*end, mask, reach_m)
            goal = goals[end]
            if goal is None:
                yield None
            elif whole:
                yield whole.path(goal)
            else:
                bound = search.straight(goal, self.speed)
                if landmarks:
                    bound = search.larger(bound, landmarks.bound(goal))
                yield search.cheapest(self.out, {start: 0.0}, [goal], bound).path(goal)


def _box(pad: float) -> dict[str, Column]:
    """The tiles that bound a request."""
    return {n: geo.tile(f(*(F.col(f"{c}{k}") for k in (1, 2))) + s * F.lit(pad)) for n, f, c, s in (("s", F.least, "lat", -1), ("n", F.greatest, "lat", 1), ("w", F.least, "lng", -1), ("e", F.greatest, "lng", 1))}


def _tile() -> dict[str, Column]:
    """The tile of an edge, which is its start's."""
    return {"tile_row": geo.tile(F.floor(F.col("src") / 100_000_000) / 1e5 - 90), "tile_col": geo.tile(F.pmod(F.col("src"), F.lit(100_000_000).cast("long")) / 1e5 - 180)}


def tiles_of(asked: DataFrame, pad: float) -> DataFrame:
    """mode, tile_row and tile_col of all tiles that requests touch."""
    boxes = asked.select("mode", *(c.alias(n) for n, c in _box(pad).items())).distinct()
    return boxes.withColumn("tile_row", F.explode(F.sequence("s", "n"))).withColumn("tile_col", F.explode(F.sequence("w", "e"))).select("mode", "tile_row", "tile_col").distinct()


def near(ways: DataFrame, tiles: DataFrame) -> DataFrame:
    """``ways`` with a vertex in any of ``tiles``, whatever its mode, dealt anew. Ids are found first, so that nothing else of other ways is worked out."""
    # An outer explosion, as an inner one tests for vertices where the table is read, in as few tasks as it has files.
    at = ways.select("way_id", F.explode_outer("coords").alias("v")).select("way_id", graph.node_id("v").alias("src")).withColumns(_tile())
    found = at.join(spatial.counted(tiles.select("tile_row", "tile_col").distinct()), ["tile_row", "tile_col"], "left_semi").select("way_id").distinct().checkpoint()
    held = ways.join(spatial.counted(found.toDF("_near")), F.col("way_id").eqNullSafe(F.col("_near")), "left_semi")
    return held.repartition(max(math.ceil(found.count() / WAYS), 1), "way_id")


def in_corridors(edges: DataFrame, asked: DataFrame, pad: float) -> DataFrame:
    """``edges(mode, src)`` in the tiles of any request of their mode."""
    tiles = tiles_of(asked, pad).checkpoint()
    return edges.withColumns(_tile()).join(spatial.counted(tiles), ["mode", "tile_row", "tile_col"], "left_semi").drop("tile_row", "tile_col")


def corridors(asked: DataFrame, links: DataFrame, every: DataFrame, pad: float) -> tuple[DataFrame, DataFrame]:
    """The edges of each corridor that is asked for, and its requests, both by corridor and share. See ``shared_paths``."""
    key = ["mode", "s", "n", "w", "e", "avoid"]
    wanted = asked.withColumns(_box(pad)).withColumn("avoid", F.array_sort(F.array_distinct(F.coalesce("avoid", F.array().cast("array<bigint>"))))).withColumn("corridor", F.xxhash64(*key))
    groups = wanted.groupBy("corridor", *key).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares")).checkpoint()
    tiles = groups.withColumn("tile_row", F.explode(F.sequence("s", "n"))).withColumn("tile_col", F.explode(F.sequence("w", "e"))).select("corridor", "mode", "avoid", "shares", "tile_row", "tile_col")
    met = lambda some, edges: some.join(edges.withColumns(_tile()), ["mode", "tile_row", "tile_col"])
    plain = met(tiles.where(F.size("avoid") == 0), links).select("corridor", "shares", *EDGE)
    others = met(tiles.where(F.size("avoid") > 0), every).where(~F.array_contains("avoid", F.col("way_id")))
    others = others.groupBy("corridor", "shares", "src", "dst").agg(F.max_by(F.struct(*EDGE[2:]), "ord").alias("e")).select("corridor", "shares", "src", "dst", "e.*")
    own = plain.unionByName(others).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # Requests that start near each other go to one share, but in pieces, lest a start that many have fills it.
    cell = [F.coalesce(geo.tile(F.col(c), 0.001), F.lit(0)).alias(n) for c, n in (("lat1", "_row"), ("lng1", "_col"))]
    pieces = wanted.groupBy("corridor", *cell).agg(F.ceil(F.count("*") / TOGETHER).alias("pieces")).checkpoint()
    shares = groups.select("corridor", "shares")
    dealt = wanted.select("*", *cell).join(spatial.counted(pieces), ["corridor", "_row", "_col"]).join(spatial.counted(shares), "corridor")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("_row", "_col", F.pmod(F.xxhash64("route"), "pieces")), "shares").cast("int"))
    return own, dealt.select("corridor", "share", "route", "lat1", "lng1", "lat2", "lng2")


def shared_paths(asked: DataFrame, links: DataFrame, every: DataFrame, pad: float = 0.05, reach_m: float = 1000.0) -> DataFrame:
    """The edges on the paths of ``asked(route, mode, lat1, lng1, lat2, lng2, avoid)``: route, idx and those of EDGE, and how large the graph was.

    Requests of a mode whose padded boxes touch the same tiles, and that avoid the same ways, share a graph: ``links`` (one for
    each pair of nodes) in those tiles, or the last of ``every`` edge that isn't on an avoided way. So the edges that are
    shuffled grow with the corridors that are asked for, not with the requests; more than TOGETHER requests of a
    corridor are dealt to several tasks, those that start near each other to the same one, as SEARCH_FROM and more of one start
    share a search. The start is the nearest node that an edge leaves, the end the nearest that can be
    reached, both within ``reach_m``. A path of one node has a row without edge (idx 0, dst null); a request without a path none.
    """
    own, dealt = corridors(asked, links, every, pad)
    dealt = dealt.toDF(*dealt.columns)  # new columns, as both come from the requests

    def run(edges: pa.Table, requests: pa.Table) -> pa.Table:
        routes, steps, nodes, taken, sizes = [], [], [], [], (0, 0)
        if edges.num_rows and requests.num_rows:
            graph, asked = _Corridor(edges), {}
            for route, *ends in zip(*(requests.column(c).to_pylist() for c in ("route", "lat1", "lng1", "lat2", "lng2")), strict=True):
                start = None if None in ends else graph.start(*ends[:2], reach_m)
                if start is not None:
                    asked.setdefault(start, []).append((route, tuple(ends[2:])))
            alone = sum(len(some) for some in asked.values() if len(some) < SEARCH_FROM)
            landmarks = search.Landmarks(graph.out) if alone >= LANDMARKS_FROM else None
            sizes = len(graph.nodes), len(graph.edges)
            for start, some in asked.items():
                for (route, _), path in zip(some, graph.paths(start, [end for _, end in some], reach_m, landmarks), strict=True):
                    found = [] if path is None else [graph.edges[pair] for pair in zip(path, path[1:], strict=False)] or [None]
                    routes += [route] * len(found)
                    steps += range(len(found))
                    nodes += path[: len(found)] if path else ()
                    taken += found
        of = edges.select([c for c in EDGE if c != "src"]).take(pa.array(taken, pa.int64()))
        out = {"route": pa.array(routes, pa.int64()), "idx": pa.array(steps, pa.int32()), "src": pa.array(nodes, pa.int64())}
        out |= {c: of.column(c) for c in of.column_names}
        return pa.table(out | {n: pa.array([k] * len(routes), pa.int64()) for n, k in zip(("graph_nodes", "graph_edges"), sizes, strict=True)})

    return own.groupBy("corridor", "share").cogroup(dealt.groupBy("corridor", "share")).applyInArrow(run, PATH)


def client_routes(
    asked: DataFrame, ways: DataFrame, modes: DataFrame, preferred: Column, pad: float = 0.05, t: streets.Tags = streets.flat,
    adjust: Callable[[DataFrame], DataFrame] | None = None, elevation: tuple[Column, Column] | None = None, lifted: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Whole requests ``asked(route, mode, lat1, lng1, lat2, lng2)``, with ``avoid`` (ids of ways) where there is such a column: totals and segments.

    Totals, a row a request: found, km, seconds, walking_km, shares (preferred, other, walking, and preferred by level), number of
    segments, nodes and edges of the graph; nulls if there is no path. Segments: route, seg, item, is_walking, path_level,
    n_coords, metres, way_ids, healed. The first point of a path has no edge and so no item: it is a segment of its own unless
    the first edge has no item either. Levels are the legend's by item; walked segments have none.

    ``adjust`` changes classified ways before modes decide on them (a region's rules, a rider's preference); ``elevation``
    are Columns of ``ways`` for the metres at a way's ends, null where unknown, or of what ``lifted`` makes of those ways that lie
    in the tiles of requests; no others are lifted or classified. ``preferred`` says whether ``item`` is one that the mode
    prefers. How requests share graphs: see ``shared_paths``. Rows with null coordinates are not found.
    """
    asked = asked.checkpoint()  # read several times
    ways = near(ways, tiles_of(asked, pad).checkpoint()).checkpoint()
    if lifted:
        ways = lifted(ways).checkpoint()
    classed = graph.with_class(ways, t)
    if adjust:
        classed = adjust(classed)
    every = graph.edges(graph.decided(classed, modes), preferred, elevation, t=t, keep=("item",)).select("mode", *EDGE, "ord")
    every = in_corridors(every, asked, pad).checkpoint()
    last = F.max_by(F.struct(*EDGE[2:]), "ord").alias("e")
    links = every.groupBy("mode", "src", "dst").agg(last).select("mode", "src", "dst", "e.*").checkpoint()
    avoid = F.col("avoid").cast("array<bigint>") if "avoid" in asked.columns else F.lit(None).cast("array<bigint>")
    asked = asked.select("route", "mode", "lat1", "lng1", "lat2", "lng2", avoid.alias("avoid"))
    path = shared_paths(asked, links, every, pad).checkpoint()
    at = lambda node: ((F.floor(F.col(node) / 100_000_000) / 1e5 - 90).alias("lat"), (F.pmod(F.col(node), F.lit(100_000_000).cast("long")) / 1e5 - 180).alias("lng"))
    points = path.where("dst IS NOT NULL").select("route", (F.col("idx") + 1).alias("idx"), *at("dst"), "item", "is_walking", "way_id")
    first = path.where("idx = 0").select("route", "idx", *at("src"), F.lit(None).cast("string").alias("item"), F.lit(False).alias("is_walking"), F.lit(None).cast("long").alias("way_id"))
    parts = segments.segments(points.unionByName(first))
    parts = segments.healed(parts.withColumn("path_level", F.create_map(*(F.lit(x) for pair in dims.ITEMS.items() for x in pair))[F.col("item")]), preferred)
    rated = segments.quality(parts, preferred, by_level=True).join(parts.groupBy("route").agg(F.count("*").alias("segments")), "route")
    walked = F.sum(F.when(F.col("is_walking"), F.col("dist")).otherwise(0.0))
    sums = {"km": F.sum("dist") / 1000, "seconds": F.sum("cost"), "walking_km": walked / 1000}
    totals = path.groupBy("route").agg(*(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()), F.first("graph_nodes").alias("graph_nodes"), F.first("graph_edges").alias("graph_edges"))
    return asked.select("route").join(totals.join(rated, "route"), "route", "left").withColumn("found", F.col("km").isNotNull()), parts


def trips(legs: DataFrame, ways: DataFrame, modes: DataFrame, preferred: Column, **options) -> DataFrame:
    """Trips over waypoints: ``legs(route, leg, mode, lat1, lng1, lat2, lng2)``, each a request of its own; found, number of legs, km, seconds, walking_km and segments.

    A trip with a leg that isn't found has nulls. Its segments are its legs', one after another. ``options`` are those of ``client_routes``.
    """
    numbered = legs.withColumn("_request", F.xxhash64("route", "leg")).checkpoint()
    totals, _ = client_routes(numbered.withColumn("route", F.col("_request")), ways, modes, preferred, **options)
    joined = numbered.select(F.col("route").alias("_trip"), F.col("_request").alias("route")).join(totals, "route")
    every = F.bool_and("found")
    sums = [F.when(every, F.sum(c)).alias(c) for c in ("km", "seconds", "walking_km", "segments")]
    return joined.groupBy(F.col("_trip").alias("route")).agg(every.alias("found"), F.count("*").alias("legs"), *sums)
