"""Further registered queries: diagnostics of routes, filters and orders, small scalars, settings, caches and benchmark tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets
from lanecraft.functions import text as T
from lanecraft.operators import graph, lookup, overlay, route, segments, spatial, tables
from lanecraft.sources import dims, reports, store, terrain
from lanecraft.sources import ways as src
from lanecraft.sources.tables import table
from lanecraft.streaming import navigation

from . import oracle as O
from .catalog import _CACHE, _NOW, _PLACES, ENGINES, MODE, RIVALS, all_edges, all_last_edges, cache, classed, liked, places, pings, query, samples

# --- Modes, items and settings ---

_ASKED = ["training", "unknown-mode", None, "carrying-kid"]


@query(f"WITH r AS (SELECT o_orderkey AS id, {O.array(_ASKED)}[CAST(o_orderkey % 4 AS INT) + 1] AS asked FROM orders), {O.modes()} SELECT id, coalesce(m.mode, '{dims.DEFAULT_MODE}') AS mode, coalesce(m.ride_kmh, d.ride_kmh)::DOUBLE AS kmh FROM r LEFT JOIN modes m ON m.mode = r.asked, (SELECT ride_kmh FROM modes WHERE mode = '{dims.DEFAULT_MODE}') d")
def mode_fallback(spark, sf):
    """Requests with the rule of their mode; an unknown mode has the default's."""
    asked = F.element_at(F.array(*(F.lit(m).cast("string") for m in _ASKED)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("asked"))
    return dims.with_rule(rows, "asked", dims.modes(spark)).select("id", "mode", F.col("ride_kmh").alias("kmh"))


@query("WITH m AS (SELECT * FROM (VALUES ('kid-starting-out'), ('kid-confident'), ('kid-traffic-savvy'), ('carrying-kid'), ('training')) t(mode)), u AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS opted, CASE WHEN c_custkey % 5 = 0 THEN 'training' ELSE 'carrying-kid' END AS selected FROM customer) SELECT id, mode FROM u, m WHERE mode <> 'training' OR opted OR selected = mode")
def mode_visible(spark, sf):
    """Modes that a user sees: training only if they opted in or selected it."""
    k = F.col("c_custkey")
    users = table(spark, sf, "customer").select(k.alias("id"), (k % 3 == 0).alias("opted"), F.when(k % 5 == 0, "training").otherwise("carrying-kid").alias("selected"))
    return users.join(F.broadcast(dims.modes(spark).select("mode"))).where(dims.visible(F.col("mode"), F.col("opted"), F.col("selected"))).select("id", "mode")


_ENGINE_KEYS = ["maplibre", "google", "mapbox", None]


@query(f"WITH c AS (SELECT c_custkey AS id, {O.array(_ENGINE_KEYS)}[CAST(c_custkey % 4 AS INT) + 1] AS engine, c_custkey % 3 = 0 AS has_key FROM customer) SELECT id, CASE WHEN engine = 'maplibre' OR (engine = 'google' AND has_key) THEN engine ELSE 'maplibre' END AS engine, CASE WHEN engine IS NULL OR engine = 'maplibre' OR (engine = 'google' AND has_key) THEN NULL WHEN engine = 'google' THEN 'no-key' ELSE 'unknown' END AS reason FROM c")
def engine_fallback(spark, sf):
    """The map engine that is used for the one that is set, and why if it is another."""
    k = F.col("c_custkey")
    engine = F.element_at(F.array(*(F.lit(e).cast("string") for e in _ENGINE_KEYS)), (k % 4 + 1).cast("int"))
    used, reason = dims.resolved(engine, k % 3 == 0, needs_key=["google"], known=["maplibre", "google"], fallback="maplibre")
    return table(spark, sf, "customer").select(k.alias("id"), used.alias("engine"), reason.alias("reason"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 7.5 ELSE 5.0 END::DOUBLE AS rough, CASE WHEN s_suppkey % 3 = 0 THEN 18.0 ELSE 16.0 END::DOUBLE AS ride, 10.0::DOUBLE AS slow FROM supplier")
def settings_merged(spark, sf):
    """Settings of users over the defaults, which hold where a setting is missing."""
    k = F.col("s_suppkey")
    defaults = F.create_map(*(F.lit(x) for x in ("rough", 5.0, "ride", 16.0, "slow", 10.0)))
    own = F.map_filter(F.create_map(F.lit("rough"), F.when(k % 2 == 0, 7.5), F.lit("ride"), F.when(k % 3 == 0, 18.0)), lambda _, v: v.isNotNull())
    merged = table(spark, sf, "supplier").select(k.alias("id"), dims.merged(defaults, own).alias("m"))
    return merged.select("id", *(F.col("m")[c].alias(c) for c in ("rough", "ride", "slow")))


@query(
    f"""WITH {O.modes()}, s AS (SELECT s_suppkey AS id, ['kid-confident', 'training', 'own mode'][CAST(s_suppkey % 3 AS INT) + 1] AS named, s_suppkey % 10 + 1.5::DOUBLE AS ride FROM supplier),
    d AS (SELECT mode, unnest(['ride', 'walk']) AS setting, unnest([ride_kmh::DOUBLE, walk_kmh::DOUBLE]) AS value FROM modes)
    SELECT id, mode, setting, CASE WHEN mode = named AND setting = 'ride' THEN ride ELSE value END AS value FROM s, d
    UNION ALL SELECT id, named, 'ride', ride FROM s WHERE named = 'own mode' UNION ALL SELECT id, named, 'extra', 1.0 FROM s WHERE id % 2 = 0"""
)
def settings_by_mode(spark, sf):
    """Settings of users by mode over the modes' own: one speed of one mode, which may be theirs alone, and for some a setting that no mode has."""
    k = F.col("s_suppkey")
    defaults = F.create_map(*(x for m in dims.MODES for x in (F.lit(m[0]), F.create_map(F.lit("ride"), F.lit(m[5]), F.lit("walk"), F.lit(m[7])))))
    named = F.element_at(F.array(*map(F.lit, ("kid-confident", "training", "own mode"))), (k % 3 + 1).cast("int"))
    ride = F.map_filter(F.create_map(F.lit("ride"), k % 10 + 1.5, F.lit("extra"), F.when(k % 2 == 0, 1.0)), lambda _, v: v.isNotNull())
    rows = table(spark, sf, "supplier").select(k.alias("id"), dims.merged_by_mode(defaults, F.create_map(named, ride)).alias("m"))
    return rows.select("id", F.explode("m").alias("mode", "s")).select("id", "mode", F.explode("s").alias("setting", "value"))


@query(f"WITH {O.CLS} SELECT item, path_level, {O.GOOD} AS preferred, CASE WHEN {O.GOOD} THEN path_level ELSE 'other' END IS NOT DISTINCT FROM CASE WHEN {O.GOOD} THEN {O.cases('item', dims.ITEMS)} ELSE 'other' END AS agree, count(*) AS ways FROM cls GROUP BY ALL")
def painter_parity(spark, sf):
    """Whether the map paints ways by the level that the bar counts them under; if not, one of both is wrong."""
    rows = classed(spark, sf).groupBy("item", "path_level").agg(F.count("*").alias("ways"))
    level = F.create_map(*(F.lit(x) for kv in dims.ITEMS.items() for x in kv))[F.coalesce("item", F.lit(""))]
    painted, barred = (F.when(liked(), c).otherwise("other") for c in (F.col("path_level"), level))
    return rows.select("item", "path_level", liked().alias("preferred"), painted.eqNullSafe(barred).alias("agree"), "ways")


# --- Tiles, boxes and guards ---


@query(f"WITH {O.WAYS} SELECT DISTINCT CAST(floor(lat / 0.1::DOUBLE) AS INT) AS tile_row, CAST(floor(lng / 0.1::DOUBLE) AS INT) AS tile_col, round(floor(lat / 0.1::DOUBLE) * 0.1, 6) AS south, round(floor(lng / 0.1::DOUBLE) * 0.1, 6) AS west, round((floor(lat / 0.1::DOUBLE) + 1) * 0.1, 6) AS north, round((floor(lng / 0.1::DOUBLE) + 1) * 0.1, 6) AS east FROM pts")
def tile_boxes(spark, sf):
    """The tiles of all vertices with their boxes."""
    tiles = src.way_points(src.ways(spark, sf)).select(geo.tile(F.col("lat")).alias("tile_row"), geo.tile(F.col("lng")).alias("tile_col")).distinct()
    return tiles.select("tile_row", "tile_col", *(F.round(c, 6).alias(n) for n, c in geo.tile_box(F.col("tile_row"), F.col("tile_col")).items()))


@query(
    f"""WITH {O.PINGS}, b AS (SELECT route, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM pings GROUP BY route),
    p AS (SELECT route, s - (n - s) * 0.3 AS s, n + (n - s) * 0.3 AS n, w - (e - w) * 0.3 AS w, e + (e - w) * 0.3 AS e FROM b)
    SELECT route, round(s, 6) AS south, round(w, 6) AS west, round(n, 6) AS north, round(e, 6) AS east, n - s <= 0.15 AND e - w <= 0.2 AS scanned,
        (floor(n / 0.1::DOUBLE) - floor(s / 0.1::DOUBLE) + 1) * (floor(e / 0.1::DOUBLE) - floor(w / 0.1::DOUBLE) + 1) <= 30 AS tiled FROM p"""
)
def route_boxes(spark, sf):
    """Each route's box, padded by 30 %, and whether it is small enough to be scanned as one view, and by tiles."""
    box = pings(spark, sf).groupBy("route").agg(*geo.padded_box(F.col("lat"), F.col("lng"), 0.3))
    return box.select("route", *(F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")), geo.scannable().alias("scanned"), geo.tileable().alias("tiled"))


@query("SELECT user_id % 50 AS tile, bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') AS failed, count(*) FILTER (event_type = 'view') AS loading FROM events GROUP BY 1")
def tile_status(spark, sf):
    """What a group of tiles shows: an error only if any failed and none has data."""
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("tile")).agg((F.bool_or(kind == "error") & ~F.bool_or(kind == "purchase")).alias("failed"), F.count_if(kind == "view").alias("loading"))


# --- Routes: runs, ways and manoeuvres ---

_STEPS = f"""WITH {O.PINGS}, e AS (SELECT route, idx, event_id // 4 % 7 AS way_id, is_walking, {O.haversine('lat', 'lng', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS dist FROM pings WINDOW w AS (PARTITION BY route ORDER BY idx)),
    steps AS (SELECT *, dist / (CASE WHEN is_walking THEN 1 ELSE 5 END) AS cost FROM e WHERE dist IS NOT NULL)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of each route in order: route, idx, way_id, dist, cost, is_walking."""
    w = W.partitionBy("route").orderBy("idx")
    rows = pings(spark, sf).withColumn("dist", geo.haversine(F.col("lat"), F.col("lng"), F.lead("lat").over(w), F.lead("lng").over(w)))
    return rows.where("dist IS NOT NULL").select("route", "idx", F.expr("event_id div 4 % 7").alias("way_id"), "dist", (F.col("dist") / F.when(F.col("is_walking"), 1).otherwise(5)).alias("cost"), "is_walking")


@query(_STEPS + " SELECT route, way_id, count(*) AS edges, round(sum(dist), 2) AS metres, round(sum(cost), 2) AS seconds, bool_or(is_walking) AS walked, round(sum(dist) / sum(cost) * 3.6, 4) AS kmh, row_number() OVER (PARTITION BY route ORDER BY min(idx)) AS place FROM steps GROUP BY route, way_id")
def path_ways(spark, sf):
    """What each way of a path adds up to, in the order in which the path meets them."""
    return route.ways_on_path(steps(spark, sf)).select("route", "way_id", "edges", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"), "walked", F.round("kmh", 4).alias("kmh"), "place")


@query(_STEPS + ", f AS (SELECT *, CASE WHEN idx = 0 OR way_id = lag(way_id) OVER (PARTITION BY route ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM steps), n AS (SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY idx) AS run FROM f) SELECT route, CAST(run AS BIGINT) AS run, any_value(way_id) AS way_id, count(*) AS edges, round(sum(dist), 2) AS metres, round(sum(cost), 2) AS seconds FROM n GROUP BY route, run")
def way_runs(spark, sf):
    """A path as runs of edges of one way."""
    return route.way_runs(steps(spark, sf)).select("route", "run", "way_id", "edges", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"))


_NODE = "CAST(floor({a} * 100000 + 0.5) AS BIGINT) AS ilat, CAST(floor({o} * 100000 + 0.5) AS BIGINT) AS ilng"


@query(f"WITH {O.WAYS}, {O.SEGMENTS}, v AS (SELECT DISTINCT ilat, ilng, way_id FROM pts), p AS (SELECT route, seg, {_NODE.format(a='lat', o='lng')} FROM num) SELECT route, CAST(seg AS BIGINT) AS seg, count(DISTINCT way_id) AS ways, min(way_id) AS first_way FROM p JOIN v USING (ilat, ilng) GROUP BY route, seg")
def segment_ways(spark, sf):
    """How many ways have a vertex at a point of a segment, and the smallest of them."""
    w = W.partitionBy("route").orderBy("idx")
    keyed = pings(spark, sf).withColumn("kind", F.when(F.col("is_walking"), "#walk").otherwise(F.col("item")))
    points = segments.islands(keyed, "route", "idx", F.col("kind").eqNullSafe(F.lag("kind").over(w)))
    found = route.ways_at(points, src.way_points(src.ways(spark, sf)))
    return found.groupBy("route", "seg").agg(F.countDistinct("way_id").alias("ways"), F.min("way_id").alias("first_way"))


@query(f"WITH {O.edges()}, x AS (SELECT DISTINCT way_id FROM edges WHERE mode = '{MODE}') SELECT p_partkey AS way_id, x.way_id IS NOT NULL AS routable FROM part LEFT JOIN x ON x.way_id = p_partkey WHERE p_partkey % 3 = 0")
def expected_ways(spark, sf):
    """Whether ways that a path should take are in the graph of the mode at all."""
    expected = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("way_id"))
    return route.in_graph(expected, all_edges(spark, sf).where(F.col("mode") == MODE))


@query(f"WITH {O.PINGS}, n AS (SELECT route, count(*) AS n FROM pings GROUP BY route) SELECT route, idx, event_id FROM pings JOIN n USING (route) WHERE idx % greatest(1, (n + 149) // 150) = 0 OR idx = n - 1")
def strided(spark, sf):
    """At most about 150 points of a route: every k-th and the last."""
    return route.strided(pings(spark, sf), 150).select("route", "idx", "event_id")


@query(f"WITH {O.PINGS}, m AS (SELECT user_id AS route, event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 END AS begin_idx FROM events) SELECT m.id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM m LEFT JOIN pings p ON p.route = m.route AND p.idx = coalesce(begin_idx, 0)")
def manoeuvre_points(spark, sf):
    """Where manoeuvres are: the point of their route at which their shape begins, the first if that isn't said."""
    e = F.col("event_id")
    asked = table(spark, sf, "events").select(F.col("user_id").alias("route"), e.alias("id"), F.when(e % 11 != 0, e % 5).alias("begin_idx"))
    return route.manoeuvre_points(asked, pings(spark, sf)).select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    f"""WITH {O.PINGS}, q AS (SELECT route, event_id, lat + 0.0003::DOUBLE * (event_id % 4) AS lat, lng FROM pings), m AS (SELECT q.route, q.event_id, p.idx, {O.haversine('q.lat', 'q.lng', 'p.lat', 'p.lng')} AS d FROM q JOIN pings p ON p.route = q.route AND abs(p.lat - q.lat) < 0.001 AND p.idx % 3 = 0),
    b AS (SELECT route, event_id, idx, row_number() OVER (PARTITION BY route, event_id ORDER BY round(d, 6), idx) AS nth FROM m WHERE d <= 100) SELECT q.route AS trip, q.event_id, b.idx AS point FROM q LEFT JOIN b ON b.route = q.route AND b.event_id = q.event_id AND nth = 1"""
)
def position_on_route(spark, sf):
    """The nearest point of their route for all positions, if it is within 100 m."""
    points = pings(spark, sf).withColumnRenamed("route", "trip")
    asked = points.select("trip", "event_id", (F.col("lat") + 0.0003 * (F.col("event_id") % 4)).alias("lat"), "lng")
    return navigation.on_route(asked, points.where("idx % 3 = 0").select("trip", "idx", "lat", "lng"))


@query("WITH l AS (SELECT o_custkey AS trip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS leg, CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS km FROM orders) SELECT trip, bool_and(km IS NOT NULL) AS found, round(CASE WHEN bool_and(km IS NOT NULL) THEN sum(km) END, 2) AS km FROM l GROUP BY trip")
def legs_found(spark, sf):
    """Trips over several legs: one leg without a route leaves the trip without one."""
    legs = table(spark, sf, "orders").select(F.col("o_custkey").alias("trip"), F.when(F.col("o_orderkey") % 20 != 0, F.col("o_totalprice")).alias("km"))
    found = F.bool_and(F.col("km").isNotNull())
    return legs.groupBy("trip").agg(found.alias("found"), F.round(F.when(found, F.sum("km")), 2).alias("km"))


@query(
    f"""WITH RECURSIVE {O.edges()}, l AS (SELECT mode, src, dst, e.cost AS cost, CAST(floor((src / 100000000.0::DOUBLE - 9000000 - {O.LAT0}) / {O.LAT_STEP * 40}) AS BIGINT) AS region FROM last_edges),
    a AS (SELECT mode, region AS pair, min(src) AS src, max(src) AS dst FROM l GROUP BY ALL),
    d(mode, pair, node, cost) USING KEY (mode, pair, node) AS (
        SELECT mode, pair, src, 0.0::DOUBLE FROM a
        UNION
        SELECT d.mode, d.pair, l.dst, min(d.cost + l.cost) FROM d JOIN l ON l.mode = d.mode AND l.region = d.pair AND l.src = d.node
            LEFT JOIN recurring.d r ON r.mode = d.mode AND r.pair = d.pair AND r.node = l.dst WHERE r.cost IS NULL OR d.cost + l.cost < r.cost - 1e-9 GROUP BY ALL)
    SELECT a.mode, a.pair, round(d.cost, 3) AS seconds FROM a JOIN d ON d.mode = a.mode AND d.pair = a.pair AND d.node = a.dst"""
)
def path_costs(spark, sf):
    """Seconds of the cheapest path from the first to the last node of each district, by mode."""
    from .catalog import _asked

    links, pairs = _asked(spark, sf)
    return overlay.routes(overlay.build(links), pairs).groupBy("mode", "pair").agg(F.round(F.max("cost"), 3).alias("seconds"))


@query(
    f"""WITH RECURSIVE {O.edges()}, l AS (SELECT mode, src, dst, e.cost AS cost, CAST(floor((src / 100000000.0::DOUBLE - 9000000 - {O.LAT0}) / {O.LAT_STEP * 8}) AS BIGINT) AS band FROM last_edges),
    ends AS (SELECT mode, band, min(src) AS first, max(src) AS last, lead(band) OVER w AS next, lead(min(src)) OVER w AS next_first, lead(max(src)) OVER w AS next_last FROM l GROUP BY mode, band WINDOW w AS (PARTITION BY mode ORDER BY band)),
    g AS (SELECT mode, src, dst, cost FROM l UNION ALL SELECT mode, last, next_first, 300.0 FROM ends WHERE next > band + 1),
    a AS (SELECT mode, band AS pair, first AS src, next_last AS dst FROM ends WHERE next IS NOT NULL),
    d(mode, pair, node, cost) USING KEY (mode, pair, node) AS (
        SELECT mode, pair, src, 0.0::DOUBLE FROM a
        UNION
        SELECT d.mode, d.pair, g.dst, min(d.cost + g.cost) FROM d JOIN g ON g.mode = d.mode AND g.src = d.node
            LEFT JOIN recurring.d r ON r.mode = d.mode AND r.pair = d.pair AND r.node = g.dst WHERE r.cost IS NULL OR d.cost + g.cost < r.cost - 1e-9 GROUP BY ALL)
    SELECT a.mode, a.pair, round(d.cost, 3) AS seconds FROM a LEFT JOIN d ON d.mode = a.mode AND d.pair = a.pair AND d.node = a.dst"""
)
def crossing_paths(spark, sf):
    """Seconds from the first node of each band of eight lines to the last node of the next band; null where no path leads.

    Between districts, which no street joins, a ferry goes from the last node of the one to the first of the other.
    """
    links = all_last_edges(spark, sf).select("mode", "src", "dst", "cost").checkpoint()
    band = F.floor((F.col("src") / 100_000_000 - 9_000_000 - src.LAT0) / (src.LAT_STEP * 8)).cast("long")
    w = W.partitionBy("mode").orderBy("band")
    ends = links.groupBy("mode", band.alias("band")).agg(F.min("src").alias("first"), F.max("src").alias("last"))
    ends = ends.withColumns({"next": F.lead("band").over(w), "next_first": F.lead("first").over(w), "next_last": F.lead("last").over(w)}).where("next IS NOT NULL").checkpoint()
    ferries = ends.where("next > band + 1").select("mode", F.col("last").alias("src"), F.col("next_first").alias("dst"), F.lit(300.0).alias("cost"))
    pairs = ends.select("mode", F.col("band").alias("pair"), F.col("first").alias("src"), F.col("next_last").alias("dst"))
    found = overlay.routes(overlay.build(links.unionByName(ferries)), pairs)
    return pairs.select("mode", "pair").join(found.groupBy("mode", "pair").agg(F.round(F.max("cost"), 3).alias("seconds")), ["mode", "pair"], "left")


#: Ways that every seventh rider avoids.
_AVOIDED = 5


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """From the first to the last ping of each user; every seventh avoids some ways."""
    ends = pings(spark, sf).groupBy("route").agg(F.min_by(F.struct("lat", "lng"), "idx").alias("a"), F.max_by(F.struct("lat", "lng"), "idx").alias("b"))
    avoid = F.when(F.col("route") % 7 == 0, F.transform(F.sequence(F.lit(1), F.lit(_AVOIDED)), lambda k: (k * 58).cast("long")))
    return ends.select("route", F.lit(MODE).alias("mode"), F.col("a.lat").alias("lat1"), F.col("a.lng").alias("lng1"), F.col("b.lat").alias("lat2"), F.col("b.lng").alias("lng2"), avoid.alias("avoid"))


def regional(classed: DataFrame) -> DataFrame:
    """Ways after a region's rules, for riders who don't mind setts."""
    mid = geo.midpoint(F.col("coords"))
    cls = {c: F.col(c) for c in ("lts", "car_free", "bike_priority", "bike_infra", "surface_", "path_level", "speed_kmh")}
    out = streets.overlaid(cls, F.col("name"), streets.flat, mid["lat"], mid["lng"], dims.BERLIN)
    out["surface_"] = streets.tolerant(out["surface_"], ["sett"])
    return classed.withColumns(out)


def hills(ways: DataFrame) -> DataFrame:
    """Elevation tiles of where the ways are, as pictures made by rule: a pixel's height goes by its place."""
    tiles = terrain.tiles_of(src.way_points(ways))

    def run(batches):
        line, column = np.mgrid[: terrain.SIZE, : terrain.SIZE]
        for batch in batches:
            pictures = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                steps = 100_000 + np.fmod(line * 37 + column * 91 + x * 5 + y * 3, 400)  # tenths of a metre above -10,000 m, signs as in SQL
                pictures.append(terrain.picture(np.stack([steps >> 16, steps >> 8 & 255, steps & 255], axis=2)))
            yield pa.RecordBatch.from_arrays([pa.array([terrain.ZOOM] * len(pictures), pa.int32()), batch.column(0), batch.column(1), pa.array(pictures, pa.binary())], names=["z", "x", "y", "png"])

    return tiles.mapInArrow(run, "z int, x int, y int, png binary")


_MERCATOR = """v AS (SELECT DISTINCT lat, lng, (lng + 180.0) / 360.0 * 4096.0 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793::DOUBLE) / 2 * 4096.0 AS fy FROM pts),
    px AS (SELECT lat, lng, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, floor((fx - floor(fx)) * 256)::BIGINT AS i, floor((fy - floor(fy)) * 256)::BIGINT AS j FROM v)"""


@query(f"WITH {O.WAYS}, {_MERCATOR} SELECT round(lat, 5) AS lat, round(lng, 5) AS lng, round(-10000.0::DOUBLE + (100000 + (j * 37 + i * 91 + x * 5 + y * 3) % 400) * 0.1::DOUBLE, 3) AS metres FROM px")
def elevation_lookup(spark, sf):
    """Heights of all vertices, from pictures."""
    ways = src.ways(spark, sf)
    found = terrain.heights(src.way_points(ways), hills(ways))
    return found.select(F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.round("metres", 3).alias("metres"))


def _client_routes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lifted = lambda ways: terrain.with_ends(ways, hills(ways))
    return route.client_routes(requests(spark, sf), src.ways(spark, sf), dims.modes(spark), liked(), adjust=regional, elevation=(F.col("metres1"), F.col("metres2")), lifted=lifted)


@query()
def client_route(spark, sf):
    """Whole requests: tiles, region's rules, rider's preference, heights, avoided ways, graph, snapping, path, segments, healing, totals."""
    found, _ = _client_routes(spark, sf)
    numbers = ("km", "seconds", "walking_km", "preferred", "other", "walking")
    return found.select("route", "found", *(F.round(c, 3).alias(c) for c in numbers), F.round(F.col("by_level")["1a"], 3).alias("level_1a"), "segments", "graph_nodes", "graph_edges")


@query()
def client_segments(spark, sf):
    """The segments of those requests with the ways that they go along."""
    _, parts = _client_routes(spark, sf)
    return parts.select("route", "seg", "item", "is_walking", "path_level", "n_coords", F.round("metres", 2).alias("metres"), "healed", F.size("way_ids").alias("ways"), F.array_min("way_ids").alias("first_way"))


@query()
def waypoint_trips(spark, sf):
    """Trips over each user's first, middle and last ping: their legs are requests, which share graphs; a leg without a path leaves the trip without one."""
    w = W.partitionBy("route").orderBy("idx")
    n = F.count("*").over(W.partitionBy("route"))
    stops = pings(spark, sf).withColumn("n", n).where("idx = 0 OR idx = n div 2 OR idx = n - 1")
    stops = stops.withColumns({"leg": F.row_number().over(w) - 1, "lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).where("lat2 IS NOT NULL")
    legs = stops.select("route", "leg", F.lit(MODE).alias("mode"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "lat2", "lng2")
    found = route.trips(legs, src.ways(spark, sf), dims.modes(spark), liked())
    return found.select("route", "found", "legs", *(F.round(c, 3).alias(c) for c in ("km", "seconds", "walking_km")), "segments")


@query(f"WITH {O.HEALED}, s AS (SELECT route, metres, is_walking, {O.cases('item', dims.ITEMS)} AS level, {O.GOOD} AS good FROM healed), t AS (SELECT route, sum(metres) AS total FROM s GROUP BY route HAVING sum(metres) > 0) SELECT route, level, round(sum(metres) / any_value(total), 6) AS share FROM s JOIN t USING (route) WHERE good AND NOT is_walking GROUP BY route, level HAVING sum(metres) > 0")
def quality_by_level(spark, sf):
    """What share of each trip is preferred, by the legend's level."""
    level = F.create_map(*(F.lit(x) for pair in dims.ITEMS.items() for x in pair))[F.col("item")]
    parts = segments.healed(segments.segments(pings(spark, sf)), liked()).withColumn("path_level", level)
    return segments.quality(parts, liked(), by_level=True).select("route", F.explode("by_level").alias("level", "share")).withColumn("share", F.round("share", 6))


# --- Audits and lists ---

_STATUS = "CASE WHEN item IS NULL THEN 'unclassified' WHEN path_level = '3' THEN 'other' ELSE 'preferred' END"


@query(f"WITH {O.CLS}, g AS (SELECT {O.SIGNATURE} AS signature, item, {_STATUS} AS status, count(*) AS ways FROM cls GROUP BY ALL) SELECT signature, item, status, ways FROM g WHERE status IN ('preferred', 'unclassified') AND contains(lower(concat_ws(' ', signature, item)), 'track')")
def audit_filter(spark, sf):
    """Audit groups of two statuses that a text is found in."""
    status = F.when(F.col("item").isNull(), "unclassified").when(F.col("path_level") == "3", "other").otherwise("preferred")
    groups = classed(spark, sf).groupBy(streets.signature(streets.flat).alias("signature"), "item", status.alias("status")).agg(F.count("*").alias("ways"))
    # An audit is kept and looked at again and again; filters on it shan't be pushed into the classification.
    return tables.filtered_audit(groups.checkpoint(), ["preferred", "unclassified"], " Track ")


@query(f"WITH {O.CLS}, {O.LEGS}, g AS (SELECT item, round(sum(metres) / 1000, 3) AS km, count(*) AS ways FROM cls JOIN lengths USING (way_id) GROUP BY ALL) SELECT item, row_number() OVER (ORDER BY km DESC, item NULLS LAST) AS by_km, row_number() OVER (ORDER BY ways DESC, item NULLS LAST) AS by_ways FROM g")
def group_order(spark, sf):
    """Groups with their place by kilometres and by number of ways; there are as many as legend items."""
    rows = classed(spark, sf).groupBy("item").agg(F.round(F.sum(geo.length(F.col("coords"))) / 1000, 3).alias("km"), F.count("*").alias("ways"))
    place = lambda c: F.row_number().over(W.orderBy(F.desc(c), F.asc_nulls_last("item")))
    return rows.select("item", place("km").alias("by_km"), place("ways").alias("by_ways"))


@query("SELECT c_mktsegment AS city, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':7'), c_custkey) AS place FROM customer")
def shuffled(spark, sf):
    """Candidates of a city in an order drawn by a seed, so that it is the same again."""
    draw = F.md5(F.concat_ws(":", "c_custkey", F.lit("7")).cast("binary"))
    place = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(draw, "c_custkey"))
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("city"), F.col("c_custkey").alias("id"), place.alias("place"))


@query(f"WITH {O.WIDE} SELECT city, mode, pair, row_number() OVER (PARTITION BY city ORDER BY mode, pair) AS place FROM wide WHERE city = 'berlin' AND mode IN ('m0', 'm2') AND client_km > 1.2::DOUBLE * least(valhalla_km, brouter_km, google_km)")
def index_filter(spark, sf):
    """Samples of the index page by city, mode and flag, in its order."""
    wide = tables.compared(samples(spark, sf), ENGINES)
    some = wide.where((F.col("city") == "berlin") & F.col("mode").isin("m0", "m2") & (F.col("client_km") > 1.2 * tables.shortest_rival(RIVALS)))
    return some.select("city", "mode", "pair", F.row_number().over(W.partitionBy("city").orderBy("mode", "pair")).alias("place"))


@query(f"WITH {_PLACES}, q AS (SELECT n_nationkey AS id, lower(right('0000' || n_nationkey, 3)) AS q FROM nation), h AS (SELECT q.id, 0 AS kind, p.id AS hit FROM q JOIN places p ON contains(lower(p.name), q.q) WHERE p.id % 4 = 0 UNION ALL SELECT q.id, 1, s_suppkey FROM q JOIN supplier ON s_nationkey = q.id) SELECT id, CASE kind WHEN 0 THEN 'saved' ELSE 'other' END AS source, hit, row_number() OVER (PARTITION BY id ORDER BY kind, hit) AS place FROM h")
def saved_first(spark, sf):
    """Hits of a search in the order they are shown: saved places first, found by an index of their names' parts."""
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.right(F.concat(F.lit("0000"), F.col("n_nationkey").cast("string")), F.lit(3)).alias("q"))
    saved = places(spark, sf).where("id % 4 = 0").select(F.col("id").alias("hit"), "name")
    found = lookup.containing(asked.select(F.col("id").alias("query"), F.col("q").alias("text")), saved, lookup.postings(saved, "hit", "name"), "hit", "name")
    near = found.select(F.col("query").alias("id"), F.lit(0).alias("kind"), "hit")
    rest = asked.join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("id")).select("id", F.lit(1).alias("kind"), F.col("s_suppkey").alias("hit"))
    place = F.row_number().over(W.partitionBy("id").orderBy("kind", "hit"))
    return near.unionByName(rest).select("id", F.when(F.col("kind") == 0, "saved").otherwise("other").alias("source"), "hit", place.alias("place"))


# --- Scalars ---


@query(
    """SELECT c_custkey AS id, regexp_matches(c_name, '[0-9]') AS address, regexp_replace('Turn left onto ' || c_name || ' Street', ' onto .+$', '') AS instruction,
        'https://x.example/v?at=' || printf('%.6f', c_acctbal) || '%2C13.000000' || CASE WHEN c_custkey % 3 = 0 THEN '&h=90' ELSE '' END AS address_of,
        right('000' || c_custkey::VARCHAR, 3) || '-' || lower(c_mktsegment) || '.html' AS file,
        CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'Road ' || c_custkey ELSE 'First' END AS short FROM customer"""
)
def scalars(spark, sf):
    """Address test, shortened instruction, address with a query, file name and short label."""
    k = F.col("c_custkey")
    link = T.query_string("https://x.example/v", at=F.concat(T.fixed(F.col("c_acctbal")), F.lit(","), T.fixed(F.lit(13.0))), h=F.when(k % 3 == 0, "90"))
    short = T.place_name(F.when(k % 2 == 0, F.col("c_name")), F.when(k % 3 == 0, "Road"), k.cast("string"), F.lit("First, Second"))
    return table(spark, sf, "customer").select(
        k.alias("id"), T.looks_like_address(F.col("c_name")).alias("address"), T.shortened(F.concat(F.lit("Turn left onto "), "c_name", F.lit(" Street"))).alias("instruction"),
        link.alias("address_of"), T.sample_file(k % 1000, F.col("c_mktsegment")).alias("file"), short.alias("short"),
    )


@query(f"WITH {O.WAYS} SELECT way_id, [x FOR x IN ['highway=' || highway, 'surface=' || surface, 'name=' || name] IF x IS NOT NULL] AS tags FROM ways")
def debug_tags(spark, sf):
    """The tags of a way that are shown when one looks at it closely."""
    return src.ways(spark, sf).select("way_id", streets.tag_rows(streets.flat, ["highway", "surface", "name"]).alias("tags"))


@query("SELECT event_id, '#' || lower(printf('%02x%02x%02x', (floor(255 + (0 - 255) * t + 0.5))::INT, (floor(0 + (128 - 0) * t + 0.5))::INT, (floor(0 + (0 - 0) * t + 0.5))::INT)) AS colour FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS t FROM events)")
def colours(spark, sf):
    """Colours between red and green by a share."""
    return table(spark, sf, "events").select("event_id", T.lerped("#ff0000", "#008000", F.col("event_id") % 101 / 100).alias("colour"))


# --- Caches, logs and preferences ---


@query(
    f"""WITH {_CACHE}, r AS (SELECT event_id // 2 AS key, {_NOW} - (event_id * 31 % 5000) * 500000 AS seen FROM events), h AS (SELECT key, max(seen) AS seen, count(*) AS hits FROM r JOIN cache USING (key) WHERE seen >= fetched_at AND seen - fetched_at <= 2592000000 GROUP BY key)
    SELECT key, fetched_at, greatest(last_accessed, coalesce(h.seen, last_accessed)) AS last_accessed, coalesce(hits, 0) AS hits FROM cache LEFT JOIN h USING (key)"""
)
def cache_touch(spark, sf):
    """Reads that still find their tile touch it."""
    e = F.col("event_id")
    reads = table(spark, sf, "events").select(F.expr("event_id div 2").alias("key"), (F.lit(_NOW) - e * 31 % 5000 * 500000).alias("at"))
    return tables.touched(cache(spark, sf), reads)


@query("SELECT event_id % 97 AS key, min(event_id) AS first, count(*) AS asked FROM events GROUP BY 1")
def in_flight(spark, sf):
    """Requests for one key share one fetch, that of the first."""
    rows = table(spark, sf, "events").select((F.col("event_id") % 97).alias("key"), "event_id")
    return rows.groupBy("key").agg(F.min("event_id").alias("first"), F.count("*").alias("asked"))


@query("SELECT n_name AS name, n_nationkey = 7 AS active FROM nation WHERE n_nationkey % 5 <> 0")
def preference_active(spark, sf):
    """Preferences after some were deleted and one was made the active one."""
    n = table(spark, sf, "nation")
    left = tables.without(n.select(F.col("n_name").alias("name"), "n_nationkey"), n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name")))
    chosen = n.where("n_nationkey = 7").select(F.col("n_name").alias("chosen"))
    return left.join(F.broadcast(chosen)).select("name", (F.col("name") == F.col("chosen")).alias("active"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS day, count(*) AS routes, sum(o_orderkey)::BIGINT AS check_sum FROM orders GROUP BY 1")
def log_appended(spark, sf):
    """The route log written in two goes, by month so that there are few folders, and read back from the shared folder."""
    at = f"{graph.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), "o_orderkey")
    for half in (0, 1):
        src.append_log(rows.where(F.col("o_orderkey") % 2 == half).repartition("day"), at)
    return spark.read.parquet(at).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("routes"), F.sum("o_orderkey").alias("check_sum"))


@query(
    "WITH o AS (SELECT o_custkey AS key, CASE WHEN o_orderkey % 9 <> 0 THEN 'image ' || o_orderkey END AS image, epoch_ms(o_orderdate)::BIGINT * 100 + o_orderkey % 100 AS fetched_at, o_orderkey FROM orders),"
    " l AS (SELECT key, arg_max({'i': image}, (fetched_at, o_orderkey)).i AS image, max(fetched_at) AS fetched_at FROM (SELECT *, fetched_at = max(fetched_at) OVER (PARTITION BY key) AS newest FROM o) WHERE newest GROUP BY key HAVING count(*) = 1)"
    " SELECT key, image, fetched_at FROM l WHERE (SELECT max(fetched_at) FROM o) - fetched_at <= 20000000000000"
)
def image_cache(spark, sf):
    """A cache of images in files by key, upserted twice: nulls are kept like images, the old are left out; keys with two equally new ones aside."""
    o = table(spark, sf, "orders")
    stamp = F.unix_millis(F.col("o_orderdate").cast("timestamp")) * 100 + F.col("o_orderkey") % 100
    rows = o.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("image "), F.col("o_orderkey"))).alias("image"), stamp.alias("fetched_at"), "o_orderkey")
    newest = F.max(F.struct("fetched_at")).over(W.partitionBy("key"))["fetched_at"]
    ties = rows.withColumn("newest", newest).where("fetched_at = newest").groupBy("key").count().where("count > 1").select("key")
    at = f"{graph.shared_folder(spark)}/images-{uuid.uuid4().hex}"
    for half in (0, 1):
        store.upsert(rows.where(F.col("o_orderkey") % 2 == half).select("key", "image", "fetched_at"), at, "key", "fetched_at")
    now = rows.agg(F.max("fetched_at")).first()[0]
    found = store.read(spark, at, "key long, image string, fetched_at long", now, 20_000_000_000_000)
    return found.join(ties, "key", "left_anti").select("key", "image", "fetched_at")


@query("WITH q AS (SELECT event_id AS id, user_id % 20 AS region, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT id, region FROM q WHERE nth <= 100 AND id % 11 <> 0 AND region <> 3")
def feedback_queue(spark, sf):
    """Each region's newest hundred reports, after some were deleted and one region's queue was cleared."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("region"), F.col("ts").alias("created_at"))
    return reports.queue(e, deleted=e.where("id % 11 = 0"), cleared=F.col("region") == 3).select("id", "region")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, ['preferred', 'avoided', 'rough'][CAST(event_id % 3 AS INT) + 1] AS feedback_type, count(*) AS reports, count(DISTINCT event_id % 2000) AS ways FROM events WHERE event_type = 'error' GROUP BY ALL")
def feedback_reports(spark, sf):
    """Reports written in two goes that overlap, and read back by day and kind."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("preferred", "avoided", "rough"))), (e % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").where("event_type = 'error'").select(
        e.cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("route_log_id"), (52 + e % 1000 / 1000).alias("lat"), (13 + e % 777 / 1000).alias("lng"),
        (e % 2000).alias("osm_way_id"), kind.alias("feedback_type"), F.lit(None).cast("string").alias("comment"), F.lit(MODE).alias("travel_mode"),
    )
    at = f"{graph.shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    for part in ("osm_way_id < 1200", "osm_way_id >= 800"):
        reports.append_feedback(rows.where(part), at)
    return reports.read_feedback(spark, at).groupBy("day", "feedback_type").agg(F.count("*").alias("reports"), F.count_distinct("osm_way_id").alias("ways"))


@query(
    f"""WITH {O.SEGMENTS}, l AS (SELECT route, metres, 1 + seg % 4 AS lts FROM segs), s AS (SELECT route, {', '.join(f'coalesce(sum(metres) FILTER (lts = {k}), 0) / sum(metres) AS p{k}' for k in (1, 2, 3, 4))} FROM l GROUP BY route HAVING sum(metres) > 0),
    r AS (SELECT *, floor(p1 * 100 + p2 * 70 + p3 * 30 + 0.5) AS raw FROM s), c AS (SELECT route, CASE WHEN p4 > 0 THEN least(raw, 40) WHEN p3 > 0.1 THEN least(raw, 60) ELSE raw END AS score FROM r)
    SELECT CASE WHEN score >= 85 THEN 'green' WHEN score >= 70 THEN 'yellow' WHEN score >= 50 THEN 'orange' ELSE 'red' END AS label, count(*) AS routes FROM c GROUP BY 1"""
)
def safety_labels(spark, sf):
    """How many trips get which label for their family score."""
    rows = segments.segments(pings(spark, sf)).withColumn("lts", 1 + F.col("seg") % 4)
    found = segments.lts_breakdown(rows).where("p1 + p2 + p3 + p4 > 0")
    return found.groupBy(segments.score_label(F.col("score")).alias("label")).agg(F.count("*").alias("routes"))


# --- Benchmarks ---

_PROFILES = {"kid-starting-out": "bicycle", "kid-confident": "bicycle", "training": "fastbike"}


@query(f"WITH m AS (SELECT * FROM (VALUES {', '.join(f'({O.text(m[0])})' for m in dims.MODES)}) t(mode)), p AS (SELECT s_suppkey AS pair, CASE WHEN s_suppkey % 2 = 0 THEN 'berlin' ELSE 'sf' END AS city FROM supplier) SELECT city, pair, mode, coalesce({O.cases('mode', _PROFILES)}, 'trekking') AS profile FROM p, m")
def bench_cases(spark, sf):
    """All pairs of a city in all modes, with the profile that stands for the mode elsewhere; modes are a handful."""
    pairs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pair"), F.when(F.col("s_suppkey") % 2 == 0, "berlin").otherwise("sf").alias("city"))
    profiles = spark.createDataFrame(list(_PROFILES.items()), "mode string, profile string")
    modes = dims.modes(spark).select("mode").join(F.broadcast(profiles), "mode", "left").withColumn("profile", F.coalesce("profile", F.lit("trekking")))
    return pairs.join(F.broadcast(modes)).select("city", "pair", "mode", "profile")


@query(f"WITH {O.SAMPLES}, c AS (SELECT DISTINCT pair, 'x' || pair AS key FROM samples WHERE pair % 3 = 0) SELECT city, mode, s.pair, engine, c.key IS NOT NULL AS cached FROM samples s LEFT JOIN c ON c.key = 'x' || s.pair")
def cached_routes(spark, sf):
    """Samples with whether another router's answer was kept for their pair."""
    rows = samples(spark, sf)
    kept = rows.where("pair % 3 = 0").select(F.concat(F.lit("x"), "pair").alias("key")).distinct().withColumn("cached", F.lit(True))
    found = rows.withColumn("key", F.concat(F.lit("x"), "pair")).join(kept, "key", "left")
    return found.select("city", "mode", "pair", "engine", F.coalesce("cached", F.lit(False)).alias("cached"))


@query(f"WITH {O.WIDE} SELECT count(*) AS samples, " + ", ".join(f"round(coalesce(avg({e}_pct), 0), 6) AS {e}_pct" for e in ENGINES) + ", count(*) FILTER (client_km > 1.2::DOUBLE * least(valhalla_km, brouter_km, google_km)) AS flagged FROM wide")
def bench_summary(spark, sf):
    """One line on a run."""
    found = tables.run_summary(samples(spark, sf), ENGINES)
    return found.select("samples", *(F.round(f"{e}_pct", 6).alias(f"{e}_pct") for e in ENGINES), "flagged")
