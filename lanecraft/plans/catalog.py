"""Registered queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets
from lanecraft.functions import text as T
from lanecraft.operators import graph, overlay, segments, spatial, tables
from lanecraft.sources import dims
from lanecraft.sources import ways as src
from lanecraft.sources.tables import table
from lanecraft.streaming import navigation

from . import oracle as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODE = "kid-traffic-savvy"
ENGINES = ["client", "valhalla", "brouter", "google"]
RIVALS = ENGINES[1:]
TEXTS = ["I don't mind cobbles and love cycle paths", "avoid gravel; prefer bike paths. not sure", "hate painted bike lanes\nsetts are fine", "never ride in mud, like fine gravel", "prefer the fahrradstraße", ""]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def classed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_class(src.ways(spark, sf))


def liked(column: str = "item", mode: str | None = MODE):
    return F.coalesce(F.col(column).isin(dims.preferred(mode)), F.lit(False))


def liked_by_mode():
    out = F.lit(False)
    for mode in dims.PREFERRED:
        out = F.when(F.col("mode") == mode, liked(mode=mode)).otherwise(out)
    return out


def pings(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(*(F.lit(i).cast("string") for i in [*list(dims.ITEMS)[:3], "Quiet street", "Major road", None]))
    idx = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("route"), idx.alias("idx"), "event_id",
        (F.expr(f"{src.LAT0} + {src.LAT_STEP} * ((event_id * 7) % 29) + (event_id % 13) * 3") / F.lit(1e5)).alias("lat"),
        (F.expr(f"{src.LNG0} + {src.LNG_STEP} * ((event_id * 11) % 29) + (event_id % 7) * 4") / F.lit(1e5)).alias("lng"),
        F.element_at(items, F.expr("CAST((event_id div 3 + user_id) % 6 AS INT) + 1")).alias("item"), (F.col("event_id") % 7 == 0).alias("is_walking"),
    )


def all_edges(spark: SparkSession, sf: str, **options) -> DataFrame:
    return graph.edges(graph.decided(classed(spark, sf), dims.modes(spark)), liked_by_mode(), **options)


def all_last_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.last_edges(all_edges(spark, sf), src.tasks(spark, sf))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    engine = F.element_at(F.array(*map(F.lit, ENGINES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    keys = [F.when(F.col("o_custkey") % 2 == 0, "berlin").otherwise("sf").alias("city"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("mode"), F.col("o_custkey").alias("pair"), engine.alias("engine")]
    return table(spark, sf, "orders").groupBy(*keys).agg(F.max(F.col("o_totalprice") / 10000).alias("km"), F.max(F.col("o_orderkey") * 37 % 101 / 100).alias("pct"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return tables.compared(samples(spark, sf), ENGINES)


# --- Classification ---


@query(f"WITH {O.CLS}, {O.LEGS} SELECT path_level, item, count(*) AS ways, round(sum(metres) / 1000, 3) AS km FROM cls JOIN lengths USING (way_id) GROUP BY ALL")
def class_km(spark, sf):
    rows = classed(spark, sf).withColumn("m", geo.length(F.col("coords")))
    return rows.groupBy("path_level", "item").agg(F.count("*").alias("ways"), F.round(F.sum("m") / 1000, 3).alias("km"))


@query(f"WITH {O.CLS} SELECT way_id, lts, path_level, car_free, bike_priority, bike_infra, speed_kmh, density FROM cls")
def lts_classify(spark, sf):
    return classed(spark, sf).select("way_id", "lts", "path_level", "car_free", "bike_priority", "bike_infra", "speed_kmh", "density")


RULES = [({"highway": "service", "service": "driveway"}, "Driveway"), ({"surface": "sett"}, "Rough"), ({"highway": "service"}, "Service")]


@query(f"WITH {O.CLS} SELECT way_id, item, CASE WHEN highway = 'service' AND service = 'driveway' THEN 'Driveway' WHEN surface = 'sett' THEN 'Rough' WHEN highway = 'service' THEN 'Service' ELSE item END AS by_rules FROM cls")
def item_rules(spark, sf):
    return classed(spark, sf).select("way_id", "item", streets.by_rules(streets.flat, RULES, F.col("item")).alias("by_rules"))


@query(f"WITH {O.WAYS} SELECT way_id, {O.SCAN['overlay']} AS overlay, {O.SCAN['audit']} AS audit, {O.SIGNATURE} AS signature FROM ways")
def scans(spark, sf):
    t = streets.flat
    return src.ways(spark, sf).select("way_id", streets.overlay_scan(t).alias("overlay"), streets.audit_scan(t).alias("audit"), streets.signature(t).alias("signature"))


@query(f"WITH {O.WAYS} SELECT way_id, {O.WALKING} AS walking_only, {O.BRIDGE} AS bridge, {O.ONEWAY} AS one_way, {O.ROUGH} AS rough, {O.SEPARATED} AS separated FROM ways")
def way_flags(spark, sf):
    t = streets.flat
    rough = streets.rough(t("surface"), t("smoothness"))
    return src.ways(spark, sf).select("way_id", streets.walking_only(t).alias("walking_only"), streets.bridge_walkable(t).alias("bridge"), streets.one_way(t).alias("one_way"), rough.alias("rough"), streets.separated(t).alias("separated"))


_HIT = "(contains(lower(name), 'landwehrkanal') OR contains(lower(name), 'mauerweg'))"


@query(
    f"""WITH {O.CLS}, mid AS (SELECT way_id, lat, lng FROM pts WHERE idx = 2), o AS (
        SELECT c.*, coalesce({_HIT}, false) AS up, coalesce((contains(lower(name), 'oranienstraße') OR contains(lower(name), 'oranienstrasse')) AND highway = 'tertiary', false) AS down,
            CASE WHEN m.lat BETWEEN 52.5160 AND 52.5260 AND m.lng BETWEEN 13.3950 AND 13.4200 THEN 'cobblestone' ELSE surface END AS zone FROM cls c JOIN mid m USING (way_id))
    SELECT way_id, greatest(CASE WHEN up THEN least(lts, 1) ELSE lts END, CASE WHEN down THEN 3 ELSE 0 END) AS lts, car_free OR up AS car_free, bike_priority AND NOT down AS bike_priority, zone AS surface, path_level FROM o"""
)
def region_overlay(spark, sf):
    rows = classed(spark, sf)
    mid = geo.midpoint(F.col("coords"))
    cls = {c: F.col(c) for c in ("lts", "car_free", "bike_priority", "bike_infra", "surface_", "path_level", "speed_kmh")}
    out = streets.overlaid(cls, F.col("name"), streets.flat, mid["lat"], mid["lng"], dims.BERLIN)
    return rows.select("way_id", *(out[c].alias(c.rstrip("_")) for c in ("lts", "car_free", "bike_priority", "surface_", "path_level")))


@query(f"WITH {O.CLS} SELECT coalesce(CASE WHEN surface IN ('cobblestone', 'sett') THEN NULL ELSE surface END, 'none') AS surface, count(*) AS ways FROM cls GROUP BY 1")
def preference_adjust(spark, sf):
    rows = classed(spark, sf).select(streets.tolerant(F.col("surface_"), ["cobblestone", "sett"]).alias("s"))
    return rows.groupBy(F.coalesce("s", F.lit("none")).alias("surface")).agg(F.count("*").alias("ways"))


_DECISIONS = "SELECT mode, ok AS accepted, reason, walks, count(*) AS ways, round(sum(coalesce(kmh * mult, 0)), 3) AS weight FROM dec GROUP BY ALL"


def _decisions(rows: DataFrame) -> DataFrame:
    weight = F.round(F.sum(F.coalesce(F.col("kmh") * F.col("mult"), F.lit(0.0))), 3)
    return rows.groupBy("mode", F.col("accepted_").alias("accepted"), "reason", "walks").agg(F.count("*").alias("ways"), weight.alias("weight"))


@query(f"WITH {O.decided()} {_DECISIONS}")
def mode_decision(spark, sf):
    return _decisions(graph.decided(classed(spark, sf), dims.modes(spark)))


@query(f"WITH {O.decided(2.5)} {_DECISIONS}")
def mode_override(spark, sf):
    return _decisions(graph.decided(classed(spark, sf), dims.modes(spark, rough=2.5)))


_LEGEND = ", ".join(f"({O.text(m)}, {O.text(i)}, {O.text(lv)}, {i in dims.preferred(m)}, {i in dims.preferred(m, True)})" for m in dims.PREFERRED for i, lv in dims.ITEMS.items())


@query(f"WITH {O.CLS}, l AS (SELECT * FROM (VALUES {_LEGEND}) t(mode, item, level, preferred, optional)) SELECT mode, coalesce(l.level, path_level) AS display, preferred, optional, count(*) AS ways FROM cls JOIN l USING (item) GROUP BY ALL")
def legend_levels(spark, sf):
    both = dims.legend(spark).join(dims.legend(spark, True).select("mode", "item", F.col("preferred").alias("optional")), ["mode", "item"])
    rows = classed(spark, sf).groupBy("item", "path_level").agg(F.count("*").alias("n"))
    # The key is never null, so no null test is pushed down into the classification.
    rows = rows.withColumn("item", F.coalesce("item", F.lit(""))).join(F.broadcast(both), "item")
    return rows.groupBy("mode", F.coalesce("level", "path_level").alias("display"), "preferred", "optional").agg(F.sum("n").alias("ways"))


@query(f"WITH {O.decided()} SELECT mode, item, path_level, count(*) AS ways FROM dec WHERE path_level <> '4' AND NOT {O.ROUGH} AND list_contains(preferred, item) GROUP BY ALL")
def overlay_visible(spark, sf):
    rows = graph.decided(classed(spark, sf), dims.modes(spark))
    seen = (F.col("path_level") != "4") & ~streets.rough(F.col("surface_"), F.col("smoothness_")) & liked_by_mode()
    return rows.where(seen).groupBy("mode", "item", "path_level").agg(F.count("*").alias("ways"))


_USE = ["cycleway", "path", "mountain_bike", "footway", "pedestrian", "living_street", "road", None]
_LANE = ["separated", "dedicated", "share_busway", "shared", "none", None]
_ROAD = [*streets.ROAD_RANK, None]


@query(
    f"""WITH e AS (SELECT s_suppkey AS id, {O.array(_USE)}[CAST(s_suppkey % 8 AS INT) + 1] AS u, {O.array(_LANE)}[CAST(s_suppkey // 3 % 6 AS INT) + 1] AS l, {O.array(_ROAD)}[CAST(s_suppkey // 5 % 9 AS INT) + 1] AS r, s_suppkey % 13 = 0 AS b FROM supplier)
    SELECT id, CASE WHEN b THEN 'Fahrradstrasse' WHEN u IN ('cycleway', 'path', 'mountain_bike') THEN 'Bike path' WHEN u IN ('footway', 'pedestrian') THEN 'Shared use path' WHEN l = 'separated' THEN 'Elevated sidewalk path'
        WHEN l = 'dedicated' THEN 'Painted bike lane on quiet street' WHEN u = 'living_street' THEN 'Living street' WHEN l = 'share_busway' THEN 'Shared bus lane on quiet street' WHEN l = 'shared' THEN NULL
        WHEN r IN ('residential', 'service_other') THEN 'Quiet street' WHEN r IS NULL OR r IN ('tertiary', 'unclassified') THEN 'Major road' END AS item FROM e"""
)
def external_items(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), F.expr(f"CAST({at} AS INT) + 1"))
    found = streets.external_item(pick(_USE, "s_suppkey % 8"), pick(_LANE, "s_suppkey div 3 % 6"), pick(_ROAD, "s_suppkey div 5 % 9"), F.col("s_suppkey") % 13 == 0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), found.alias("item"))


# --- Tiles and geometry ---


@query(f"WITH {O.WAYS} SELECT CAST(floor(lat / 0.1::DOUBLE) AS INT) AS tile_row, CAST(floor(lng / 0.1::DOUBLE) AS INT) AS tile_col, CAST(floor((lng + 180) / 360 * 4096) AS INT) AS x, count(*) AS vertices, count(DISTINCT way_id) AS ways FROM pts GROUP BY ALL")
def tiles(spark, sf):
    rows = src.way_points(src.ways(spark, sf))
    x, _ = geo.mercator_tile(F.col("lat"), F.col("lng"), 12)
    return rows.groupBy(geo.tile(F.col("lat")).alias("tile_row"), geo.tile(F.col("lng")).alias("tile_col"), F.floor(x).cast("int").alias("x")).agg(F.count("*").alias("vertices"), F.countDistinct("way_id").alias("ways"))


@query(
    f"""WITH {O.PINGS}, b AS (SELECT route, min(lat) - 0.05::DOUBLE AS s, max(lat) + 0.05::DOUBLE AS n, min(lng) - 0.05::DOUBLE AS w, max(lng) + 0.05::DOUBLE AS e FROM pings GROUP BY route)
    SELECT route, CAST(r AS INT) AS tile_row, CAST(c AS INT) AS tile_col FROM b, unnest(range(CAST(floor(s / 0.1::DOUBLE) AS BIGINT), CAST(floor(n / 0.1::DOUBLE) AS BIGINT) + 1)) t(r), unnest(range(CAST(floor(w / 0.1::DOUBLE) AS BIGINT), CAST(floor(e / 0.1::DOUBLE) AS BIGINT) + 1)) u(c)"""
)
def corridor_tiles(spark, sf):
    box = pings(spark, sf).groupBy("route").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lng") for f in (F.min, F.max)))
    rows = box.withColumn("tile_row", F.explode(F.sequence(geo.tile(F.col("min_lat") - 0.05), geo.tile(F.col("max_lat") + 0.05))))
    return rows.withColumn("tile_col", F.explode(F.sequence(geo.tile(F.col("min_lng") - 0.05), geo.tile(F.col("max_lng") + 0.05)))).select("route", "tile_row", "tile_col")


@query("SELECT event_id, round(-10000.0::DOUBLE + (65536 * (event_id % 2) + 256 * (event_id % 251) + event_id % 17) * 0.1::DOUBLE, 3) AS metres, event_id % 360 AS heading FROM events")
def elevation_decode(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(geo.terrain_metres(e % 2, e % 251, e % 17), 3).alias("metres"), F.pmod(e, F.lit(360)).alias("heading"))


# --- Graph ---

_SUMS = "count(*) AS edges, round(sum({0}dist), 2) AS metres, round(sum({0}cost), 2) AS seconds, count(*) FILTER ({0}is_walking) AS walked"


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.count("*").alias("edges"), F.round(F.sum("dist"), 2).alias("metres"), F.round(F.sum("cost"), 2).alias("seconds"), F.count_if("is_walking").alias("walked"))


@query(f"WITH {O.edges()} SELECT mode, {_SUMS.format('')} FROM edges GROUP BY mode")
def graph_edges(spark, sf):
    return _sums(all_edges(spark, sf))


@query(f"WITH {O.edges()} SELECT mode, {_SUMS.format('e.')} FROM last_edges GROUP BY mode")
def graph_last_edges(spark, sf):
    return _sums(all_last_edges(spark, sf))


@query(f"WITH {O.edges()}, n AS (SELECT mode, src AS node FROM edges UNION SELECT mode, dst FROM edges) SELECT mode, count(*) AS nodes, sum(node % 1000003)::BIGINT AS check_sum FROM n GROUP BY mode")
def graph_nodes(spark, sf):
    return graph.nodes(all_edges(spark, sf)).groupBy("mode").agg(F.count("*").alias("nodes"), F.sum(F.col("node") % 1000003).alias("check_sum"))


@query(f"WITH {O.edges('AND d.way_id % 5 <> 0')} SELECT mode, {_SUMS.format('')} FROM edges GROUP BY mode")
def graph_avoid(spark, sf):
    ways = src.ways(spark, sf)
    return _sums(all_edges(spark, sf, avoid=ways.where("way_id % 5 = 0")))


@query(f"WITH {O.edges(steep='(metres >= 30 AND (d.way_id % 41) / metres * 100 > gradient_cap)')} SELECT mode, {_SUMS.format('')} FROM edges GROUP BY mode")
def gradient_gate(spark, sf):
    return _sums(all_edges(spark, sf, elevation=(F.lit(0.0), (F.col("way_id") % 41).cast("double"))))


@query(f"WITH {O.edges()}, o AS (SELECT mode, src, count(*) AS degree FROM last_edges GROUP BY ALL) SELECT mode, degree, count(*) AS nodes FROM o GROUP BY ALL")
def graph_degrees(spark, sf):
    out = all_last_edges(spark, sf).groupBy("mode", "src").agg(F.count("*").alias("degree"))
    return out.groupBy("mode", "degree").agg(F.count("*").alias("nodes"))


_START = (O.LAT0 + 9_000_000) * 100_000_000 + O.LNG0 + 18_000_000


@query(
    f"""WITH RECURSIVE {O.edges()}, pairs AS (SELECT DISTINCT mode, src, dst FROM edges WHERE mode = '{MODE}'), reach(mode, node) AS (
        SELECT '{MODE}', {_START}::BIGINT UNION SELECT r.mode, p.dst FROM reach r JOIN pairs p ON p.src = r.node)
    SELECT mode, count(*) AS nodes, sum(node % 1000003)::BIGINT AS check_sum FROM reach GROUP BY mode"""
)
def reachable_set(spark, sf):
    starts = spark.range(1).select(F.lit(MODE).alias("mode"), F.lit(_START).cast("long").alias("node"))
    found = graph.reachable(all_edges(spark, sf).where(F.col("mode") == MODE), starts)
    return found.groupBy("mode").agg(F.count("*").alias("nodes"), F.sum(F.col("node") % 1000003).alias("check_sum"))


def _with_region(links: DataFrame) -> DataFrame:
    """Edges with the district of their grid, which no edge leaves."""
    return links.withColumn("region", F.floor((F.col("src") / 100_000_000 - 9_000_000 - src.LAT0) / (src.LAT_STEP * 40)).cast("long"))


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Edges with their district, and for each district and mode the pair of its first and last node."""
    links = _with_region(all_last_edges(spark, sf)).checkpoint()
    ends = links.groupBy("mode", "region").agg(F.min("src").alias("src"), F.max("src").alias("dst"))
    return links, ends.withColumn("pair", F.col("region"))


@query()
def shortest_paths(spark, sf):
    links, pairs = _asked(spark, sf)
    found = overlay.routes(overlay.build(links), pairs)
    return found.groupBy("mode", "pair").agg(F.max("idx").alias("hops"), F.round(F.max("cost"), 3).alias("seconds"))


@query()
def route_summary(spark, sf):
    """Distance, time and share walked of the cheapest paths."""
    links, pairs = _asked(spark, sf)
    w = W.partitionBy("mode", "pair").orderBy("idx")
    path = overlay.routes(overlay.build(links), pairs).withColumn("src", F.lag("node").over(w)).where("src IS NOT NULL").withColumnRenamed("node", "dst")
    path = path.drop("cost").join(links.drop("region"), ["mode", "src", "dst"], "left")
    metres, walked = F.sum("dist"), F.sum(F.when(F.col("is_walking"), F.col("dist")).otherwise(0.0))
    return path.groupBy("mode", "pair").agg(F.round(metres / 1000, 3).alias("km"), F.round(F.sum("cost"), 3).alias("seconds"), F.round(F.when(metres > 0, walked / metres).otherwise(0.0), 6).alias("walked"))


@query(
    f"""WITH {O.edges()}, {O.PINGS}, n AS (SELECT DISTINCT src AS node FROM edges WHERE mode = '{MODE}'), nn AS (SELECT node, (node // 100000000 - 9000000) / 100000.0::DOUBLE AS lat, (node % 100000000 - 18000000) / 100000.0::DOUBLE AS lng FROM n),
    p AS (SELECT DISTINCT lat, lng FROM pings), m AS (SELECT p.lat, p.lng, min({O.haversine('p.lat', 'p.lng', 'nn.lat', 'nn.lng')}) AS d FROM p JOIN nn ON nn.lat BETWEEN p.lat - 0.01 AND p.lat + 0.01 GROUP BY ALL)
    SELECT event_id AS point, round(CASE WHEN d <= 1000 THEN d END, 3) AS metres FROM pings LEFT JOIN m USING (lat, lng)"""
)
def snap_start(spark, sf):
    """All positions at the nearest node with an edge leaving it, within 1000 m; positions at one place are snapped once."""
    return snap_start_all(spark, sf)


@query()
def snap_start_all(spark, sf):
    """All positions at the nearest node with an edge leaving it; positions at one place are snapped once."""
    found = _snapped(spark, sf)
    return found.select(F.col("event_id").alias("point"), F.round("metres", 3).alias("metres"))


def _snapped(spark: SparkSession, sf: str) -> DataFrame:
    links = all_edges(spark, sf).where(F.col("mode") == MODE).checkpoint()
    nodes = graph.nodes(links).join(links.select("mode", F.col("src").alias("node")).distinct(), ["mode", "node"], "left_semi")
    points = pings(spark, sf)
    places = points.select(F.struct("lat", "lng").alias("point"), F.lit(MODE).alias("mode"), "lat", "lng").distinct()
    found = graph.snapped(places, nodes).select("point.lat", "point.lng", "node", "metres")
    return points.join(found, ["lat", "lng"], "left")


@query(
    f"""WITH {O.edges()}, {O.PINGS}, n AS (SELECT DISTINCT src AS node FROM edges WHERE mode = '{MODE}'), nn AS (SELECT node, (node // 100000000 - 9000000) / 100000.0::DOUBLE AS lat, (node % 100000000 - 18000000) / 100000.0::DOUBLE AS lng FROM n),
    p AS (SELECT DISTINCT lat, lng FROM pings), m AS (SELECT p.lat, p.lng, nn.node, {O.haversine('p.lat', 'p.lng', 'nn.lat', 'nn.lng')} AS d FROM p JOIN nn ON nn.lat BETWEEN p.lat - 0.01 AND p.lat + 0.01),
    b AS (SELECT lat, lng, arg_min(node, (round(d, 6), node)) AS node FROM m WHERE d <= 1000 GROUP BY ALL) SELECT event_id AS point, node FROM pings LEFT JOIN b USING (lat, lng)"""
)
def snap_nodes(spark, sf):
    """Which node each position is snapped to."""
    return _snapped(spark, sf).select(F.col("event_id").alias("point"), "node")


# --- Segments ---


@query(f"WITH {O.SEGMENTS} SELECT route, seg, item, is_walking, n_coords, round(metres, 3) AS metres FROM segs")
def trip_segments(spark, sf):
    return segments.segments(pings(spark, sf)).select("route", "seg", "item", "is_walking", "n_coords", F.round("metres", 3).alias("metres"))


@query(f"WITH {O.HEALED} SELECT route, seg, item, healed FROM healed")
def heal_gaps(spark, sf):
    return segments.healed(segments.segments(pings(spark, sf)), liked()).select("route", "seg", "item", "healed")


@query(f"WITH {O.HEALED} SELECT route, round(coalesce(sum(metres) FILTER (NOT is_walking AND {O.GOOD}) / sum(metres), 0), 6) AS preferred, round(coalesce(sum(metres) FILTER (NOT is_walking AND NOT {O.GOOD}) / sum(metres), 0), 6) AS other, round(coalesce(sum(metres) FILTER (is_walking) / sum(metres), 0), 6) AS walking FROM healed GROUP BY route HAVING sum(metres) > 0")
def route_quality(spark, sf):
    found = segments.healed(segments.segments(pings(spark, sf)), liked())
    out = segments.quality(found, liked()).where("preferred + other + walking > 0")
    return out.select("route", *(F.round(c, 6).alias(c) for c in ("preferred", "other", "walking")))


@query(
    f"""WITH {O.SEGMENTS}, l AS (SELECT route, metres, 1 + seg % 4 AS lts FROM segs), s AS (SELECT route, sum(metres) AS t, {', '.join(f'coalesce(sum(metres) FILTER (lts = {k}), 0) / sum(metres) AS p{k}' for k in (1, 2, 3, 4))}, max(lts) AS worst FROM l GROUP BY route HAVING sum(metres) > 0),
    r AS (SELECT *, floor(p1 * 100 + p2 * 70 + p3 * 30 + 0.5) AS raw FROM s)
    SELECT route, round(p1, 6) AS p1, round(p4, 6) AS p4, worst, CAST(CASE WHEN p4 > 0 THEN least(raw, 40) WHEN p3 > 0.1 THEN least(raw, 60) ELSE raw END AS BIGINT) AS score FROM r"""
)
def safety_score(spark, sf):
    rows = segments.segments(pings(spark, sf)).withColumn("lts", 1 + F.col("seg") % 4)
    out = segments.lts_breakdown(rows).where("p1 + p2 + p3 + p4 > 0")
    return out.select("route", F.round("p1", 6).alias("p1"), F.round("p4", 6).alias("p4"), "worst", "score")


@query(
    f"""WITH {O.SEGMENTS}, ends AS (SELECT s.*, p.lat AS stop_lat, p.lng AS stop_lng FROM segs s JOIN (SELECT route, seg, arg_max(lat, idx) AS lat, arg_max(lng, idx) AS lng FROM num GROUP BY ALL) p USING (route, seg)),
    f AS (SELECT *, CASE WHEN seg = 0 THEN 0 WHEN item IS NOT DISTINCT FROM lag(item) OVER w THEN 0 ELSE 1 END AS fresh FROM ends WINDOW w AS (PARTITION BY route ORDER BY seg)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY seg) AS run FROM f)
    SELECT route, CAST(run AS BIGINT) AS run, any_value(item) AS item, count(*) AS segments, round(arg_max(stop_lat, seg), 6) AS lat, round(arg_max(stop_lng, seg), 6) AS lng FROM n GROUP BY route, run"""
)
def icon_runs(spark, sf):
    """Where the icons of a route go: runs of segments of one item. A segment begins where the one before ends, so no gap parts them here."""
    found = segments.coalesced(segments.segments(pings(spark, sf)))
    end = F.max_by("stop", "seg")
    return found.groupBy("route", "run").agg(F.first("item").alias("item"), F.count("*").alias("segments"), F.round(end["lat"], 6).alias("lat"), F.round(end["lng"], 6).alias("lng"))


# --- Nearness ---

_NEAR = """WITH {ways}, {pings}, m AS (SELECT route, p.idx, v.way_id, v.idx AS vertex, {far} AS far FROM pings p JOIN pts v ON {near}),
    b AS (SELECT *, row_number() OVER (PARTITION BY route, idx ORDER BY round(far, 12), way_id, vertex) AS nth FROM m)
    SELECT p.route, p.idx, b.way_id FROM pings p LEFT JOIN b ON b.route = p.route AND b.idx = p.idx AND nth = 1"""


def _scored(spark, sf, **options) -> DataFrame:
    return spatial.nearest_vertex(pings(spark, sf), src.way_points(src.ways(spark, sf)), **options).select("route", "idx", "way_id")


@query(_NEAR.format(ways=O.WAYS, pings=O.PINGS, far="pow(v.lat - p.lat, 2) + pow(v.lng - p.lng, 2)", near="abs(v.lat - p.lat) <= 0.0003 AND abs(v.lng - p.lng) <= 0.0003"))
def score_box(spark, sf):
    return _scored(spark, sf)


@query(_NEAR.format(ways=O.WAYS, pings=O.PINGS, far="abs(v.lat - p.lat) + abs(v.lng - p.lng)", near="abs(v.lat - p.lat) < 0.0005 AND abs(v.lat - p.lat) + abs(v.lng - p.lng) < 0.0005"))
def score_manhattan(spark, sf):
    return _scored(spark, sf, box=0.0005, metric="manhattan")


@query(f"WITH {O.CLS}, {O.PINGS}, p AS (SELECT DISTINCT lat, lng FROM pings), g AS (SELECT v.way_id, v.lat, v.lng FROM pts v JOIN cls c USING (way_id) WHERE {O.GOOD.replace('item', 'c.item')}), v AS (SELECT DISTINCT lat, lng FROM g), near AS (SELECT DISTINCT v.lat, v.lng FROM v JOIN p ON abs(p.lat - v.lat) < 0.005 AND abs(p.lng - v.lng) < 0.005) SELECT DISTINCT way_id FROM g JOIN near USING (lat, lng)")
def route_suggestions(spark, sf):
    """Ways that the mode prefers within the reference's 0.005 degrees of any position of any route."""
    return route_suggestions_all(spark, sf)


@query()
def route_suggestions_all(spark, sf):
    """Ways that the mode prefers within the reference's 0.005 degrees of any position of any route."""
    good = classed(spark, sf).where(liked())
    return spatial.ways_near(src.way_points(good), pings(spark, sf))


_PLACES = "places AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 52 + (c_custkey * 7919 % 100000) / 100000.0::DOUBLE END AS lat, 13 + (c_custkey * 104729 % 100000) / 100000.0::DOUBLE AS lng FROM customer)"


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 10 != 3, 52 + k * 7919 % 100000 / 100000).alias("lat"), (13 + k * 104729 % 100000 / 100000).alias("lng"))


@query(
    f"""WITH {_PLACES}, a AS (SELECT * FROM places WHERE id % 2 = 0 AND lat IS NOT NULL), m AS (
        SELECT a.id AS point, b.id AS image, CASE WHEN greatest(abs(a.lat - b.lat), abs(a.lng - b.lng)) <= 100 / 111000.0::DOUBLE THEN 100 WHEN greatest(abs(a.lat - b.lat), abs(a.lng - b.lng)) <= 250 / 111000.0::DOUBLE THEN 250 WHEN greatest(abs(a.lat - b.lat), abs(a.lng - b.lng)) <= 500 / 111000.0::DOUBLE THEN 500 END AS radius,
            round(pow(abs(a.lat - b.lat) * 111000, 2) + pow(abs(a.lng - b.lng) * 111000 * cos(radians(52.5::DOUBLE)), 2), 6) AS far FROM a, places b WHERE b.id % 2 = 1 AND b.lat IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY radius, far, image) AS nth FROM m WHERE radius IS NOT NULL) SELECT a.id AS point, n.image, n.radius FROM a LEFT JOIN n ON n.point = a.id AND nth = 1"""
)
def nearest_image(spark, sf):
    p = places(spark, sf).where("lat IS NOT NULL")
    return spatial.nearest_image(p.where("id % 2 = 0").select(F.col("id").alias("point"), "lat", "lng"), p.where("id % 2 = 1").select(F.col("id").alias("image"), "lat", "lng"))


@query(f"WITH {_PLACES} SELECT a.id FROM places a WHERE a.id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM places b WHERE b.id % 3 = 0 AND abs(a.lat - b.lat) <= 0.005 AND abs(a.lng - b.lng) <= 0.005)")
def place_dedup(spark, sf):
    p = places(spark, sf)
    return spatial.apart_from(p.where("id % 3 <> 0"), p.where("id % 3 = 0"), 0.005).select("id")


@query(f"WITH {_PLACES} SELECT id, name FROM places WHERE contains(lower(name), '00001')")
def place_match(spark, sf):
    return places(spark, sf).where(F.contains(F.lower("name"), F.lower(F.trim(F.lit(" 00001 "))))).select("id", "name")


_CITY = ", ".join(f"({O.text(c)}, {s}, {w}, {n}, {e}, {k})" for k, (c, s, w, n, e) in enumerate(dims.CITIES))


@query(f"WITH {O.PINGS}, c AS (SELECT * FROM (VALUES {_CITY}) t(city, s, w, n, e, ord)), m AS (SELECT event_id, arg_min(city, ord) AS city FROM pings JOIN c ON lat BETWEEN s AND n AND lng BETWEEN w AND e GROUP BY event_id) SELECT m.city, count(*) AS pings FROM pings LEFT JOIN m USING (event_id) GROUP BY 1")
def region_detect(spark, sf):
    inside = lambda south, west, north, east: F.col("lat").between(south, north) & F.col("lng").between(west, east)
    city = F.coalesce(*(F.when(inside(*box), name) for name, *box in dims.CITIES))
    return pings(spark, sf).groupBy(city.alias("city")).agg(F.count("*").alias("pings"))


# --- Audits and benchmarks ---


@query(
    f"""WITH {O.CLS}, {O.LEGS}, a AS (SELECT way_id, {O.SIGNATURE} AS signature, item, metres / 1000 AS km, row_number() OVER (PARTITION BY {O.SIGNATURE}, item ORDER BY way_id) AS nth FROM cls JOIN lengths USING (way_id) WHERE {O.SCAN['audit']})
    SELECT signature, item, count(*) AS ways, round(sum(km), 3) AS km, string_agg(way_id::VARCHAR, ',' ORDER BY way_id) FILTER (nth <= 5) AS samples FROM a GROUP BY ALL"""
)
def audit_groups(spark, sf):
    scan = src.ways(spark, sf).where(streets.audit_scan(streets.flat))
    return tables.audit_groups(scan.unionByName(scan)).withColumn("km", F.round("km", 3))


@query(f"WITH {O.decided()} SELECT mode, CASE WHEN NOT ok OR walks OR mult > 1.01 THEN 'not-preferred' ELSE 'preferred' END AS bucket, CASE WHEN NOT ok THEN 'rej' WHEN walks THEN 'walk' WHEN mult > 1.01 THEN 'rough' ELSE 'ok' END AS tag, path_level, item, count(*) AS ways FROM dec GROUP BY ALL")
def audit_buckets(spark, sf):
    rows = graph.decided(classed(spark, sf), dims.modes(spark))
    args = F.col("accepted_"), F.col("walks"), F.coalesce("mult", F.lit(1.0))
    return rows.groupBy("mode", tables.audit_bucket(*args).alias("bucket"), tables.audit_tag(*args).alias("tag"), "path_level", "item").agg(F.count("*").alias("ways"))


@query(f"WITH {O.SAMPLES} SELECT city, mode, engine, count(*) AS found, round(avg(pct), 6) AS pct, round(avg(km), 4) AS km FROM samples GROUP BY ALL UNION ALL SELECT 'all', mode, engine, count(*), round(avg(pct), 6), round(avg(km), 4) FROM samples GROUP BY ALL")
def bench_averages(spark, sf):
    """By city and over all cities: one pass with grouping sets."""
    rows = samples(spark, sf)
    sets = rows.groupingSets([["city", "mode", "engine"], ["mode", "engine"]], "city", "mode", "engine")
    found = sets.agg(F.count("*").alias("found"), F.round(F.avg("pct"), 6).alias("pct"), F.round(F.avg("km"), 4).alias("km"))
    return found.withColumn("city", F.coalesce("city", F.lit("all")))


@query(f"WITH {O.WIDE} SELECT mode, " + ", ".join(f"count(*) FILTER (client_pct - {e}_pct > 0.05) AS {e}_w, count(*) FILTER (abs(client_pct - {e}_pct) <= 0.05) AS {e}_t, count(*) FILTER (client_pct - {e}_pct < -0.05) AS {e}_l" for e in RIVALS) + " FROM wide GROUP BY mode")
def bench_wtl(spark, sf):
    votes = wide(spark, sf).select("mode", *(tables.verdict(F.col("client_pct"), F.col(f"{e}_pct")).alias(e) for e in RIVALS))
    return votes.groupBy("mode").agg(*(F.count_if(F.col(e) == v).alias(f"{e}_{v.lower()}") for e in RIVALS for v in "WTL"))


@query(f"WITH {O.WIDE} SELECT city, mode, pair, round((client_km / least(valhalla_km, brouter_km, google_km) - 1) * 100, 4) AS overhead, coalesce(client_km > 1.2::DOUBLE * least(valhalla_km, brouter_km, google_km), false) AS flagged, round(greatest(client_pct, valhalla_pct, brouter_pct, google_pct), 4) AS best FROM wide")
def bench_overhead(spark, sf):
    least = tables.shortest_rival(RIVALS)
    best = F.greatest(*(F.col(f"{e}_pct") for e in ENGINES))
    return wide(spark, sf).select("city", "mode", "pair", F.round((F.col("client_km") / least - 1) * 100, 4).alias("overhead"), F.coalesce(F.col("client_km") > 1.2 * least, F.lit(False)).alias("flagged"), F.round(best, 4).alias("best"))


@query(
    """WITH r AS (SELECT o_custkey AS request, o_orderkey AS ord, o_totalprice AS seconds, (o_orderkey * 37 % 101) / 100.0::DOUBLE AS preferred FROM orders), e AS (SELECT *, seconds <= min(seconds) OVER (PARTITION BY request) * 1.75::DOUBLE AS eligible FROM r)
    SELECT request, ord, eligible, row_number() OVER (PARTITION BY request ORDER BY eligible DESC, preferred DESC, ord)::INT AS place FROM e"""
)
def route_rank(spark, sf):
    routes = table(spark, sf, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderkey") * 37 % 101 / 100).alias("preferred"))
    return tables.ranked(routes).select("request", "ord", "eligible", "place")


# --- Caches, logs, events ---

_CACHE = "cache AS (SELECT event_id AS key, event_id AS ord, 1700000000000 - (event_id * 7919 % 4000) * 1000000 AS fetched_at, 1700000000000 - (event_id * 104729 % 3000) * 1000 AS last_accessed FROM events)"
_NOW = 1_700_000_000_000


def cache(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("key"), k.alias("ord"), (F.lit(_NOW) - k * 7919 % 4000 * 1000000).alias("fetched_at"), (F.lit(_NOW) - k * 104729 % 3000 * 1000).alias("last_accessed"))


@query(f"WITH {_CACHE}, x AS (SELECT *, {_NOW} - fetched_at > 2592000000 AS old FROM cache), s AS (SELECT key, row_number() OVER (ORDER BY last_accessed, ord) AS nth, count(*) OVER () AS n FROM x WHERE NOT old) SELECT key, 'expired' AS why FROM x WHERE old UNION ALL SELECT key, 'unused' FROM s WHERE nth <= n - 2000")
def cache_evict(spark, sf):
    return tables.evicted(cache(spark, sf), _NOW, 2000)


@query(f"WITH {_CACHE}, n AS (SELECT key // 2 AS k, fetched_at, key FROM cache) SELECT k AS key, arg_max(fetched_at, key) AS fetched_at FROM n GROUP BY k")
def tile_upsert(spark, sf):
    rows = cache(spark, sf).select(F.expr("key div 2").alias("key"), "fetched_at", F.col("key").alias("version"))
    return tables.upserted(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "key", "version").select("key", "fetched_at")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100")
def feedback_cap(spark, sf):
    """The queue keeps the newest 100 entries."""
    return table(spark, sf, "events").orderBy(F.col("event_id").desc()).limit(100).select("event_id", "user_id")


@query("WITH a AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 10) SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.id IS NULL THEN 'old' ELSE 'new' END AS text, CASE WHEN a.id IS NULL THEN 2 ELSE 1 END AS created_at FROM a FULL OUTER JOIN b ON a.name = b.name")
def preference_upsert(spark, sf):
    n = table(spark, sf, "nation")
    old = n.where("n_nationkey < 15").select(F.col("n_name").alias("name"), F.lit("old").alias("text"), F.lit(1).alias("created_at"))
    new = n.where("n_nationkey >= 10").select(F.col("n_name").alias("name"), F.lit("new").alias("text"), F.lit(2).alias("created_at"))
    return tables.merged_preferences(old, new)


_MS = "CAST(epoch_ms(ts) AS BIGINT)"


@query(f"WITH e AS (SELECT event_id, user_id, {_MS} AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM e) SELECT event_id, user_id FROM n WHERE nx IS NULL OR nx - t > 3600000")
def debounce(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return tables.debounced(rows, "user_id", "t", 3_600_000).select("event_id", "user_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_request(spark, sf):
    return tables.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events) SELECT user_id, event_id FROM r WHERE nth <= 5")
def group_topk(spark, sf):
    return tables.latest(table(spark, sf, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id").asc()], 5).select("user_id", "event_id")


_AWAY = O.haversine("p.lat", "p.lng", "m.lat", "m.lng")


@query(
    f"""WITH RECURSIVE {O.PINGS}, man AS (SELECT route, idx // 10 AS k, lat, lng FROM pings WHERE idx % 10 = 0),
    st(route, idx, step, f, n, far, near) AS (
        SELECT DISTINCT route, -1::BIGINT, 0::BIGINT, false, false, false, false FROM pings
        UNION ALL
        SELECT route, idx, CASE WHEN away <= 30 THEN step + 1 ELSE step END, (away <= 30) IS NOT TRUE AND (f OR far), (away <= 30) IS NOT TRUE AND (n OR near), far, near FROM (
            SELECT *, coalesce(away <= 200 AND NOT f, false) AS far, coalesce(away <= 50 AND NOT n, false) AS near FROM (
                SELECT s.route, p.idx, s.step, s.f, s.n, CASE WHEN m.k IS NOT NULL THEN {_AWAY} END AS away
                FROM st s JOIN pings p ON p.route = s.route AND p.idx = s.idx + 1 LEFT JOIN man m ON m.route = s.route AND m.k = s.step + 1)))
    SELECT s.route AS trip, p.event_id, s.step::INT AS step, far, near FROM st s JOIN pings p ON p.route = s.route AND p.idx = s.idx"""
)
def nav_steps(spark, sf):
    """Each trip's steps and announcements; every tenth of its points is a manoeuvre."""
    points = pings(spark, sf).select(F.col("route").alias("trip"), "idx", "event_id", "lat", "lng")
    return navigation.steps_batch(points.withColumnRenamed("idx", "ts"), points.where("idx % 10 = 0").select("trip", "idx", "lat", "lng"))


# --- Text ---


@query("SELECT c_custkey AS id, left(regexp_replace(regexp_replace(lower(c_name || ' & Söhne/' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 32) AS slug, replace(replace(replace(replace('<b>' || c_name || '\" & co', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, CASE WHEN c_custkey % 7200 // 3600 > 0 THEN (c_custkey % 7200 // 3600) || 'h ' || (c_custkey % 3600 // 60) || 'm' ELSE (c_custkey % 3600 // 60) || ' min' END AS duration FROM customer")
def labels(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat("c_name", F.lit(" & Söhne/"), "c_mktsegment")
    return c.select(F.col("c_custkey").alias("id"), T.slug(name).alias("slug"), T.escape_html(F.concat(F.lit("<b>"), "c_name", F.lit('" & co'))).alias("escaped"), T.duration_label(F.col("c_custkey") % 7200).alias("duration"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 1000)::BIGINT::VARCHAR || ' m' ELSE printf('%.1f km', (c_custkey % 1000) + 0.5::DOUBLE) END AS distance FROM customer")
def distances(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), T.distance_label(F.when(k % 2 == 0, k % 1000 / 1000).otherwise(k % 1000 + 0.5)).alias("distance"))


#: What the texts say: number of the text, place, clause, kind, subject and value, written down by hand.
_STATED = [
    (0, 0, "I don't mind cobbles", "surface", "cobblestone", "ok"), (0, 1, "love cycle paths", "path-type", "Bike path", "prefer"),
    (1, 0, "avoid gravel", "surface", "gravel", "rough"), (1, 1, "prefer bike paths", "path-type", "Bike path", "prefer"), (1, 2, "not sure", None, None, None),
    (2, 0, "hate painted bike lanes", "path-type", "Painted bike lane", "avoid"), (2, 1, "setts are fine", "surface", "sett", "ok"),
    (3, 0, "never ride in mud", None, None, None), (3, 1, "like fine gravel", "surface", "fine_gravel", "ok"), (4, 0, "prefer the fahrradstraße", "path-type", "Fahrradstrasse", "prefer"),
]
_STATED_SQL = ", ".join(f"({n}, {at}, {', '.join(map(O.text, rest))})" for n, at, *rest in _STATED)


@query(f"SELECT n_nationkey AS id, \"at\", fragment, kind, subject, value FROM nation JOIN (VALUES {_STATED_SQL}) t(n, \"at\", fragment, kind, subject, value) ON n_nationkey % {len(TEXTS)} = n")
def preference_parse(spark, sf):
    """What riders' texts say, and the clauses that aren't understood."""
    texts = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("n_nationkey") % len(TEXTS) + 1).cast("int"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.posexplode(T.fragments(texts)).alias("at", "fragment"))
    return rows.select("id", "at", "fragment", *(c.alias(k) for k, c in T.preference(F.col("fragment")).items()))


@query("SELECT s_suppkey AS id, i AS idx, CASE i WHEN 0 THEN 38.5 WHEN 1 THEN 40.7 ELSE 43.252 END::DOUBLE AS lat, CASE i WHEN 0 THEN -120.2 WHEN 1 THEN -120.95 ELSE -126.453 END::DOUBLE AS lng FROM supplier, (SELECT unnest([0, 1, 2]) AS i)")
def polyline_decode(spark, sf):
    line = T.polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), 5)
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.posexplode(line).alias("idx", "p"))
    return rows.select("id", "idx", "p.lat", "p.lng")


# --- Further reports, lookups and sources ---


@query(f"WITH {O.CLS}, {O.LEGS}, t AS (SELECT highway, path_level, sum(metres) AS m FROM cls JOIN lengths USING (way_id) GROUP BY ALL) SELECT highway, path_level, round(m / sum(m) OVER (PARTITION BY highway), 6) AS share FROM t")
def level_mix(spark, sf):
    rows = classed(spark, sf).withColumn("m", geo.length(F.col("coords"))).groupBy("highway", "path_level").agg(F.sum("m").alias("m"))
    return rows.select("highway", "path_level", F.round(F.col("m") / F.sum("m").over(W.partitionBy("highway")), 6).alias("share"))


@query(f"WITH {O.WIDE}, h AS (SELECT *, greatest(client_pct, valhalla_pct, brouter_pct, google_pct) AS top FROM wide) SELECT city, mode, pair, " + ", ".join(f"round(CASE WHEN top > 0 THEN greatest(least({e}_pct / top, 1), 0) END, 6) AS {e}" for e in ENGINES) + " FROM h")
def bench_heatmap(spark, sf):
    """Each engine's share against the best of its row."""
    top = F.greatest(*(F.col(f"{e}_pct") for e in ENGINES))
    return wide(spark, sf).select("city", "mode", "pair", *(F.round(F.when(top > 0, F.greatest(F.least(F.col(f"{e}_pct") / top, F.lit(1.0)), F.lit(0.0))), 6).alias(e) for e in ENGINES))


@query("WITH l AS (SELECT o_custkey AS trip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS leg, o_totalprice AS km FROM orders), p AS (SELECT trip, leg, i AS idx, km FROM l, (SELECT unnest([0, 1, 2]) AS i)) SELECT trip, count(*) AS points, round(sum(km) FILTER (idx = 1), 2) AS km FROM p WHERE leg = 0 OR idx > 0 GROUP BY trip")
def multi_leg(spark, sf):
    """Trips over several legs; each leg but the first loses its first point."""
    leg = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("leg")
    legs = table(spark, sf, "orders").select(F.col("o_custkey").alias("trip"), leg, F.col("o_totalprice").alias("km"), F.explode(F.array(*map(F.lit, range(3)))).alias("idx"))
    return graph.legs_joined(legs).groupBy("trip").agg(F.count("*").alias("points"), F.round(F.sum(F.when(F.col("idx") == 1, F.col("km"))), 2).alias("km"))


@query("WITH q AS (SELECT n_nationkey AS id, left(n_name, 1 + n_nationkey % 3) AS q FROM nation), a AS (SELECT q.id, c_custkey AS hit FROM q JOIN customer ON c_mktsegment LIKE q || '%' WHERE length(q) >= 2), b AS (SELECT q.id, s_suppkey AS hit FROM q JOIN supplier ON s_nationkey = q.id WHERE length(q) >= 2 AND q.id NOT IN (SELECT id FROM a)) SELECT id, 'saved' AS source, hit FROM a UNION ALL SELECT id, 'other', hit FROM b")
def search_fallback(spark, sf):
    """Hits of the second source only for queries that the first has none for; queries under two characters have none."""
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.left("n_name", 1 + F.col("n_nationkey") % 3).alias("q")).where("length(q) >= 2")
    # Queries have two characters at least, so those are the key, and the prefix is tested after.
    named = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.left("c_mktsegment", F.lit(2)).alias("k"))
    first = asked.withColumn("k", F.left("q", F.lit(2))).join(named, "k").where(F.startswith("c_mktsegment", "q")).select("id", F.lit("saved").alias("source"), F.col("c_custkey").alias("hit"))
    rest = asked.join(first, "id", "left_anti").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("id"))
    return first.unionByName(rest.select("id", F.lit("other").alias("source"), F.col("s_suppkey").alias("hit")))


@query(
    f"""WITH f AS (SELECT DISTINCT o_custkey AS id, 52 + (o_custkey * 7919 % 100000) / 100000.0::DOUBLE AS lat, 13 + (o_custkey * 104729 % 100000) / 100000.0::DOUBLE AS lng FROM orders),
    g AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 3 THEN 52 + (c_custkey * 7919 % 100000) / 100000.0::DOUBLE + (c_custkey % 23) / 10000.0::DOUBLE END AS glat, 13 + (c_custkey * 104729 % 100000) / 100000.0::DOUBLE AS glng FROM customer WHERE c_custkey % 7 <> 0),
    d AS (SELECT f.id, g.id IS NOT NULL AS asked, glat IS NOT NULL AS known, {O.haversine('lat', 'lng', 'glat', 'glng')} AS m FROM f LEFT JOIN g USING (id))
    SELECT id, CASE WHEN NOT asked THEN 'skipped' WHEN NOT known THEN 'no-match' WHEN m >= 150 THEN 'error' WHEN m >= 50 THEN 'warn' ELSE 'ok' END AS severity, round(CASE WHEN known THEN m END, 2) AS metres FROM d"""
)
def fixture_verify(spark, sf):
    """How far the places that routes are asked between are from where they were geocoded: 150 m are an error, 50 m a warning."""
    at = lambda k: ((52 + k * 7919 % 100000 / 100000).alias("lat"), (13 + k * 104729 % 100000 / 100000).alias("lng"))
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), *at(F.col("o_custkey")))
    k = F.col("c_custkey")
    lat, lng = at(k)
    coded = table(spark, sf, "customer").where(k % 7 != 0).select(k.alias("id"), F.when(k % 10 != 3, lat + k % 23 / 10000).alias("lat"), lng)
    return tables.verified(used, coded).withColumn("metres", F.round("metres", 2))


@query(f"WITH {_CACHE}, r AS (SELECT key, {_NOW} - fetched_at AS age, row_number() OVER (PARTITION BY key % 500 ORDER BY key) AS nth FROM cache) SELECT key, age <= 2592000000 AS served, age >= 604800000 AND nth = 1 AS refreshed FROM r")
def cache_swr(spark, sf):
    """Stale tiles are served and refreshed once a session."""
    age = F.lit(_NOW) - F.col("fetched_at")
    rows = cache(spark, sf).withColumn("session", F.col("key") % 500)
    first = rows.groupBy("session").agg(F.min("key").alias("first"))
    rows = rows.join(first, "session")
    return rows.select("key", (age <= 30 * tables.DAY_MS).alias("served"), ((age >= 7 * tables.DAY_MS) & (F.col("key") == F.col("first"))).alias("refreshed"))


@query("WITH l AS (SELECT o_orderkey AS id, 'm' || (o_custkey % 5) AS travel_mode, ['client', 'valhalla', 'brouter'][CAST(o_orderkey % 3 AS INT) + 1] AS engine, o_totalprice / 1000 AS km, epoch_ms(o_orderdate)::BIGINT AS ts FROM orders) SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, travel_mode, engine, count(*) AS routes, round(sum(km), 3) AS km FROM l GROUP BY ALL")
def route_log(spark, sf):
    """The log of routes, appended to and read back by day."""
    o = table(spark, sf, "orders")
    engine = F.element_at(F.array(*map(F.lit, ENGINES[:3])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("travel_mode"), engine.alias("engine"), (F.col("o_totalprice") / 1000).alias("km"))
    return rows.groupBy("day", "travel_mode", "engine").agg(F.count("*").alias("routes"), F.round(F.sum("km"), 3).alias("km"))


@query("SELECT event_id, floor(value * 10000 + 0.5) / 10000 AS cell, (360 - event_id % 360) % 360 AS heading, event_id % 4 = 0 AS gps FROM events")
def quantised(spark, sf):
    """Cache keys at four decimals, halves up; compass headings run the other way round."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", (geo.half_up(F.col("value") * 10000) / 10000).alias("cell"), F.pmod(F.lit(360) - e % 360, F.lit(360)).alias("heading"), (e % 4 == 0).alias("gps"))


@query(f"WITH {O.WAYS}, t AS (SELECT DISTINCT CAST(floor(lat / 0.002::DOUBLE) AS INT) AS r, CAST(floor(lng / 0.002::DOUBLE) AS INT) AS c FROM pts) SELECT r AS tile_row, c AS tile_col FROM t ORDER BY md5(r || ':' || c || ':42'), r, c LIMIT 20")
def tile_sample(spark, sf):
    """Twenty of the small tiles that ways lie on, the same ones each time: the feature is the size of the sample."""
    grid = src.way_points(src.ways(spark, sf)).select(geo.tile(F.col("lat"), 0.002).alias("tile_row"), geo.tile(F.col("lng"), 0.002).alias("tile_col")).distinct()
    return grid.orderBy(F.md5(F.concat_ws(":", "tile_row", "tile_col", F.lit("42")).cast("binary")), "tile_row", "tile_col").limit(20)


@query(f"WITH {O.WAYS} SELECT way_id, idx, round(lat, 5) AS lat, round(lng, 5) AS lng FROM pts")
def polyline_round_trip(spark, sf):
    """All ways' vertices, encoded as polylines and decoded."""
    lines = src.ways(spark, sf).select("way_id", T.polyline_of(F.col("coords")).alias("line"))
    return lines.select("way_id", F.posexplode(T.polyline(F.col("line"))).alias("idx", "v")).select("way_id", "idx", F.round("v.lat", 5).alias("lat"), F.round("v.lng", 5).alias("lng"))


@query(
    f"""WITH {O.WAYS}, a AS (SELECT way_id, lat AS la, lng AS ga FROM pts WHERE idx = 0), z AS (SELECT way_id, lat AS lz, lng AS gz FROM pts WHERE idx = {O.POINTS - 1}),
    far AS (SELECT way_id, max(abs((lz - la) * (ga - lng) - (la - lat) * (gz - ga)) / sqrt(pow(lz - la, 2) + pow(gz - ga, 2))) AS off FROM pts JOIN a USING (way_id) JOIN z USING (way_id) GROUP BY way_id)
    SELECT way_id, {O.POINTS} AS n, CASE WHEN off <= 360.0::DOUBLE / (8192 * 256) * 1.5 THEN 2 END AS n_simple FROM far"""
)
def simplify_path(spark, sf):
    """Ways with fewer vertices for a zoom."""
    from lanecraft.operators import simplify

    return simplify.simplified(src.ways(spark, sf).select("way_id", "coords"), 13).select("way_id", F.size("coords").alias("n"), F.size("simple").alias("n_simple"))


@query(
    f"""WITH RECURSIVE {O.WAYS}, bent AS (SELECT way_id, k, lat + ((way_id * 7 + k * k * 3) % 9 - 4) / 5000.0::DOUBLE AS y, lng + ((way_id * 5 + k * k * 7) % 9 - 4) / 5000.0::DOUBLE AS x FROM (SELECT way_id, idx AS k, lat, lng FROM pts)),
    cut(way_id, a, b) AS (
        SELECT DISTINCT way_id, 0, {O.POINTS - 1} FROM ways
        UNION ALL
        SELECT way_id, unnest([a, worst]), unnest([worst, b]) FROM (
            SELECT way_id, a, b, arg_max(k, (far, -k)) AS worst, max(far) AS far FROM (
                SELECT way_id, a, b, k, pow(m.y - p.y - t * (q.y - p.y), 2) + pow(m.x - p.x - t * (q.x - p.x), 2) AS far FROM (
                    SELECT c.way_id, c.a, c.b, m.k, m, p, q, greatest(0.0, least(1.0, coalesce(((m.y - p.y) * (q.y - p.y) + (m.x - p.x) * (q.x - p.x)) / nullif(pow(q.y - p.y, 2) + pow(q.x - p.x, 2), 0), 0.0))) AS t
                    FROM cut c JOIN bent p ON p.way_id = c.way_id AND p.k = c.a JOIN bent q ON q.way_id = c.way_id AND q.k = c.b JOIN bent m ON m.way_id = c.way_id AND m.k > c.a AND m.k < c.b))
            GROUP BY way_id, a, b) WHERE far > pow(360.0::DOUBLE / (4096 * 256) * 1.5, 2))
    SELECT way_id, count(DISTINCT v) AS n_simple, sum(DISTINCT v)::BIGINT AS places FROM (SELECT way_id, unnest([a, b]) AS v FROM cut) GROUP BY way_id"""
)
def simplify_bends(spark, sf):
    """Ways that bend, each differently, with fewer vertices for a zoom: how many stay, and the sum of their places."""
    from lanecraft.operators import simplify

    p = F.col("way_id")
    bend = lambda c, a, b: lambda v, k: v[c] + ((p * a + k * k * b) % 9 - 4) / 5000.0
    lat, lng = bend("lat", 7, 3), bend("lng", 5, 7)
    bent = src.ways(spark, sf).select("way_id", F.transform("coords", lambda v, k: F.struct(lat(v, k).alias("lat"), lng(v, k).alias("lng"))).alias("coords"))
    found = simplify.simplified(bent, 12)
    places = F.filter(F.sequence(F.lit(0), F.size("coords") - 1), lambda k: F.array_contains("simple", F.get("coords", k)))
    return found.select("way_id", F.size("simple").cast("long").alias("n_simple"), F.aggregate(places, F.lit(0).cast("long"), lambda s, k: s + k).alias("places"))


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id AS client, event_id, {_MS} AS ts, event_id % 9 = 0 AS refused, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    st(client, i, event_id, sent, until) AS (
        SELECT DISTINCT client, 0::BIGINT, NULL::BIGINT, false, -1::BIGINT FROM r
        UNION ALL
        SELECT r.client, r.i, r.event_id, r.ts >= s.until, CASE WHEN r.ts >= s.until AND r.refused THEN r.ts + 60000 ELSE s.until END FROM st s JOIN r ON r.client = s.client AND r.i = s.i + 1)
    SELECT client, event_id, sent FROM st WHERE i > 0"""
)
def image_cooldown(spark, sf):
    """Requests that a rate limit lets through: after a refusal none for a minute."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("client"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 9 == 0).alias("refused"))
    return navigation.cooled(rows)


@query(f"WITH {O.WAYS}, {O.PINGS}, s AS (SELECT route, idx, lat, lng FROM pings ), m AS (SELECT s.route, v.way_id, s.idx, min(abs(v.lat - s.lat) + abs(v.lng - s.lng)) AS far FROM s JOIN pts v ON abs(v.lat - s.lat) < 0.002 AND abs(v.lng - s.lng) < 0.002 GROUP BY ALL), t AS (SELECT route, way_id, count(*) AS hits, round(sum(far), 9) AS far FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY hits DESC, far, way_id) AS nth FROM t) SELECT route, way_id, hits FROM r WHERE nth = 1")
def segment_nearest_way(spark, sf):
    """The way that the points of a route are nearest to in sum, of those near most of them."""
    return spatial.way_of_segment(pings(spark, sf), src.way_points(src.ways(spark, sf)), 0.002)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The points of each segment of each trip; a segment after the first begins with the last point of the one before."""
    w = W.partitionBy("route").orderBy("idx")
    kind = F.when(F.col("is_walking"), "#walk").otherwise(F.col("item"))
    keyed = pings(spark, sf).withColumn("_kind", kind)
    placed = segments.islands(keyed, "route", "idx", F.col("_kind").eqNullSafe(F.lag("_kind").over(w)))
    before = placed.withColumns({c: F.lag(c).over(w) for c in ("lat", "lng")} | {"_fresh": (F.col("seg") > 0) & (F.lag("seg").over(w) != F.col("seg"))})
    first = before.where("_fresh").select("route", "seg", (F.col("idx") - 0.5).alias("idx"), "lat", "lng")
    return placed.select("route", "seg", F.col("idx").cast("double").alias("idx"), "lat", "lng").unionByName(first)


@query()
def segment_way(spark, sf):
    """The way that each segment of each trip lies along: the least sum of distances from five samples."""
    samples = spatial.sampled(_lines(spark, sf), ["route", "seg"], "idx").checkpoint()
    return spatial.way_of_line(samples, src.way_points(src.ways(spark, sf)), ["route", "seg"])


@query(f"WITH {O.CLS} SELECT item, path_level, CASE path_level WHEN '1a' THEN 4 WHEN '1b' THEN 4 WHEN '2a' THEN 3 WHEN '2b' THEN 3 ELSE 2 END AS tier, greatest(2, floor(4 * CASE path_level WHEN '1a' THEN 1.0 WHEN '1b' THEN 0.9 WHEN '2a' THEN 0.8 WHEN '2b' THEN 0.6 ELSE 0.4 END * 0.8 + 0.5))::BIGINT AS width, count(*) AS ways FROM cls GROUP BY ALL")
def overlay_style(spark, sf):
    """Line widths of the overlay by tier."""
    level = F.col("path_level")
    tier = F.when(level.isin("1a", "1b"), 4).when(level.isin("2a", "2b"), 3).otherwise(2)
    weight = F.when(level == "1a", 1.0).when(level == "1b", 0.9).when(level == "2a", 0.8).when(level == "2b", 0.6).otherwise(0.4)
    width = F.greatest(F.lit(2), geo.half_up(weight * 4 * 0.8)).cast("long")
    return classed(spark, sf).groupBy("item", "path_level").agg(F.count("*").alias("ways")).select("item", "path_level", tier.alias("tier"), width.alias("width"), "ways")
