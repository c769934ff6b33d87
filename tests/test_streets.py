"""Classification, modes and text functions on small literal tables."""

import pytest
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets, text
from lanecraft.operators import graph, segments, spatial, tables
from lanecraft.sources import dims, ways

MAP = streets.of_map("tags")


def classed(spark, tags):
    rows = [(i, t) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, "way_id long, tags map<string,string>")
    return [r.asDict() for r in graph.with_class(df, MAP).orderBy("way_id").collect()]


@pytest.mark.parametrize(
    "tags, lts, level, item",
    [
        ({"highway": "cycleway"}, 1, "1a", "Bike path"),
        ({"highway": "path", "bicycle": "no"}, 1, "2b", "Quiet street"),
        ({"highway": "footway", "bicycle": "yes"}, 1, "1a", "Shared use path"),
        ({"highway": "footway"}, 3, "3", "Major road"),
        ({"highway": "tertiary"}, 2, "2b", "Quiet street"),
        ({"highway": "tertiary", "maxspeed": "30"}, 2, "2b", "Quiet street"),
        ({"highway": "tertiary", "maxspeed": "50"}, 3, "3", "Major road"),
        ({"highway": "tertiary", "maxspeed": "60"}, 4, "4", None),
        ({"highway": "tertiary", "maxspeed": "walk"}, 4, "4", None),
        ({"highway": "residential", "maxspeed": "30 mph"}, 1, "2b", "Quiet street"),
        ({"highway": "residential", "maxspeed": "50", "lanes": "4"}, 3, "3", "Major road"),
        ({"highway": "residential", "motor_vehicle": "destination"}, 1, "1b", "Bike boulevard"),
        ({"highway": "residential", "bicycle_road": "yes"}, 1, "1b", "Fahrradstrasse"),
        ({"highway": "secondary", "cycleway": "track", "maxspeed": "50"}, 1, "1a", "Elevated sidewalk path"),
        ({"highway": "secondary", "cycleway": "no", "cycleway:right": "track"}, 4, "4", None),
        ({"highway": "tertiary", "maxspeed": "30", "cycleway:left": "lane"}, 2, "2b", "Quiet street"),
        ({"highway": "tertiary", "maxspeed": "30", "cycleway": "lane"}, 2, "2a", "Painted bike lane on quiet street"),
        ({"highway": "secondary", "access": "no"}, 4, "4", None),
        ({"highway": "motorway"}, 3, "3", "Major road"),
    ],
)
def test_classification(spark, tags, lts, level, item):
    (row,) = classed(spark, [tags])
    assert (row["lts"], row["path_level"], row["item"]) == (lts, level, item)


def test_derived_ways_reach_every_level_and_item(spark):
    found = graph.with_class(ways.ways(spark, "/root/testdata/sf0.01")).select("path_level", "item").distinct().collect()
    assert {r["path_level"] for r in found} == {"1a", "1b", "2a", "2b", "3", "4"}
    assert {r["item"] for r in found} == {*dims.ITEMS, None}


def test_modes_ride_walk_or_reject(spark):
    df = spark.createDataFrame([(1, {"highway": "residential", "maxspeed": "30"}), (2, {"highway": "cycleway", "surface": "sett"}), (3, {"highway": "cycleway", "smoothness": "bad"})], "way_id long, tags map<string,string>")
    rows = {(r["way_id"], r["mode"]): r for r in graph.decided(graph.with_class(df, MAP), dims.modes(spark)).collect()}
    assert [rows[1, m[0]]["accepted_"] for m in dims.MODES] == [False, False, True, True, True]
    assert rows[2, "kid-starting-out"]["walks"] and rows[2, "kid-starting-out"]["mult"] == 5.0
    assert rows[2, "kid-confident"]["kmh"] == 5.0 and rows[2, "training"]["reason"] == "cobbles"
    assert rows[3, "training"]["mult"] == 5.0


def meridian(n, lng=13.4):
    return [(52.5 + k / 1000, lng) for k in range(n)]


def edges_of(spark, rows, mode="kid-starting-out", **options):
    df = spark.createDataFrame(rows, "way_id long, tags map<string,string>, coords array<struct<lat:double,lng:double>>")
    decided = graph.decided(graph.with_class(df, MAP), dims.modes(spark).where(F.col("mode") == mode))
    return graph.edges(decided, F.col("item").isin(dims.preferred(mode)), t=MAP, **options)


def test_graph_has_four_nodes_and_six_edges(spark):
    rows = [(1, {"highway": "cycleway"}, meridian(3)), (2, {"highway": "residential"}, [(52.501, 13.4), (52.501, 13.401)])]
    found = edges_of(spark, rows)
    assert (found.count(), graph.nodes(found).count()) == (6, 4)
    walking = {r["way_id"]: r["is_walking"] for r in found.collect()}
    assert walking == {1: False, 2: True}


@pytest.mark.parametrize("tags, n", [({"oneway": "yes"}, 1), ({"oneway": "yes", "oneway:bicycle": "no"}, 2), ({}, 2)])
def test_one_way(spark, tags, n):
    assert edges_of(spark, [(1, {"highway": "cycleway"} | tags, meridian(2))]).count() == n


def test_hard_rejects_have_no_edges(spark):
    assert edges_of(spark, [(1, {"highway": "motorway"}, meridian(2)), (2, {"highway": "primary", "sidewalk": "no"}, meridian(2))]).count() == 0


@pytest.mark.parametrize("rise, walks", [(30.0, True), (2.0, False), (None, False)])
def test_gradient(spark, rise, walks):
    up = (F.lit(0.0), F.lit(rise).cast("double"))
    rows = edges_of(spark, [(1, {"highway": "cycleway"}, [(52.5, 13.4), (52.5018, 13.4)])], elevation=up).collect()
    assert {r["is_walking"] for r in rows} == {walks}


def test_last_edge_wins_and_paths_are_cheapest(spark):
    rows = [(1, {"highway": "cycleway"}, meridian(3)), (2, {"highway": "cycleway"}, [(52.5, 13.4), (52.501, 13.41), (52.502, 13.4)]), (3, {"highway": "footway"}, meridian(2))]
    found = graph.last_edges(edges_of(spark, rows))
    assert {r["way_id"] for r in found.where("is_walking").collect()} == {3}
    start, goal = found.agg(F.min("src"), F.max("src")).first()
    pairs = spark.createDataFrame([("kid-starting-out", 0, 7, start, goal), ("kid-starting-out", 0, 8, start, 5)], "mode string, region long, pair long, src long, dst long")
    path = graph.routes(found.withColumn("region", F.lit(0).cast("long")), pairs).orderBy("idx").collect()
    # walking the first leg takes longer than the way around
    assert [r["pair"] for r in path] == [7] * len(path) and len(path) == 3
    assert graph.reachable(found, spark.createDataFrame([("kid-starting-out", start)], "mode string, node long")).count() == 4


def test_shortest_paths_agree_with_relaxation(spark):
    import random

    draw = random.Random(3)
    links = [(a, b, draw.random()) for a in range(30) for b in draw.sample(range(30), 3) if a != b]
    cost = {0: 0.0}
    for _ in range(30):
        for a, b, c in links:
            if a in cost and cost[a] + c < cost.get(b, 9e9):
                cost[b] = cost[a] + c
    df = spark.createDataFrame([("m", 0, a, b, c) for a, b, c in links], "mode string, region long, src long, dst long, cost double")
    pairs = spark.createDataFrame([("m", 0, n, 0, n) for n in range(30)], "mode string, region long, pair long, src long, dst long")
    found = graph.routes(df, pairs).groupBy("pair").agg(F.max("cost").alias("c")).collect()
    assert {r["pair"]: round(r["c"], 9) for r in found} == {n: round(c, 9) for n, c in cost.items()}


def test_healing_and_quality(spark):
    names = ["Bike path"] * 3 + ["Major road"] * 2 + ["Bike path"] * 3 + [None] * 7 + ["Bike path"] * 2
    rows = [(1, i, 52.5 + i / 1000, 13.4, n, False) for i, n in enumerate(names)] + [(2, 0, 52.5, 13.4, None, False)]
    points = spark.createDataFrame(rows, "route long, idx long, lat double, lng double, item string, is_walking boolean")
    good = F.coalesce(F.col("item").isin("Bike path"), F.lit(False))
    found = segments.healed(segments.segments(points), good)
    one = [(r["item"], r["n_coords"]) for r in found.where("route = 1").orderBy("seg").collect()]
    assert one == [("Bike path", 3), ("Bike path", 3), ("Bike path", 4), (None, 8), ("Bike path", 3)]
    shares = {r["route"]: r for r in segments.quality(found, good).collect()}
    assert abs(sum(shares[1][c] for c in ("preferred", "other", "walking")) - 1) < 1e-9
    assert shares[2]["preferred"] == shares[2]["other"] == 0
    again = segments.healed(found, good)
    assert again.where("healed").count() == 0


def test_tiles_and_terrain(spark):
    row = spark.range(1).select(geo.tile(F.lit(52.52)), geo.tile(F.lit(13.405)), geo.tile(F.lit(52.5)), geo.tile(F.lit(-122.42)), geo.terrain_metres(F.lit(1), F.lit(134), F.lit(160)), geo.terrain_metres(F.lit(1), F.lit(142), F.lit(112))).first()
    assert tuple(row)[:4] == (525, 134, 525, -1225)
    assert abs(row[4]) < 1 and abs(row[5] - 200) < 1


def test_region_rules(spark):
    df = spark.createDataFrame([(1, {"highway": "tertiary", "name": "Oranienstraße"}), (2, {"highway": "secondary", "name": "am LANDWEHRKANAL"})], "way_id long, tags map<string,string>")
    rows = graph.with_class(df, MAP)
    out = streets.overlaid({c: F.col(c) for c in ("lts", "car_free", "bike_priority", "bike_infra", "surface_", "path_level", "speed_kmh")}, F.col("tags")["name"], MAP, F.lit(52.52), F.lit(13.4), dims.BERLIN)
    found = [tuple(r) for r in rows.select("way_id", out["lts"], out["car_free"], out["surface_"], out["path_level"]).orderBy("way_id").collect()]
    assert found == [(1, 3, False, "cobblestone", "2b"), (2, 1, True, "cobblestone", "4")]


def test_text(spark):
    row = spark.range(1).select(
        text.distance_label(F.lit(0.42)), text.distance_label(F.lit(3.14)), text.duration_label(F.lit(3720)), text.duration_label(F.lit(59)), text.slug(F.lit("  Ab & Cd!")), text.polyline(F.lit("")), text.escape_html(F.lit('<a & "b">'))
    ).first()
    assert tuple(row) == ("420 m", "3.1 km", "1h 2m", "0 min", "ab-cd", [], "&lt;a &amp; &quot;b&quot;&gt;")


def test_preferences(spark):
    rows = [("I don't mind cobbles",), ("don't hate cobbles",), ("avoid gravel",), ("prefer the bike paths",), ("hate painted bike lanes",), ("setts are fine",), ("hello",)]
    df = spark.createDataFrame(rows, "f string")
    found = [tuple(r) for r in df.select(*(c.alias(k) for k, c in text.preference(F.col("f")).items())).collect()]
    assert found == [("surface", "cobblestone", "ok"), (None,) * 3, ("surface", "gravel", "rough"), ("path-type", "Bike path", "prefer"), ("path-type", "Painted bike lane", "avoid"), ("surface", "sett", "ok"), (None,) * 3]
    parts = spark.range(1).select(text.fragments(F.lit("avoid gravel but love setts, then x. y"))).first()[0]
    assert parts == ["avoid gravel", "love setts", "then x", "y"]


def test_cache_expires_strictly_then_evicts_the_longest_unused(spark):
    now, day = 1_700_000_000_000, tables.DAY_MS
    rows = [(1, 1, now - 30 * day, 5), (2, 2, now - 30 * day - 1, 9), (3, 3, now, 1), (4, 4, now, 1)]
    cache = spark.createDataFrame(rows, "key long, ord long, fetched_at long, last_accessed long")
    assert {(r["key"], r["why"]) for r in tables.evicted(cache, now, 2).collect()} == {(2, "expired"), (3, "unused")}


def test_eviction_keeps_the_newest_without_sorting_the_rest(spark):
    now = 1_700_000_000_000
    rows = [(i, i, now, None if i % 50 == 0 else i * 7919 % 90) for i in range(500)]
    cache = spark.createDataFrame(rows, "key long, ord long, fetched_at long, last_accessed long")
    order = [r[0] for r in sorted(rows, key=lambda r: (-1 if r[3] is None else r[3], r[1]))]
    for most in (0, 1, 20, 495, 500, 600):
        found = tables.evicted(cache, now, most)
        assert "TakeOrdered" not in found._jdf.queryExecution().toString()
        assert sorted(r["key"] for r in found.collect()) == sorted(order[: max(500 - most, 0)])


def test_a_scan_of_many_tiles_is_whole(spark, tmp_path):
    lines = spark.createDataFrame([(1, [(52.05, 13.05)]), (2, [(53.05, 13.05)])], "way_id long, coords array<struct<lat:double,lng:double>>")
    ways.write_tiles(lines, str(tmp_path / "tiles"))
    asked = spark.range(10_020, numPartitions=1).select(F.lit(130).alias("tile_col"), (F.col("id") - 9_500).cast("int").alias("tile_row"))
    asked = asked.where("tile_row <> 520").unionByName(spark.range(3).select(F.lit(130).alias("tile_col"), F.lit(520).alias("tile_row"))).coalesce(1)
    assert sorted(r["way_id"] for r in ways.read_tiles(spark, str(tmp_path / "tiles"), asked).collect()) == [1]


def test_places_apart(spark):
    rest = spark.createDataFrame([(1, 52.5, 13.4), (2, 52.5004, 13.4004), (3, None, None), (4, 52.501, 13.4)], "id long, lat double, lng double")
    assert {r["id"] for r in spatial.apart_from(rest, rest.where("id = 1"), 0.0005).collect()} == {3, 4}


def test_osm_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"elements": [{"type": "way", "id": 5, "geometry": [{"lat": 1.0, "lon": 2.0}]}, {"type": "node", "id": 6}]}')
    (row,) = ways.read_osm_json(spark, str(path)).collect()
    assert (row["way_id"], row["tags"], row["coords"][0]["lng"]) == (5, {}, 2.0)


def test_history_skips_bad_lines(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text('{"date": "2026-01-01", "samples": 3}\nnot json\n{"date": "2026-01-02", "google": 0.5}\n')
    assert ways.read_history(spark, str(path)).count() == 2
