"""Whole requests, readers and sinks, and what is asked of a route."""

import json

import pytest
from pyspark.sql import functions as F

from lanecraft.functions import streets, text
from lanecraft.operators import route, segments, simplify, spatial, tables
from lanecraft.sources import dims, ways

MAP = streets.of_map("tags")
WAYS = "way_id long, tags map<string,string>, coords array<struct<lat:double,lng:double>>"
ASKED = "route long, mode string, lat1 double, lng1 double, lat2 double, lng2 double"


def line(*points):
    return [{"lat": a, "lng": b} for a, b in points]


def liked():
    return F.coalesce(F.col("item").isin(dims.preferred("kid-confident")), F.lit(False))


def routed(spark, rows, asked):
    found, _ = route.client_routes(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, WAYS), dims.modes(spark), liked(), t=MAP)
    return {r["route"]: r for r in found.collect()}


def test_a_request_end_to_end(spark):
    rows = [
        (1, {"highway": "cycleway"}, line((52.500, 13.400), (52.501, 13.400), (52.502, 13.400))),
        (2, {"highway": "footway"}, line((52.502, 13.400), (52.503, 13.400))),
        (3, {"highway": "cycleway", "oneway": "yes"}, line((52.620, 13.400), (52.621, 13.400))),
        (4, {"highway": "motorway"}, line((52.500, 13.400), (52.503, 13.400))),
    ]
    near, far = (52.5001, 13.4001), (52.5031, 13.4)
    asked = [(1, "kid-confident", *near, *far), (2, "kid-confident", *near, 52.62, 13.4), (3, "kid-confident", 10.0, 10.0, *far), (4, "kid-confident", *far, *near), (5, "training", *near, 52.502, 13.4)]
    got = routed(spark, rows, asked)
    assert [got[i]["found"] for i in (1, 2, 3, 4, 5)] == [True, False, False, True, True]
    assert abs(got[1]["km"] - 0.3336) < 0.001 and 0 < got[1]["walking"] < 1 and got[1]["segments"] == 3  # the first point has no item
    assert abs(got[1]["walking"] - 1 / 3) < 0.01 and abs(got[1]["preferred"] - 2 / 3) < 0.01
    # 222 m at 10 km/h, then 111 m on foot at 2 km/h.
    assert abs(got[1]["seconds"] - (0.2224 / 10 + 0.1112 / 2) * 3600) < 1
    assert abs(got[4]["km"] - got[1]["km"]) < 1e-9
    assert got[2]["km"] is None and got[3]["segments"] is None


def test_a_cheaper_way_is_taken(spark):
    ends = (52.5, 13.4), (52.5, 13.402)
    rows = [(1, {"highway": "cycleway"}, line(ends[0], (52.5005, 13.401), ends[1])), (2, {"highway": "residential", "maxspeed": "50", "lanes": "4"}, line(*ends))]
    got = routed(spark, rows, [(1, "kid-confident", *ends[0], *ends[1])])[1]
    assert got["preferred"] == 1 and got["walking"] == 0


def test_an_unknown_mode_has_the_default_rule(spark):
    asked = spark.createDataFrame([(1, "training"), (2, "no such mode"), (3, None)], "id long, asked string")
    got = {r["id"]: (r["mode"], r["ride_kmh"]) for r in dims.with_rule(asked, "asked", dims.modes(spark)).collect()}
    assert got == {1: ("training", 30.0), 2: ("kid-starting-out", 5.0), 3: ("kid-starting-out", 5.0)}


def test_healed_segments_take_the_level_too(spark):
    rows = [(1, i, 52.5 + i * 1e-4, 13.4, item, False, level) for i, (item, level) in enumerate([("Bike path", "1a")] * 3 + [("Major road", "3")] * 2 + [("Bike path", "1a")] * 3)]
    points = spark.createDataFrame(rows, "route long, idx int, lat double, lng double, item string, is_walking boolean, path_level string")
    good = F.col("item") == "Bike path"
    got = segments.healed(segments.segments(points), good).orderBy("seg").collect()
    assert [(r["item"], r["path_level"], r["healed"]) for r in got] == [("Bike path", "1a", False), ("Bike path", "1a", True), ("Bike path", "1a", False)]


def test_icons_are_parted_by_items_and_by_gaps_between_segments(spark):
    p = lambda lat: {"lat": lat, "lng": 13.4}
    rows = [(1, 0, "a", p(52.5), p(52.6)), (1, 1, "a", p(52.6001), p(52.7)), (1, 2, "a", p(52.7004), p(52.8)), (1, 3, "b", p(52.8), p(52.9)), (1, 4, None, p(52.9), p(53.0)), (1, 5, None, p(53.0), p(53.1))]
    df = spark.createDataFrame(rows, "route long, seg long, item string, start struct<lat:double,lng:double>, stop struct<lat:double,lng:double>")
    assert [r["run"] for r in segments.coalesced(df).orderBy("seg").collect()] == [0, 0, 1, 2, 3, 3]


@pytest.mark.parametrize(
    "raw, stated",
    [
        ("cobbles are fine", [("surface", "cobblestone", "ok")]), ("cobblestones are no problem", [("surface", "cobblestone", "ok")]), ("gravel = okay", [("surface", "gravel", "ok")]),
        ("I don't mind paving stones", [("surface", "paving_stones", "ok")]), ("do not mind mud", [("surface", "mud", "ok")]), ("hate cobbles", [("surface", "cobblestone", "rough")]),
        ("avoid all the gravel", [("surface", "gravel", "rough")]), ("avoid really all the gravel", [None]), ("love the gravel", [None]), ("prefer Fahrradstraße", [("path-type", "Fahrradstrasse", "prefer")]),
        ("love bike paths", [("path-type", "Bike path", "prefer")]), ("avoid painted bike lanes", [("path-type", "Painted bike lane", "avoid")]), ("skip bus lane", [("path-type", "Shared bus lane", "avoid")]),
        ("cobbles are fine. avoid painted bike lanes.\nprefer Fahrradstraße", [("surface", "cobblestone", "ok"), ("path-type", "Painted bike lane", "avoid"), ("path-type", "Fahrradstrasse", "prefer")]),
        ("cobbles are fine. I hate potholes really much.", [("surface", "cobblestone", "ok"), None]), ("avoid gravel but love fine gravel", [("surface", "gravel", "rough"), ("surface", "fine_gravel", "ok")]),
        ("", []), (" ;. ", []), ("I don't hate cobbles", [None]), ("do not avoid cobbles", [None]), ("never ride painted lanes", [None]), ("fine, gravel 5,5 and mud", [None, None, None]),
    ],
)
def test_preference_texts(spark, raw, stated):
    rows = spark.createDataFrame([(raw,)], "raw string").select(F.posexplode(text.fragments(F.col("raw"))).alias("at", "fragment"))
    got = rows.select("at", *(c.alias(k) for k, c in text.preference(F.col("fragment")).items())).orderBy("at").collect()
    assert [None if r["kind"] is None else (r["kind"], r["subject"], r["value"]) for r in got] == stated


def test_simplified_paths_keep_what_shows():
    import numpy as np

    zigzag = np.array([[0, 0], [0, 1], [0.5, 2], [0, 3], [0, 4.0]])
    assert simplify.reduced(zigzag, 0.6).tolist() == [[0, 0], [0, 4]]
    assert simplify.reduced(zigzag, 0.1).tolist() == zigzag.tolist()
    assert simplify.reduced(np.zeros((5, 2)), 0.1).tolist() == [[0, 0], [0, 0]]


def test_runs_and_their_history(spark, tmp_path):
    samples = spark.createDataFrame([("berlin", "m", "a", "client", 1.0, 0.5), ("berlin", "m", "a", "google", 2.0, 0.25), ("sf", "m", "b", "client", 3.0, 1.0)], ways.SAMPLE)
    for version in ("v1", "v2", "v2"):
        ways.write_run(samples, str(tmp_path), version, "2026-01-01")
    assert ways.read_runs(spark, str(tmp_path)).groupBy("version").count().orderBy("version").collect() == [("v1", 3), ("v2", 3)]
    history = ways.newest_first(ways.read_history(spark, f"{tmp_path}/history")).collect()
    assert len(history) == 3 and {(r["samples"], r["clientPct"], r["google"], r["brouterPct"]) for r in history} == {(2, 0.75, 0.25, None)}
    summary = tables.run_summary(samples, ["client", "google"]).first()
    assert (summary["samples"], summary["client_pct"], summary["google_pct"], summary["flagged"]) == (2, 0.75, 0.25, 0)


def test_metrics_and_answers_of_other_routers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"city": "sf", "mode": "m", "pair": "a", "client": {"distanceKm": 2.5, "preferredPct": 0.5}, "google": None}]}, indent=1))
    row = ways.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (row["client_km"], row["client_pct"], row["google_km"], row["brouter_km"]) == (2.5, 0.5, None, None)
    answers = {
        "valhalla": {"trip": {"legs": [{"shape": "_izlhA~rlgdF"}], "summary": {"length": 1.5, "time": 60}}},
        "brouter": {"features": [{"geometry": {"coordinates": [[13.4, 52.5, 30.0]]}, "properties": {"track-length": "1500", "total-time": "60"}}]},
        "google": {"routes": [{"polyline": {"encodedPolyline": "_p~iF~ps|U_ulLnnqC"}, "distanceMeters": 1500, "duration": "60s"}]},
    }
    first = {"valhalla": (38.5, -120.2), "brouter": (52.5, 13.4), "google": (38.5, -120.2)}
    for engine, answer in answers.items():
        (tmp_path / f"{engine}.json").write_text(json.dumps(answer, indent=1))
        row = ways.read_external_routes(spark, str(tmp_path / f"{engine}.json"), engine).first()
        assert (row["file"], row["km"], row["seconds"]) == (f"{engine}.json", 1.5, 60.0)
        assert abs(row["coords"][0]["lat"] - first[engine][0]) < 1e-6 and abs(row["coords"][0]["lng"] - first[engine][1]) < 1e-6
    with pytest.raises(ValueError):
        ways.read_external_routes(spark, str(tmp_path), "other")


def test_scans_and_tiles_are_kept(spark, tmp_path):
    scan = spark.createDataFrame([(1, {"highway": "path"}, line((52.5, 13.4), (52.6, 13.4))), (2, {"highway": "path"}, line((10.0, 10.0), (10.1, 10.0)))], WAYS)
    for city, rows in (("berlin", scan), ("sf", scan.where("way_id = 2")), ("berlin", scan.where("way_id = 1"))):
        ways.save_scan(rows, str(tmp_path / "scans"), city)
    load = lambda city: [r["way_id"] for r in ways.load_scan(spark, str(tmp_path / "scans"), city).collect()]
    assert (load("berlin"), load("sf"), load("none")) == ([1], [2], [])
    ways.write_tiles(scan, str(tmp_path / "tiles"))
    tiles = spark.createDataFrame([(525, 134), (0, 0)], "tile_row int, tile_col int")
    assert [r["way_id"] for r in ways.read_tiles(spark, str(tmp_path / "tiles"), tiles).collect()] == [1]


def test_profiles_and_logs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "berlin.md").write_text("---\ncity: Berlin\nrules: a: b\n---\n# Berlin\n\nProse.\n")
    row = ways.read_profiles(spark, str(tmp_path / "p")).first()
    assert row["file"] == "berlin.md" and row["fields"] == {"city": "Berlin", "rules": "a: b"} and row["prose"] == "# Berlin\n\nProse."
    log = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, id long")
    ways.append_log(log, str(tmp_path / "log"))
    ways.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_preferences_are_deleted_and_activated(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, text string")
    left = tables.without(rows, spark.createDataFrame([("b",), ("b",), ("q",)], "name string"))
    assert {(r["name"], r["active"]) for r in tables.activated(left, "c").collect()} == {("a", False), ("c", True)}
    assert not any(r["active"] for r in tables.activated(left, None).collect())


def test_segments_find_their_way(spark):
    points = spark.createDataFrame([(1, i, 52.5 + i * 1e-4, 13.4) for i in range(5)], "route long, idx int, lat double, lng double")
    vertices = spark.createDataFrame([(7, 0, 52.5002, 13.4001), (8, 0, 52.5002, 13.4009)], "way_id long, idx int, lat double, lng double")
    assert [tuple(r) for r in spatial.way_of_segment(points, vertices).collect()] == [(1, 7, 5)]


def test_overrides_of_a_mode_win_over_those_of_all(spark):
    own = {"training": {"rough_mult": 2.0, "level_mult": {"2a": 3.0}, "ride_kmh": 25.0, "slow_kmh": 9.0, "walk_kmh": 4.5}, "carrying-kid": {"level_mult": {"2a": 1.0}}}
    got = {r["mode"]: r for r in dims.modes(spark, own, rough=7.0).collect()}
    assert (got["training"]["rough_mult"], got["training"]["level_mult"], got["training"]["ride_kmh"], got["training"]["slow_kmh"], got["training"]["walk_kmh"]) == (2.0, {"2a": 3.0}, 25.0, 9.0, 4.5)
    assert (got["carrying-kid"]["rough_mult"], got["carrying-kid"]["level_mult"], got["carrying-kid"]["ride_kmh"]) == (7.0, {"2a": 1.0, "2b": 1.2}, 20.0)
    assert {r["rough_mult"] for r in dims.modes(spark).collect()} == {5.0}


def test_polylines_of_points_are_read_back(spark):
    points = [[], [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], [(0.0, 0.0), (0.0, 0.0)], [(-90.0, 180.0), (90.0, -180.0)], None]
    rows = spark.createDataFrame([(k, None if p is None else [{"lat": a, "lng": b} for a, b in p]) for k, p in enumerate(points)], "k int, coords array<struct<lat:double,lng:double>>")
    got = {r["k"]: (r["line"], r["back"]) for r in rows.select("k", text.polyline_of(F.col("coords")).alias("line")).withColumn("back", text.polyline(F.col("line"))).collect()}
    assert got[1][0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and got[0] == ("", []) and got[4][0] is None
    for k in (1, 2, 3):
        assert [(r["lat"], r["lng"]) for r in got[k][1]] == points[k]
