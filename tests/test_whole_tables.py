"""Street queries over whole tables against brute force."""

import math

from pyspark.sql import functions as F

from lanecraft.plans import catalog
from lanecraft.sources import ways as src

SF = "/root/testdata/sf0.001"


def metres(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_every_position_is_snapped(spark):
    links = catalog.all_edges(spark, SF).where(F.col("mode") == catalog.MODE)
    nodes = {tuple(r) for r in links.select("src_point.lat", "src_point.lng").distinct().collect()}
    points = catalog.pings(spark, SF).collect()
    got = {r["point"]: r["metres"] for r in catalog.QUERIES["snap_start_all"](spark, SF).collect()}
    assert len(got) == len(points) > 200
    nearest = {}
    for p in points:
        at = p["lat"], p["lng"]
        if at not in nearest:
            nearest[at] = min(metres(*at, *n) for n in nodes)
        want = nearest[at] if nearest[at] <= 1000 else None
        assert got[p["event_id"]] is None if want is None else abs(got[p["event_id"]] - want) < 0.002


def test_ways_near_any_route_are_suggested(spark):
    points = {(r["lat"], r["lng"]) for r in catalog.pings(spark, SF).collect()}
    vertices = src.way_points(catalog.classed(spark, SF).where(catalog.liked())).collect()
    near = lambda v: any(abs(v["lat"] - a) < 0.005 and abs(v["lng"] - b) < 0.005 for a, b in points)
    want = {v["way_id"] for v in vertices if near(v)}
    got = [r["way_id"] for r in catalog.QUERIES["route_suggestions_all"](spark, SF).collect()]
    assert want and sorted(got) == sorted(want)


def test_reachable_set_leaves_a_region(spark, monkeypatch):
    nodes = [catalog._START + k * src.LAT_STEP * 40 * 100_000_000 for k in range(4)]
    links = spark.createDataFrame([(catalog.MODE, a, b) for a, b in zip(nodes, nodes[1:], strict=False)], "mode string, src long, dst long")
    monkeypatch.setattr(catalog, "all_edges", lambda *_: links)
    assert catalog.QUERIES["reachable_set"](spark, SF).first()["nodes"] == 4
