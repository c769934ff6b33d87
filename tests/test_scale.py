"""What keeps a task, or the driver, from holding what grows with the tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanecraft.functions import streets
from lanecraft.operators import route, search, spatial
from lanecraft.plans import catalog, more
from lanecraft.sources import dims, terrain
from lanecraft.sources import ways as src


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A table of 24,000 parts in one small file."""
    at = str(tmp_path_factory.mktemp("many"))
    spark.range(24_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n")).collect()]


def test_ways_of_one_file_are_dealt_to_tasks(spark, many):
    held = sizes(src.ways(spark, many).select("way_id"))
    assert sum(held) == 24_000 and len(held) == 5 and max(held) < 2 * src.TOGETHER


def test_last_edges_are_dealt_by_pairs_of_nodes(spark, many):
    """Edges of a pair of nodes meet before they are aggregated, in as many tasks as ways need."""
    last = catalog.all_last_edges(spark, many)
    held = sizes(last.select("mode", "src"))
    assert len(held) == 5 and max(held) < sum(held) / 3
    first = catalog.graph.last_edges(catalog.all_edges(spark, many))
    assert catalog._sums(last).exceptAll(catalog._sums(first)).isEmpty()


def test_a_way_without_time_has_no_speed(spark):
    steps = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, False), (1, 1, 7, 0.0, 0.0, False), (1, 2, 8, 10.0, 2.0, False)], "route long, idx long, way_id long, dist double, cost double, is_walking boolean")
    got = {r["way_id"]: (r["kmh"], r["place"]) for r in route.ways_on_path(steps).collect()}
    assert math.isnan(got[7][0]) and got[7][1] == 1 and got[8] == (18.0, 2)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def grid(spark, n):
    """A way of one vertex on each point of a grid, in a table that Spark takes to be small."""
    rows = spark.range(n * n).select(F.col("id").alias("way_id"), F.lit(0).alias("idx"), (F.expr(f"id div {n}") / 1000).alias("lat"), (F.col("id") % n / 1000).alias("lng"))
    return rows


POINTS = "route long, idx long, lat double, lng double"


def test_vertices_are_not_broadcast(spark):
    """Ways and vertices are far larger than their files, so joins with them are by shuffle."""
    points = spark.createDataFrame([(1, 0, 0.0051, 0.0049), (1, 1, 0.0051, 0.0049), (1, 2, None, 0.0), (2, 0, 5.0, 5.0)], POINTS)
    for metric in ("euclid", "manhattan"):
        found = spatial.nearest_vertex(points, grid(spark, 20), metric=metric)
        assert "SortMergeJoin [row" in plan(found)
        assert sorted(tuple(r) for r in found.select("route", "idx", "way_id").collect()) == [(1, 0, 105), (1, 1, 105), (1, 2, None), (2, 0, None)]


def test_points_at_one_place_meet_vertices_once(spark):
    points = spark.range(900).select((F.col("id") % 9).alias("route"), F.expr("id div 9").alias("idx"), F.lit(0.0051).alias("lat"), (F.lit(0.0049) + F.col("id") % 3 / 1000).alias("lng"))
    assert spatial.places(points, 0.001).count() == 27
    got = sorted(tuple(r) for r in spatial.way_of_segment(points, grid(spark, 20)).collect())
    assert got == [(r, 105 + r % 3, 100) for r in range(9)]


def test_ways_of_a_route_meet_its_points_where_they_are(spark, monkeypatch):
    points = spark.range(900).select((F.col("id") % 9).alias("route"), F.expr("id div 9").alias("idx"), F.lit(0.0051).alias("lat"), (F.lit(0.0049) + F.col("id") % 3 / 1000).alias("lng"))
    few = spatial.way_of_segment(points, grid(spark, 20))
    ran = few._jdf.queryExecution().executedPlan().toString()
    assert ran.count("Exchange hashpartitioning(") == 1 and "BroadcastHashJoin" in ran  # the points are dealt once
    monkeypatch.setattr(spatial, "PAIRS", 0)
    many = spatial.way_of_segment(points, grid(spark, 20))
    assert "BroadcastHashJoin" not in plan(many) and sorted(many.collect()) == sorted(few.collect())


@pytest.mark.parametrize("held", [32_000_000, 100])
def test_lines_meet_ways_in_any_share(spark, monkeypatch, held):
    """Lines of few places, and of many, dealt to tasks in any number, have the way that brute force finds."""
    monkeypatch.setattr(spatial, "HELD", held)
    monkeypatch.setattr(spatial, "LINES", 20)
    draw = random.Random(3)
    vertices = [(w, draw.uniform(0, 0.3), draw.uniform(0, 0.3)) for w in range(60) for _ in range(3)]
    spots = [(draw.uniform(0, 0.3), draw.uniform(0, 0.3)) for _ in range(12)] + [(0.55, 0.55), (3.0, 3.0)]
    points = [(n, i, *draw.choice(spots)) for n in range(80) for i in range(draw.randint(1, 7))]
    samples = spatial.sampled(spark.createDataFrame(points, "line long, idx long, lat double, lng double"), ["line"], "idx")
    lines = {}
    for r in samples.collect():
        lines.setdefault(r["line"], []).append(r)
    found = spatial.way_of_line(samples, spark.createDataFrame(vertices, "way_id long, lat double, lng double"), ["line"])
    got = {r["line"]: (r["way_id"], r["far"]) for r in found.collect()}
    tile = lambda x: math.floor(x / 0.1)
    assert set(got) == set(lines)
    for line, rows in lines.items():
        a, b = rows[0]["middle"]
        ways = {w for w, lat, lng in vertices if abs(tile(lat) - tile(a)) <= 1 and abs(tile(lng) - tile(b)) <= 1}
        sums = [(round(sum(min(abs(lat - r["lat"]) + abs(lng - r["lng"]) for v, lat, lng in vertices if v == w) for r in rows), 9), w) for w in ways]
        assert got[line] == ((min(sums)[1], pytest.approx(min(sums)[0])) if sums else (None, None))


def test_only_edges_of_corridors_are_kept(spark):
    node = lambda lat, lng: round((lat + 90) * 1e5) * 100_000_000 + round((lng + 180) * 1e5)
    edges = spark.createDataFrame([(m, node(52.54 + k / 10, 13.44), k) for m in ("a", "b") for k in range(9)], "mode string, src long, k int")
    asked = spark.createDataFrame([(1, "a", 52.55, 13.45, 52.65, 13.45), (2, "a", None, None, None, None)], "route long, mode string, lat1 double, lng1 double, lat2 double, lng2 double")
    kept = route.in_corridors(edges, asked, 0.01)
    assert kept.columns == edges.columns and sorted((r["mode"], r["k"]) for r in kept.collect()) == [("a", 0), ("a", 1)]


def test_ways_beyond_the_pole_have_no_height(spark, tmp_path):
    """Large tables have ways on and beyond the pole, where the grid of pictures ends."""
    keys = [0, 1, 1_874_032, 1_875_999, 1_876_001, 1_876_058, 7_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["lat"], r["lng"]): r["metres"] for r in catalog.QUERIES["elevation_lookup"](spark, str(tmp_path)).collect()}
    ways = src.ways(spark, str(tmp_path))
    vertices = {(r["lat"], r["lng"]) for r in src.way_points(ways).collect()}
    want = {}
    for lat, lng in vertices:
        want[lat, lng], rad = None, math.radians(lat)
        if lat < 90:
            x, y = (lng + 180) / 360 * 4096, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * 4096
            i, j = (math.floor((c - math.floor(c)) * 256) for c in (x, y))
            want[lat, lng] = pytest.approx(-10000 + (100000 + math.fmod(j * 37 + i * 91 + math.floor(x) * 5 + math.floor(y) * 3, 400)) * 0.1, abs=1e-3)
    assert any(lat > 90 for lat, _ in vertices) and any(89.98 < lat < 90 for lat, _ in vertices)
    assert got == want
    ends = {r["way_id"]: r["metres1"] is not None and r["metres2"] is not None for r in terrain.with_ends(ways, more.hills(ways)).collect()}
    assert ends == {k: k < 1_876_000 for k in keys}


def test_only_ways_in_the_tiles_of_requests_are_lifted(spark):
    point = lambda lat, lng: {"lat": lat, "lng": lng}
    rows = [(k, {"highway": "cycleway"}, [point(52.54 + k / 10, 13.44), point(52.541 + k / 10, 13.44)]) for k in range(40)]
    rows += [(90, {"highway": "cycleway"}, [point(0.0, 0.0), point(52.551, 13.44)]), (91, {}, []), (92, {}, None), (None, {"highway": "cycleway"}, [point(52.545, 13.44), point(52.546, 13.44)])]
    ways = spark.createDataFrame(rows, "way_id long, tags map<string,string>, coords array<struct<lat:double,lng:double>>")
    asked = spark.createDataFrame([(1, "kid-confident", 52.54, 13.44, 52.541, 13.44), (2, "kid-confident", 52.74, 13.44, 52.741, 13.44), (3, "kid-confident", None, None, None, None)], "route long, mode string, lat1 double, lng1 double, lat2 double, lng2 double")
    lifted = []

    def lift(some):
        lifted.extend(r["way_id"] for r in some.select("way_id").collect())
        return some.withColumn("up", F.lit(0.0))

    found, _ = route.client_routes(asked, ways, dims.modes(spark), F.lit(True), pad=0.01, t=streets.of_map("tags"), elevation=(F.col("up"), F.col("up")), lifted=lift)
    assert {r["route"]: r["found"] for r in found.collect()} == {1: True, 2: True, 3: False}
    assert sorted(lifted, key=str) == [0, 2, 90, None]


def test_requests_of_a_start_share_a_task_and_a_search(spark, monkeypatch):
    """Many requests of a few starts have the cheapest paths, by few searches, and no share holds too many of them."""
    monkeypatch.setattr(route, "TOGETHER", 20)
    draw, side = random.Random(4), 12
    node = lambda i, j: (14_250_000 + 200 * i) * 100_000_000 + 19_344_000 + 200 * j
    pairs = [((i, j), (i + a, j + b)) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < side and 0 <= j + b < side and draw.random() < 0.8]
    links = [("m", node(*a), node(*b), 200.0, draw.uniform(60, 200), k, False, None) for k, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(links, "mode string, src long, dst long, dist double, cost double, way_id long, is_walking boolean, item string").withColumn("ord", F.struct("way_id")).checkpoint()
    spots = [(draw.randrange(side), draw.randrange(side)) for _ in range(9)]
    ends = [(spots[0] if k % 2 else spots[k % 9], (draw.randrange(side), draw.randrange(side))) for k in range(300)]
    place = lambda c: (52.5 + 0.002 * c[0], 13.44 + 0.002 * c[1])
    table = [(k, "m", *place(a), *place(b), None) for k, (a, b) in enumerate(ends)]
    asked = spark.createDataFrame(table, "route long, mode string, lat1 double, lng1 double, lat2 double, lng2 double, avoid array<long>")
    _, dealt = route.corridors(asked, edges, edges, 0.05)
    held = {}
    for r in dealt.collect():
        held.setdefault(r["share"], []).append((r["lat1"], r["lng1"]))
    assert sum(map(len, held.values())) == 300 and max(map(len, held.values())) <= 100
    assert sum(len(set(starts)) for starts in held.values()) <= 40  # 300 requests of 9 starts
    out, got = search.links(*zip(*((s, d, c) for _, s, d, _, c, *_ in links), strict=True)), {}
    for r in sorted(route.shared_paths(asked, edges, edges).collect(), key=lambda r: (r["route"], r["idx"])):
        got.setdefault(r["route"], []).append(r)
    for k, (a, b) in enumerate(ends):
        best = search.cheapest(out, {node(*a): 0.0}).cost
        rows = got.get(k, [])
        assert [r["idx"] for r in rows] == list(range(len(rows)))
        if a != b and node(*b) in best:
            assert rows[0]["src"] == node(*a) and rows[-1]["dst"] == node(*b)
            assert all(x["dst"] == y["src"] for x, y in zip(rows, rows[1:], strict=False)) and all(out[r["src"]][r["dst"]] == r["cost"] and links[r["way_id"]][1:3] == (r["src"], r["dst"]) for r in rows)
            assert sum(r["cost"] for r in rows) == pytest.approx(best[node(*b)])
    searches = []
    cheapest = search.cheapest
    monkeypatch.setattr(search, "cheapest", lambda *a: searches.append(1) or cheapest(*a))
    own = route._Corridor(edges.toArrow())
    start = own.start(*place(spots[0]), 100.0)
    paths = list(own.paths(start, [place(b) for _, b in ends[:50]], 100.0, None))
    assert len(searches) == 1 and len(paths) == 50
    few = list(own.paths(start, [place(b) for _, b in ends[:3]], 100.0, None))
    assert few == paths[:3] and len(searches) == 1 + sum(p is not None for p in few)
