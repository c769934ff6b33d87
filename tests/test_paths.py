"""Paths over whole graphs, searches that head for their goal, and what is nearest, against plain searches."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecraft.functions import streets
from lanecraft.operators import graph, lookup, overlay, route, search, segments, spatial
from lanecraft.sources import dims, terrain

MAP = streets.of_map("tags")
WAYS = "way_id long, tags map<string,string>, coords array<struct<lat:double,lng:double>>"
SIDE = 24


def node(i, j):
    return (14_250_000 + i * 100) * 100_000_000 + 19_340_000 + j * 150


def town(seed, share=0.6):
    """One-way links of a square town of some cells, costs with ties, and islands."""
    draw = random.Random(seed)
    sides = ((1, 0), (0, 1), (-1, 0), (0, -1))
    steps = [(node(i, j), node(i + a, j + b)) for i in range(SIDE) for j in range(SIDE) for a, b in sides if 0 <= i + a < SIDE and 0 <= j + b < SIDE]
    return [(a, b, draw.choice([7.0, 8.0, 30.5])) for a, b in steps if draw.random() < share]


@pytest.fixture(scope="module")
def towns(spark):
    one, two = town(1), town(2, 0.55)
    rows = [("m", *e) for e in one] + [("x", *e) for e in two]
    return {"m": search.links(*zip(*one, strict=True)), "x": search.links(*zip(*two, strict=True))}, spark.createDataFrame(rows, "mode string, src long, dst long, cost double")


@pytest.fixture(scope="module", params=[500, 100_000], ids=["several levels", "one level"])
def laid(request, towns):
    return towns[0], overlay.build(towns[1], most=request.param), request.param


def test_reachable_over_cells_equals_a_plain_search(spark, laid):
    out, found, most = laid
    assert (found.top > 1) == (most == 500)
    starts = [("m", node(0, 0)), ("x", node(5, 5)), ("x", node(20, 3)), ("x", 7)]
    got = {(r["mode"], r["node"]) for r in overlay.reachable(found, spark.createDataFrame(starts, "mode string, node long")).collect()}
    want = {("m", n) for n in search.reached(out["m"], [node(0, 0)])} | {("x", n) for n in search.reached(out["x"], [node(5, 5), node(20, 3), 7])}
    assert got == want and len(got) > 500


def test_paths_across_cells_cost_what_plain_ones_do(spark, laid):
    out, found, _ = laid
    draw = random.Random(4)
    pick = lambda: node(draw.randrange(SIDE), draw.randrange(SIDE))
    pairs = [(mode, k, pick(), pick()) for k in range(25) for mode in "mx"]
    pairs += [("m", 90, node(3, 3), node(3, 3)), ("m", 91, 5, 6), ("m", 92, node(4, 4), node(4, 5)), ("y", 1, node(0, 0), node(1, 1))]
    rows = overlay.routes(found, spark.createDataFrame(pairs, "mode string, pair long, src long, dst long")).collect()
    paths = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        paths.setdefault((r["mode"], r["pair"]), []).append((r["idx"], r["node"], r["cost"]))
    for mode, pair, src, dst in pairs:
        links = out.get(mode, {})
        want = search.cheapest(links, {src: 0.0}, [dst]).cost.get(dst)
        path = paths.get((mode, pair), [])
        assert (want is None) == (not path)
        if path:
            assert [i for i, _, _ in path] == list(range(len(path))) and path[0][1:] == (src, 0.0) and path[-1][1] == dst
            assert path[-1][2] == pytest.approx(want)
            assert all(links[a[1]][b[1]] == pytest.approx(b[2] - a[2]) for a, b in zip(path, path[1:], strict=False))


def test_many_pairs_of_one_cell_are_dealt_out(spark, towns, monkeypatch):
    out, found = towns[0], overlay.build(towns[1])
    monkeypatch.setattr(overlay, "TOGETHER", 3)
    pairs = [("m", k, node(k % 5, 1), node(22, 20)) for k in range(20)]
    got = overlay.routes(found, spark.createDataFrame(pairs, "mode string, pair long, src long, dst long")).groupBy("pair").agg(F.max("cost").alias("c")).collect()
    want = {k: search.cheapest(out["m"], {s: 0.0}, [d]).cost.get(d) for _, k, s, d in pairs}
    assert {r["pair"]: r["c"] for r in got} == pytest.approx({k: c for k, c in want.items() if c is not None}) and got


def test_overlays_of_nothing(spark):
    none = overlay.build(spark.createDataFrame([], "mode string, src long, dst long, cost double"))
    assert overlay.reachable(none, spark.createDataFrame([("m", 3)], "mode string, node long")).collect() == [("m", 3)]
    assert overlay.routes(none, spark.createDataFrame([("m", 1, 3, 4)], "mode string, pair long, src long, dst long")).collect() == []


def test_a_search_with_bounds_costs_the_same_and_settles_less(towns):
    out = towns[0]["m"]
    landmarks, draw, plain, led = search.Landmarks(out), random.Random(9), 0, 0
    for _ in range(60):
        start, goal = (node(draw.randrange(SIDE), draw.randrange(SIDE)) for _ in range(2))
        a = search.cheapest(out, {start: 0.0}, [goal])
        bound = search.larger(search.straight(goal, 25.0), landmarks.bound(goal))  # no link is faster: at least 7 s for 111 m
        b = search.cheapest(out, {start: 0.0}, [goal], bound)
        assert a.cost.get(goal) == pytest.approx(b.cost.get(goal)) if goal in a.cost else goal not in b.cost
        if goal in a.cost:
            assert sum(out[x][y] for x, y in zip(b.path(goal), b.path(goal)[1:], strict=False)) == pytest.approx(a.cost[goal])
            exact = [search.cheapest(out, {n: 0.0}, [goal]).cost.get(goal) for n in b.path(goal)]
            assert all(bound(n) <= c for n, c in zip(b.path(goal), exact, strict=True))
            plain, led = plain + a.settled, led + b.settled
    assert led < plain / 2


# --- whole requests


def line(*points):
    return [{"lat": a, "lng": b} for a, b in points]


def asked(spark, rows):
    return spark.createDataFrame(rows, "route long, mode string, lat1 double, lng1 double, lat2 double, lng2 double, avoid array<long>")


def liked():
    return F.coalesce(F.col("item").isin(dims.preferred("kid-confident")), F.lit(False))


def test_requests_share_graphs_and_keep_their_own_wishes(spark, monkeypatch):
    ends = (52.5, 13.4), (52.5, 13.402)
    rows = [
        (1, {"highway": "cycleway"}, line(ends[0], (52.5005, 13.401), ends[1])),
        (2, {"highway": "residential", "maxspeed": "50", "lanes": "4", "bicycle_road": "yes"}, line(ends[0], (52.4995, 13.401), ends[1])),
        (3, {"highway": "living_street"}, line(ends[0], (52.5005, 13.401), ends[1])),
        (4, {"highway": "cycleway"}, line(ends[1], (52.501, 13.402), (52.502, 13.402))),
    ]
    monkeypatch.setattr(route, "TOGETHER", 2)
    to = (52.502, 13.402)
    table = [(k, "kid-confident", *ends[0], *to, None) for k in range(5)] + [(10, "kid-confident", *ends[0], *to, [3, 99]), (11, "kid-confident", *ends[0], *to, [3, 1, 1]), (12, "kid-confident", *ends[0], *to, [4]), (13, "kid-confident", None, 1.0, *to, []), (14, "kid-confident", *ends[0], *ends[0], None)]
    totals, parts = route.client_routes(asked(spark, table), spark.createDataFrame(rows, WAYS), dims.modes(spark), liked(), t=MAP)
    got = {r["route"]: r for r in totals.collect()}
    ways = {}
    for r in parts.orderBy("seg").collect():
        ways.setdefault(r["route"], []).append((r["item"], r["path_level"], r["way_ids"]))
    # The last way between two nodes makes the edge; an avoided one lets the one before it through.
    assert all(ways[k] == [(None, None, []), ("Living street", "1b", [3]), ("Bike path", "1a", [3, 4])] for k in range(5))
    assert ways[10] == [(None, None, []), ("Bike path", "1a", [1, 4])]
    assert ways[11] == [(None, None, []), ("Fahrradstrasse", "1b", [2]), ("Bike path", "1a", [2, 4])]
    # Without way 4 the bend of way 3 is the nearest node to the goal.
    assert got[12]["found"] and got[12]["km"] == pytest.approx(search.metres(*ends[0], 52.5005, 13.401) / 1000)
    assert not got[13]["found"] and got[14]["found"] and got[14]["km"] == 0 and got[14]["segments"] == 1
    assert (got[0]["graph_nodes"], got[0]["graph_edges"], got[12]["graph_nodes"]) == (6, 12, 4)
    assert got[0]["by_level"] == pytest.approx({"1a": 0.559, "1b": 0.441}, abs=1e-3) and got[0]["preferred"] == pytest.approx(1)


def test_steep_ways_are_walked_or_left_out(spark):
    rows = [(1, {"highway": "cycleway"}, line((52.5, 13.4), (52.502, 13.4))), (2, {"highway": "cycleway", "foot": "no"}, line((52.502, 13.4), (52.504, 13.4)))]
    ways = spark.createDataFrame(rows, WAYS).withColumn("up", F.lit(30.0))
    for top, walking in ((30.0, {1: True}), (2.0, {1: False, 2: False}), (None, {1: False, 2: False})):
        height = F.lit(0.0), F.lit(top).cast("double")
        edges = graph.edges(graph.decided(graph.with_class(ways, MAP), dims.modes(spark)), liked(), height, t=MAP).where("mode = 'kid-confident'")
        assert {r["way_id"]: r["is_walking"] for r in edges.collect()} == walking


def test_the_edges_of_a_corridor_do_not_grow_with_its_requests(spark):
    rows = [(k, {"highway": "cycleway"}, line((52.5, 13.4 + k / 1e4), (52.5, 13.4 + (k + 1) / 1e4))) for k in range(50)]
    every = graph.edges(graph.decided(graph.with_class(spark.createDataFrame(rows, WAYS), MAP), dims.modes(spark)), F.lit(True), t=MAP).withColumn("item", F.lit("Bike path")).checkpoint()
    counts = {}
    for n in (20, 200):
        table = asked(spark, [(k, "kid-confident", 52.5, 13.4 + k % 7 / 1e4, 52.5, 13.404, [1] if k % 2 else None) for k in range(n)])
        edges, requests = route.corridors(table, every, every, 0.05)
        counts[n] = edges.count()
        assert requests.count() == n == route.shared_paths(table, every, every).select("route").distinct().count()
    assert counts[20] == counts[200] == 2 * 100 - 2


# --- nearest


def test_rings_find_the_nearest_and_ties(spark):
    draw = random.Random(2)
    dense = [(k, 52.5 + draw.random() / 1000, 13.4 + draw.random() / 1000) for k in range(400)]
    sparse = [(1000 + k, 52.45 + draw.random() / 5, 13.3 + draw.random() / 5) for k in range(30)]
    targets = [*dense, *sparse, (5000, 52.6, 13.6), (4999, 52.6, 13.6), (6000, -70.0, 13.6)]
    points = [(k, 52.45 + draw.random() / 5, 13.3 + draw.random() / 5) for k in range(200)] + [(900, 52.6, 13.6001), (901, 0.0, 0.0), (902, None, 1.0), (903, -70.0, 13.65)]
    got = {r["p"]: (r["t"], r["far"]) for r in spatial.rings(spark.createDataFrame(points, "p long, lat double, lng double"), spark.createDataFrame(targets, "t long, lat double, lng double"), ["p"], "t", 3000.0).collect()}
    for p, lat, lng in points:
        far, best = min((search.metres(lat, lng, b, c), t) for t, b, c in targets) if lat is not None else (1e9, None)
        assert got[p][0] == (best if far <= 3000 else None) and (far > 3000 or got[p][1] == pytest.approx(far))
    assert got[900][0] == 4999 and len(got) == len(points)


def test_images_climb_the_ladder(spark):
    at = lambda m: 52.5 + m / 111_000
    points = spark.createDataFrame([(1, 52.5, 13.4), (2, 53.5, 13.4)], "point long, lat double, lng double")
    for images, want in (([(7, at(240), 13.4), (8, at(110), 13.4)], (8, 250)), ([(7, at(99), 13.4), (8, at(98), 13.4)], (8, 100)), ([(7, at(499), 13.4)], (7, 500)), ([(7, at(501), 13.4)], (None, None))):
        got = spatial.nearest_image(points, spark.createDataFrame(images, "image long, lat double, lng double")).collect()
        assert {r["point"]: (r["image"], r["radius"]) for r in got} == {1: want, 2: (None, None)}


def test_the_way_of_a_line_by_five_samples(spark):
    draw = random.Random(6)
    vertices = [(w, 52.5 + x / 1000 + k * a / 3000, 13.4 + y / 1000 + k * b / 3000) for w in range(120) for x, y, a, b in [(draw.randrange(60), draw.randrange(60), draw.choice([0, 1]), draw.choice([-1, 0, 1]))] for k in range(draw.randrange(1, 6))]
    vertices += [(500, 53.48, 13.4)]
    lines = {}
    for s in range(40):
        x, y, n = draw.randrange(60), draw.randrange(60), draw.choice([1, 2, 3, 4, 5, 6, 9, 10])
        lines[s] = [(52.5 + x / 1000 + k / 4000, 13.4 + y / 1000 + draw.random() / 3000) for k in range(n)]
    lines[90], lines[91] = [(10.0, 10.0)], [(53.38, 13.4), (53.39, 13.4)]
    points = spark.createDataFrame([(0, s, k, *p) for s, ps in lines.items() for k, p in enumerate(ps)], "route long, seg long, idx int, lat double, lng double")
    samples = spatial.sampled(points, ["route", "seg"], "idx")
    got = {r["seg"]: (r["way_id"], r["far"]) for r in spatial.way_of_line(samples, spark.createDataFrame(vertices, "way_id long, lat double, lng double"), ["route", "seg"]).collect()}
    ways = {}
    for w, *p in vertices:
        ways.setdefault(w, []).append(p)
    for s, ps in lines.items():
        k = min(5, len(ps))
        some = [ps[int(i * (len(ps) - 1) / max(1, k - 1) + 0.5)] for i in range(k)]
        middle = ps[len(ps) // 2]
        near = {w: vs for w, vs in ways.items() if any(all(abs(np.floor(v[c] / 0.1) - np.floor(middle[c] / 0.1)) <= 1 for c in (0, 1)) for v in vs)}
        want = min(((round(sum(min(abs(a - c) + abs(b - d) for c, d in vs) for a, b in some), 9), w) for w, vs in near.items()), default=(None, None))
        assert got[s] == (want[1], pytest.approx(want[0]) if want[0] is not None else None)
    assert got[90] == (None, None) and got[91][0] == 500


def test_names_are_found_by_their_parts(spark):
    names = ["Café Kreuz", "Kreuzberg", "berg", "Am Berg 12", "x", "", None, "BERGBERG", "öl"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    texts = ["berg", " BERG ", "b", "g 1", "euzb", "zzz", "", None, "x", "öl", "er", "bergb"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    found = lookup.containing(asked, df, lookup.postings(df, "id", "name"), "id", "name")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, i) for q, t in enumerate(texts) if t and t.strip() for i, n in enumerate(names) if n and t.strip().lower() in n.lower()}
    got = [(r["query"], r["id"]) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_shares_by_level(spark):
    rows = [(1, 0, "Bike path", False, "1a", 3.0), (1, 1, "Fahrradstrasse", False, "1b", 1.0), (1, 2, "Major road", False, "3", 4.0), (1, 3, None, True, None, 2.0), (2, 0, "Bike path", False, "1a", 0.0)]
    df = spark.createDataFrame(rows, "route long, seg long, item string, is_walking boolean, path_level string, metres double")
    got = {r["route"]: r for r in segments.quality(df, liked(), by_level=True).collect()}
    assert got[1]["by_level"] == {"1a": 0.3, "1b": 0.1} and (got[1]["preferred"], got[1]["other"], got[1]["walking"]) == (0.4, 0.4, 0.2)
    assert got[2]["by_level"] == {}


# --- pictures of heights


def filtered(rgb, kinds, colour=2):
    """A PNG with a filter of its own for each line, written out from the format's definition."""
    height, width, channels = rgb.shape
    out = bytearray()
    for y in range(height):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(width):
            for c in range(channels):
                left = int(rgb[y, x - 1, c]) if x else 0
                up = int(rgb[y - 1, x, c]) if y else 0
                corner = int(rgb[y - 1, x - 1, c]) if x and y else 0
                guess = left + up - corner
                paeth = min((abs(guess - v), k, v) for k, v in enumerate((left, up, corner)))[2]
                out.append((int(rgb[y, x, c]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    body = zlib.compress(bytes(out))
    parts = [(b"IHDR", head), (b"tEXt", b"a\0b"), (b"IDAT", body[:10]), (b"IDAT", body[10:]), (b"IEND", b"")]
    return terrain.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def test_pictures_decode_exactly():
    draw = np.random.default_rng(1)
    rgb = draw.integers(0, 256, (10, 13, 3))
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (terrain.pixels(filtered(rgb, kinds)) == rgb).all()
    wide = draw.integers(0, 256, (6, 5, 4))
    assert (terrain.pixels(filtered(wide, [4, 1], 6)) == wide[:, :, :3]).all()
    assert (terrain.pixels(filtered(wide[:, :, :1], [3], 0)) == wide[:, :, :1]).all()
    assert (terrain.pixels(terrain.picture(rgb)) == rgb).all()
    good = terrain.picture(rgb)
    for bad in (b"", b"no", good[:-20], good[:40] + b"\0" + good[41:], good.replace(b"IHDR", b"JHDR")):
        with pytest.raises((ValueError, KeyError)):
            terrain.pixels(bad)


def test_heights_of_places_and_ways(spark, tmp_path):
    steps = np.full((256, 256), 100_000 + 350)
    steps[128:] = 100_000 + 2350
    rgb = np.stack([steps >> 16, steps >> 8 & 255, steps & 255], axis=2)
    for x, y, content in ((2200, 1343, terrain.picture(rgb)), (2201, 1343, b"broken")):
        (tmp_path / f"12/{x}").mkdir(parents=True)
        (tmp_path / f"12/{x}/{y}.png").write_bytes(content)
    (tmp_path / "other.png").write_bytes(b"")
    tiles = terrain.read_tiles(spark, str(tmp_path))
    assert tiles.count() == 2
    # Tile 2200/1343 reaches from 13.359 to 13.447 degrees east.
    rows = [(1, {}, line((52.5220, 13.40), (52.4850, 13.40))), (2, {}, line((52.5220, 13.46), (52.5220, 13.40))), (3, {}, line((10.0, 10.0))), (4, {}, [])]
    got = {r["way_id"]: (r["metres1"], r["metres2"]) for r in terrain.with_ends(spark.createDataFrame(rows, WAYS), tiles).collect()}
    assert got[1] == (pytest.approx(35.0), pytest.approx(235.0)) and got[2] == (None, pytest.approx(35.0)) and got[3] == got[4] == (None, None)


def test_lines_are_reduced_together_as_one_by_one():
    from lanecraft.operators import simplify

    def alone(points, tolerance):
        keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
        while stack:
            a, b = stack.pop()
            best, worst = tolerance * tolerance, None
            for k in range(a + 1, b):
                line, rest = points[b] - points[a], points[k] - points[a]
                span = float(line @ line)
                t = min(max(float(rest @ line) / span, 0), 1) if span else 0.0
                far = float(((rest - t * line) ** 2).sum())
                if far > best:
                    best, worst = far, k
            if worst is not None:
                keep.add(worst)
                stack += [(a, worst), (worst, b)]
        return points[sorted(keep)]

    draw = np.random.default_rng(8)
    lines = [np.cumsum(draw.normal(size=(n, 2)), axis=0) for n in (1, 2, 3, 10, 500, 4)] + [np.zeros((5, 2)), np.array([[0, 0], [1, 1], [0, 0.0]])]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in lines])])
    for tolerance in (0.1, 1.0, 5.0):
        keep = simplify.kept(np.concatenate(lines), ends, tolerance)
        for a, b, points in zip(ends, ends[1:], lines, strict=False):
            assert points[keep[a:b]].tolist() == alone(points, tolerance).tolist()


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    import os

    from lanecraft.sources import store

    schema, path = "key long, value string, fetched_at long", str(tmp_path / "cache")
    assert store.read(spark, path, schema).collect() == []
    make = lambda rows: spark.createDataFrame(rows, schema)
    store.upsert(make([(k, f"a{k}", 10) for k in range(200)] + [(None, "n", 1), (7, "older", 3)]), path, "key", "fetched_at", 16)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/parts") for f in fs}
    before = files()
    store.upsert(make([(3, None, 20), (300, "new", 5), (4, "stale", 2)]), path, "key", "fetched_at", 16)
    got = {r["key"]: (r["value"], r["fetched_at"]) for r in store.read(spark, path, schema).collect()}
    assert got == {**{k: (f"a{k}", 10) for k in range(200)}, None: ("n", 1), 3: (None, 20), 300: ("new", 5)}
    after = files()
    assert {f: after[f] for f in before} == before
    written = {f.split("_part=")[1].split("/")[0] for f in after.keys() - before.keys() if "_part=" in f}
    assert 1 <= len(written) <= 3
    assert {r["key"] for r in store.read(spark, path, schema, now=21, ttl_ms=11).collect()} == set(range(200))
    store.upsert(make([]), path, "key", "fetched_at", 16)
    assert store.read(spark, path, schema).count() == 202


def test_reports_are_added_once_and_need_what_they_need(spark, tmp_path):
    import datetime

    from lanecraft.sources import reports

    at = datetime.datetime(2026, 1, 2, 3)
    make = lambda *rows: spark.createDataFrame(rows, reports.FEEDBACK)
    row = lambda i, **k: tuple({"id": i, "timestamp": at, "route_log_id": None, "lat": 52.5, "lng": 13.4, "osm_way_id": None, "feedback_type": "rough", "comment": None, "travel_mode": None, **k}.values())
    path = str(tmp_path / "feedback")
    assert reports.read_feedback(spark, path) is None
    assert reports.append_feedback(make(row("a"), row("b"), row("a", comment="again")), path) == 2
    assert reports.append_feedback(make(row("b"), row("c")), path) == 1
    for bad in (row("d", lat=None), row(None), row("d", feedback_type=None)):
        with pytest.raises(ValueError, match="without"):
            reports.append_feedback(make(row("e"), bad), path)
    assert sorted(r["id"] for r in reports.read_feedback(spark, path).collect()) == ["a", "b", "c"]


def test_answers_without_a_route_are_kept(spark, tmp_path):
    from lanecraft.sources import reports

    rows = spark.createDataFrame([("berlin", "Home", "Zoo", (1.5, "abc")), ("sf", "A", "B", None)], "city string, origin string, destination string, route struct<km:double,line:string>")
    reports.write_answers(rows, str(tmp_path / "answers"))
    got = {r["key"]: r["route"] for r in reports.read_answers(spark, str(tmp_path / "answers"), "struct<km:double,line:string>").collect()}
    assert got == {"berlin:Home\u2192Zoo": (1.5, "abc"), "sf:A\u2192B": None}


def test_a_full_queue_drops_the_oldest_of_a_region(spark):
    from lanecraft.sources import reports

    rows = spark.createDataFrame([(k, "x" if k < 8 else None, k // 2) for k in range(12)], "id long, region string, created_at long")
    left = lambda **k: sorted(r["id"] for r in reports.queue(rows, most=3, **k).collect())
    assert left() == [5, 6, 7, 9, 10, 11]
    assert left(deleted=rows.where("id IN (6, 9)")) == [5, 7, 10, 11]
    assert left(cleared=F.col("region") == "x") == [9, 10, 11]
