"""DuckDB text of what the street queries start from: ways, their vertices and their classification."""

from __future__ import annotations

from lanecraft.functions import streets as S
from lanecraft.functions.text import PATHS, SURFACES
from lanecraft.sources import dims
from lanecraft.sources.ways import DISTRICT, LAT0, LAT_STEP, LNG0, LNG_STEP, POINTS, SIDE, TAGS, column


def text(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def texts(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def array(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


_TAGS = ",\n".join(f"{array(values)}[CAST({index.format(d='//')} AS INT) + 1] AS {column(tag)}" for tag, values, index in TAGS)
WAYS = f"""ways AS (
    SELECT p AS way_id, {_TAGS},
        (p // 2) % {SIDE} AS line, ((p // {2 * SIDE}) % 7) * 4 AS start, (p // {DISTRICT}) * 40 AS shift
    FROM (SELECT p_partkey AS p FROM part)
), pts AS (
    SELECT way_id, CAST(k AS INT) AS idx, ilat, ilng, ilat / 100000.0::DOUBLE AS lat, ilng / 100000.0::DOUBLE AS lng FROM (
        SELECT way_id, k,
            {LAT0} + {LAT_STEP} * (shift + CASE WHEN way_id % 2 = 0 THEN line ELSE start + k END) AS ilat,
            {LNG0} + {LNG_STEP} * (CASE WHEN way_id % 2 = 0 THEN start + k ELSE line END) AS ilng
        FROM ways, range({POINTS}) t(k))
)"""


def haversine(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({x}), sqrt(1 - {x})))"


def number(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE TRY_CAST(NULLIF(regexp_extract({c}, '^\\s*([+-]?[0-9]+)', 1), '') AS INT) END"


def cases(c: str, options: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {text(k)} THEN {v if isinstance(v, int) else text(v)}" for k, v in options.items()) + " END"


def lanes(values) -> str:
    return "(" + " OR ".join(f"coalesce({column(k)} IN {texts(values)}, false)" for k in S.CYCLEWAY_KEYS) + ")"


SEPARATED = "(coalesce(cycleway_buffer, '') <> '' OR " + " OR ".join(f"coalesce({column(k)} IN {texts(S.SEPARATION_VALUES)}, false)" for k in S.SEPARATION_KEYS) + ")"
LEVEL = "CASE WHEN lts = 4 THEN '4' WHEN lts = 3 THEN '3' WHEN car_free THEN '1a' WHEN bike_priority THEN '1b' WHEN bike_infra AND (speed_kmh IS NULL OR speed_kmh <= 30) THEN '2a' WHEN bike_infra THEN '3' ELSE '2b' END"
ITEM = f"""CASE path_level
    WHEN '1a' THEN CASE WHEN highway = 'footway' OR (highway = 'path' AND bicycle IN ('yes', 'designated')) THEN 'Shared use path'
        WHEN {lanes(('track', 'opposite_track'))} OR ({lanes(('lane', 'opposite_lane'))} AND {SEPARATED}) THEN 'Elevated sidewalk path' ELSE 'Bike path' END
    WHEN '1b' THEN CASE WHEN road THEN 'Fahrradstrasse' WHEN highway = 'living_street' THEN 'Living street'
        WHEN highway = 'residential' AND motor_vehicle IN ('destination', 'permissive') THEN 'Bike boulevard' ELSE 'Fahrradstrasse' END
    WHEN '2a' THEN CASE WHEN {lanes(('share_busway',))} THEN 'Shared bus lane on quiet street' ELSE 'Painted bike lane on quiet street' END
    WHEN '2b' THEN 'Quiet street'
    WHEN '3' THEN CASE WHEN {lanes(('lane', 'opposite_lane', 'share_busway'))} THEN 'Painted bike lane on major road' ELSE 'Major road' END END"""
CLS = f"""{WAYS}, f1 AS (
    SELECT *, coalesce(cycleway, cycleway_right, cycleway_both) AS cw, {number('maxspeed')} AS ms, {number('lanes')} AS ln,
        coalesce(bicycle_road = 'yes', false) OR coalesce(cyclestreet = 'yes', false) AS road,
        highway = 'footway' AND coalesce(bicycle IN ('yes', 'designated'), false) AS on_foot,
        highway = 'path' AND bicycle IS DISTINCT FROM 'no' AS on_path
    FROM ways
), f2 AS (
    SELECT *, coalesce(cw IN ('track', 'opposite_track'), false) AS trk, coalesce(cw IN ('lane', 'opposite_lane'), false) AS lane, coalesce(cw = 'share_busway', false) AS bus,
        highway IN ('cycleway', 'path', 'footway', 'pedestrian') AS by_foot FROM f1
), f3 AS (
    SELECT *, highway IN ('cycleway', 'pedestrian', 'track') OR on_path OR on_foot OR trk OR coalesce(motor_vehicle = 'no', false) OR coalesce(access = 'no', false) AS car_free,
        road OR highway = 'living_street' OR (highway = 'residential' AND coalesce(motor_vehicle IN ('destination', 'permissive'), false)) AS bike_priority,
        highway = 'cycleway' OR on_path OR on_foot OR road OR trk OR lane OR bus AS bike_infra,
        CAST(CASE WHEN ms > 0 THEN ms WHEN by_foot THEN NULL ELSE {cases('highway', S.DEFAULT_SPEED)} END AS INT) AS speed_kmh,
        CASE WHEN by_foot THEN NULL ELSE {cases('highway', S.DENSITY)} END AS density,
        CASE WHEN highway IN ('cycleway', 'path', 'pedestrian', 'track') OR on_foot OR highway = 'living_street' OR road THEN 1
            WHEN trk THEN CASE WHEN ms > 50 THEN 2 ELSE 1 END
            WHEN highway = 'residential' AND (ms <= 30 OR ms = 0) AND ln <= 2 THEN 1
            WHEN lane THEN CASE WHEN (ms <= 30 AND ln <= 2) OR (ms <= 50 AND ln <= 3) THEN 2 ELSE 3 END
            WHEN bus THEN 2
            WHEN highway = 'residential' THEN CASE WHEN ms <= 50 AND ln <= 3 THEN 2 ELSE 3 END
            WHEN highway = 'tertiary' THEN CASE WHEN ms <= 30 THEN 2 WHEN ms <= 50 THEN 3 ELSE 4 END
            WHEN highway = 'unclassified' THEN CASE WHEN ms <= 30 THEN 2 ELSE 3 END
            WHEN highway IN ('secondary', 'primary', 'trunk') THEN 4 ELSE 3 END AS lts
    FROM f2
), f4 AS (SELECT *, {LEVEL} AS path_level FROM f3), cls AS (SELECT *, {ITEM} AS item FROM f4)"""
LEGS = f"""legs AS (
    SELECT way_id, idx, ilat, ilng, lat, lng, lead(ilat) OVER w AS ilat2, lead(ilng) OVER w AS ilng2, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2,
        {haversine('lat', 'lng', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS dist
    FROM pts WINDOW w AS (PARTITION BY way_id ORDER BY idx)
), lengths AS (SELECT way_id, sum(dist) AS metres FROM legs GROUP BY way_id)"""
SCAN = {
    "overlay": f"(highway = 'cycleway' OR coalesce(bicycle_road = 'yes', false) OR highway = 'living_street' OR (highway IN ('residential', 'path', 'track') AND bicycle IS DISTINCT FROM 'no') OR (highway = 'footway' AND coalesce(bicycle IN ('yes', 'designated'), false)) OR {lanes(S.CYCLEWAY_VALUES)})",
    "audit": f"(highway IN ('cycleway', 'living_street', 'residential', 'tertiary', 'unclassified') OR coalesce(bicycle_road = 'yes', false) OR coalesce(cyclestreet = 'yes', false) OR (highway = 'service' AND service IS DISTINCT FROM 'parking_aisle') OR (highway IN ('path', 'track') AND bicycle IS DISTINCT FROM 'no') OR (highway = 'footway' AND coalesce(bicycle IN ('yes', 'designated'), false)) OR {lanes(S.CYCLEWAY_VALUES)})",
}
SIGNATURE = "concat_ws('|', " + ", ".join(f"'{k}=' || {column(k)}" for k in S.SIGNATURE_KEYS) + ")"
WALKING = "(highway = 'steps' OR (highway IN ('footway', 'pedestrian') AND NOT coalesce(bicycle IN ('yes', 'designated'), false)))"
BRIDGE = f"""(NOT (highway IN {texts(S.NO_WALK)} OR coalesce(foot = 'no', false) OR coalesce(access IN ('no', 'private'), false)) AND (highway IN {texts(S.SELF_WALK)}
    OR NOT (coalesce(sidewalk IN ('no', 'none'), false) OR coalesce(sidewalk_both = 'no', false) OR coalesce(sidewalk_left = 'no' AND sidewalk_right = 'no', false))))"""
ONEWAY = "((coalesce(oneway = 'yes', false) OR coalesce(oneway_bicycle = 'yes', false)) AND oneway_bicycle IS DISTINCT FROM 'no')"
ROUGH = f"(coalesce(smoothness IN {texts(S.BAD_SMOOTHNESS)}, false) OR coalesce(surface IN {texts(S.ROUGH_SURFACES)}, false))"


def modes(rough: float = dims.ROUGH_MULT) -> str:
    rows = ", ".join(
        f"({text(m)}, {array(acc)}, {mult.get('2a', 1.0)}, {mult.get('2b', 1.0)}, {array(surf)}, {text(cob)}, {ride}, {slow}, {walk}, {grad}, {array(ref) if ref else '[]::VARCHAR[]'}, {array(dims.preferred(m))}, {rough})"
        for m, acc, mult, surf, cob, ride, slow, walk, grad, ref in dims.MODES
    )
    return f"modes AS (SELECT * FROM (VALUES {rows}) t(mode, accepted, m2a, m2b, surfaces, cobbles, ride_kmh, slow_kmh, walk_kmh, gradient_cap, reject_items, preferred, rough_mult))"


def decided(rough: float = dims.ROUGH_MULT) -> str:
    cob = f"coalesce(surface IN {texts(S.COBBLES)}, false)"
    return f"""{CLS}, {modes(rough)}, dec0 AS (
        SELECT *, CASE WHEN NOT list_contains(accepted, path_level) THEN 'level' WHEN coalesce(list_contains(reject_items, item), false) THEN 'path-type'
            WHEN {cob} AND cobbles = 'reject' THEN 'cobbles' WHEN NOT {cob} AND surface IS NOT NULL AND NOT list_contains(surfaces, surface) THEN 'surface' END AS reason
        FROM cls, modes
    ), dec AS (
        SELECT *, reason IS NULL AS ok, reason IS NULL AND {cob} AND cobbles = 'walk' AS walks,
            CASE WHEN reason IS NOT NULL THEN NULL WHEN {cob} AND cobbles = 'walk' THEN walk_kmh WHEN {cob} THEN slow_kmh ELSE ride_kmh END::DOUBLE AS kmh,
            CASE WHEN reason IS NULL THEN CASE WHEN {ROUGH} THEN rough_mult ELSE 1.0 END * CASE WHEN {cob} THEN 1.0 WHEN path_level = '2a' THEN m2a WHEN path_level = '2b' THEN m2b ELSE 1.0 END END::DOUBLE AS mult
        FROM dec0
    )"""


def edges(extra: str = "", steep: str = "false") -> str:
    walked = f"({WALKING} OR NOT ok)"
    slow = "(item IS NOT NULL AND NOT list_contains(preferred, item) AND NOT walks)"
    return f"""{decided()}, {LEGS}, speeds AS (
        SELECT mode, d.way_id, {ONEWAY} AS single, ({walked} OR walks OR {steep}) AS is_walking,
            CASE WHEN {walked} OR {steep} AND NOT walks THEN walk_kmh WHEN {slow} THEN least(kmh, slow_kmh) ELSE kmh END::DOUBLE AS kmh,
            CASE WHEN {walked} OR {steep} AND NOT walks THEN 1.0 ELSE mult END::DOUBLE AS mult
        FROM dec d JOIN lengths l ON l.way_id = d.way_id WHERE ({WALKING} OR ok OR {BRIDGE}) AND NOT ({steep} AND NOT {walked} AND NOT walks AND NOT {BRIDGE}) {extra}
    ), edges AS (
        SELECT mode, s.way_id, idx + 1 AS seg, b AS back, dist, dist / (kmh / 3.6) * mult AS cost, is_walking,
            CASE WHEN b = 0 THEN (ilat + 9000000) * 100000000 + ilng + 18000000 ELSE (ilat2 + 9000000) * 100000000 + ilng2 + 18000000 END AS src,
            CASE WHEN b = 1 THEN (ilat + 9000000) * 100000000 + ilng + 18000000 ELSE (ilat2 + 9000000) * 100000000 + ilng2 + 18000000 END AS dst
        FROM speeds s JOIN legs USING (way_id), range(2) t(b) WHERE dist IS NOT NULL AND (b = 0 OR NOT single)
    ), last_edges AS (
        SELECT mode, src, dst, max_by(struct_pack(dist, cost, way_id, is_walking), struct_pack(way_id, seg, back)) AS e FROM edges GROUP BY ALL
    )"""


PINGS = f"""pings AS (
    SELECT user_id AS route, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id,
        ({LAT0} + {LAT_STEP} * ((event_id * 7) % 29) + (event_id % 13) * 3) / 100000.0::DOUBLE AS lat,
        ({LNG0} + {LNG_STEP} * ((event_id * 11) % 29) + (event_id % 7) * 4) / 100000.0::DOUBLE AS lng,
        {array([*list(dims.ITEMS)[:3], 'Quiet street', 'Major road', None])}[CAST((event_id // 3 + user_id) % 6 AS INT) + 1] AS item,
        event_id % 7 = 0 AS is_walking
    FROM events
)"""
SEGMENTS = f"""{PINGS}, k AS (
    SELECT *, CASE WHEN is_walking THEN '#walk' ELSE item END AS kind, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM pings WINDOW w AS (PARTITION BY route ORDER BY idx)
), st AS (
    SELECT *, coalesce({haversine('plat', 'plng', 'lat', 'lng')}, 0) AS step,
        CASE WHEN idx = 0 THEN 0 WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY route ORDER BY idx)
), num AS (SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY idx) AS seg FROM st), segs AS (
    SELECT route, CAST(seg AS BIGINT) AS seg, any_value(CASE WHEN NOT is_walking THEN item END) AS item, bool_or(is_walking) AS is_walking,
        count(*) + CASE WHEN seg > 0 THEN 1 ELSE 0 END AS n_coords, sum(step) AS metres FROM num GROUP BY route, seg
)"""
GOOD = "coalesce(item IN " + texts(dims.preferred("kid-traffic-savvy")) + ", false)"
HEALED = f"""{SEGMENTS}, g AS (SELECT *, {GOOD} AND NOT is_walking AS good FROM segs), healed AS (
    SELECT route, seg, is_walking, n_coords, metres, gap AS healed, CASE WHEN gap THEN before ELSE item END AS item FROM (
        SELECT *, lag(item) OVER w AS before, coalesce(NOT is_walking AND NOT good AND n_coords <= 5 AND lag(good) OVER w AND lead(good) OVER w, false) AS gap FROM g WINDOW w AS (PARTITION BY route ORDER BY seg))
)"""
SAMPLES = """samples AS (
    SELECT CASE WHEN o_custkey % 2 = 0 THEN 'berlin' ELSE 'sf' END AS city, 'm' || (o_custkey % 5) AS mode, o_custkey AS pair,
        ['client', 'valhalla', 'brouter', 'google'][CAST(o_orderkey % 4 AS INT) + 1] AS engine, max(o_totalprice / 10000.0::DOUBLE) AS km, max((o_orderkey * 37 % 101) / 100.0::DOUBLE) AS pct
    FROM orders GROUP BY ALL
)"""
WIDE = SAMPLES + ", wide AS (SELECT city, mode, pair, " + ", ".join(f"max(CASE WHEN engine = '{e}' THEN {c} END) AS {e}_{c}" for e in ("client", "valhalla", "brouter", "google") for c in ("km", "pct")) + " FROM samples GROUP BY ALL)"
