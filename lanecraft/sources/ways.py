"""Street data derived from the synthetic tables by integer arithmetic, and readers of street files.

A way is a part: five vertices on a grid, with tags that hit every branch of the classification. Each ``DISTRICT`` parts
have a grid of their own, so the street network grows with the table and stays as dense.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Tag, its values in turn, and which one a way p has; {d} stands for whole division.
TAGS = [
    ("highway", ["residential", "cycleway", "path", "footway", "tertiary", "living_street", "secondary", "track", "unclassified", "primary", "pedestrian", "service", "trunk", "steps", "motorway"], "(p * 7 + p {d} 15) % 15"),
    ("maxspeed", [None, "30", "50", "", "walk", "30 mph", "60", "20", None, "none", "100"], "p % 11"),
    ("lanes", [None, "1", "2", "3", "4", "x"], "(p {d} 3) % 6"),
    ("cycleway", [None, None, "no", "lane", "track", "share_busway", "opposite_lane", "opposite_track", None], "(p {d} 5) % 9"),
    ("cycleway:right", [None, None, None, "track", "lane", None, None], "(p {d} 7) % 7"),
    ("cycleway:left", [None, None, "lane", None, None, None], "(p {d} 11) % 6"),
    ("cycleway:both", [None, None, None, None, "lane"], "(p {d} 13) % 5"),
    ("cycleway:separation", [None, None, "flex_post", None], "(p {d} 17) % 4"),
    ("cycleway:right:separation", [None, None, None, None, "guard_rail"], "(p {d} 19) % 5"),
    ("cycleway:left:separation", [None, "other"], "p % 2"),
    ("cycleway:both:separation", [None], "p % 1"),
    ("cycleway:buffer", [None, None, None, "yes", ""], "(p {d} 2) % 5"),
    ("bicycle", [None, "yes", "no", "designated", None], "(p {d} 4) % 5"),
    ("bicycle_road", ["yes"] + [None] * 18, "p % 19"),
    ("cyclestreet", ["yes"] + [None] * 22, "p % 23"),
    ("motor_vehicle", [None, None, "destination", "permissive", "no"], "(p {d} 6) % 5"),
    ("access", [None, None, None, None, None, "no", "private"], "(p {d} 8) % 7"),
    ("surface", [None, "asphalt", "cobblestone", "sett", "gravel", "paving_stones", "concrete", "fine_gravel", "compacted", "wood", "unhewn_cobblestone", "cobblestone:flattened"], "(p {d} 9) % 12"),
    ("smoothness", [None, None, "good", "bad", "intermediate"], "(p {d} 10) % 5"),
    ("oneway", [None, None, "yes", None], "(p {d} 12) % 4"),
    ("oneway:bicycle", [None, None, "no", "yes", None], "(p {d} 14) % 5"),
    ("sidewalk", [None, "no", "both", "none"], "(p {d} 16) % 4"),
    ("sidewalk:both", [None, None, "no"], "(p {d} 18) % 3"),
    ("sidewalk:left", [None, "no"], "(p {d} 20) % 2"),
    ("sidewalk:right", [None, "no", None], "(p {d} 21) % 3"),
    ("foot", [None, None, None, None, "no"], "(p {d} 22) % 5"),
    ("service", [None, "parking_aisle", "driveway"], "(p {d} 24) % 3"),
    ("segregated", [None, "yes"], "(p {d} 25) % 2"),
    ("tracktype", [None, None, "grade2"], "(p {d} 26) % 3"),
    ("name", ["Oranienstraße", "Am Landwehrkanal", None, "Hauptweg", "MAUERWEG Nord"], "(p {d} 27) % 5"),
    ("ref", [None, "D11", None], "(p {d} 28) % 3"),
]
DISTRICT, SIDE, POINTS = 2000, 29, 5
#: Ways of a task, about: a way is one number in its file and some forty edges later, so files alone make too few tasks.
TOGETHER = 5000
#: Hundred-thousandths of a degree: where the grid begins, and its steps.
LAT0, LNG0, LAT_STEP, LNG_STEP = 5_248_000, 1_338_000, 100, 150


def column(tag: str) -> str:
    return tag.replace(":", "_")


def _literal(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'"


def _vertex(k: int) -> str:
    shift = f"(p div {DISTRICT}) * 40"
    along, line = f"((p div {2 * SIDE}) % 7) * 4 + {k}", f"(p div 2) % {SIDE}"
    ilat, ilng = f"{LAT0} + {LAT_STEP} * ({shift} + IF(p % 2 = 0, {line}, {along}))", f"{LNG0} + {LNG_STEP} * IF(p % 2 = 0, {along}, {line})"
    return f"named_struct('ilat', CAST({ilat} AS BIGINT), 'ilng', CAST({ilng} AS BIGINT), 'lat', ({ilat}) / 1e5D, 'lng', ({ilng}) / 1e5D)"


#: Text, as thousands of calls that build Columns take longer than small queries.
WAY_COLUMNS = [
    "p AS way_id",
    *(f"element_at(array({', '.join(map(_literal, values))}), CAST({index.format(d='div')} AS INT) + 1) AS `{column(tag)}`" for tag, values, index in TAGS),
    f"array({', '.join(map(_vertex, range(POINTS)))}) AS coords",
]


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, one column per tag, and coords: an array of (ilat, ilng, lat, lng)."""
    rows, n = table(spark, sf_dir, "part").selectExpr("p_partkey AS p"), tasks(spark, sf_dir)
    return (rows.repartition(n, "p") if n > 1 else rows).selectExpr(*WAY_COLUMNS)


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks the ways are dealt, and what is made of them may be; rows are counted in the files' footers."""
    return max(math.ceil(table(spark, sf_dir, "part").count() / TOGETHER), 1)


def way_points(ways: DataFrame) -> DataFrame:
    """One row per vertex: way_id, idx (from 0), ilat, ilng, lat, lng."""
    return ways.select("way_id", F.posexplode("coords").alias("idx", "v")).select("way_id", "idx", "v.*")


def read_osm_json(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an OSM JSON answer: id, tags (a map, empty if missing) and coords; elements that are no ways are dropped."""
    schema = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("elements"))
    return ways_of_elements(rows)


def ways_of_elements(rows: DataFrame) -> DataFrame:
    coords = F.transform("geometry", lambda g: F.struct(g["lat"].alias("lat"), g["lon"].alias("lng")))
    empty = F.create_map().cast("map<string,string>")
    return rows.where("type = 'way' AND geometry IS NOT NULL").select(F.col("id").alias("way_id"), F.coalesce("tags", empty).alias("tags"), coords.alias("coords"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs, one JSON object per line, with ``line`` (higher is newer); lines that are no JSON are skipped. See ``newest_first``."""
    schema = "date string, version string, samples long, clientPct double, valhallaPct double, brouterPct double, google double, _bad string"
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "").select("line", parsed.alias("r"))
    return rows.where(F.col("r._bad").isNull()).select("r.*", "line").drop("_bad")


def newest_first(history: DataFrame) -> DataFrame:
    """A history from its last line to its first."""
    return history.orderBy(F.desc("line"))


#: Columns of a sample of a benchmark run.
SAMPLE = "city string, mode string, pair string, engine string, km double, pct double"


def write_run(samples: DataFrame, path: str, version: str, date: str) -> None:
    """A run's samples and summary beside it, and one more line in the history. Rerun with one version, the samples are replaced."""
    samples.select("city", "mode", "pair", "engine", "km", "pct").write.mode("overwrite").json(f"{path}/runs/{version}")
    means = samples.groupBy().pivot("engine", ["client", "valhalla", "brouter", "google"]).agg(F.avg("pct"))
    count = samples.select("city", "mode", "pair").distinct().agg(F.count("*").alias("samples"))
    line = count.crossJoin(means).select(F.lit(date).alias("date"), F.lit(version).alias("version"), "samples", F.col("client").alias("clientPct"), F.col("valhalla").alias("valhallaPct"), F.col("brouter").alias("brouterPct"), "google")
    line.coalesce(1).write.mode("append").json(f"{path}/history")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all runs, with ``version``."""
    rows = spark.read.schema(SAMPLE).json(f"{path}/runs/*")
    return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/runs/([^/]+)/", 1))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metrics.json: one row a sample; an engine without a route has nulls."""
    engine = "struct<distanceKm:double,preferredPct:double>"
    schema = f"samples array<struct<city:string,mode:string,pair:string,client:{engine},valhalla:{engine},brouter:{engine},google:{engine}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("samples"))
    flat = [F.col(f"{e}.{c}").alias(f"{e}_{n}") for e in ("client", "valhalla", "brouter", "google") for c, n in (("distanceKm", "km"), ("preferredPct", "pct"))]
    return rows.select("city", "mode", "pair", *flat)


def read_external_routes(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """Answers of another router, kept as JSON files: file, coords (lat, lng), km and seconds.

    "valhalla" has legs with a polyline of six decimals, "brouter" a GeoJSON line, "google" routes with a polyline of five.
    """
    from lanecraft.functions import text as T

    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file")
    reader = spark.read.option("multiLine", True)
    if engine == "valhalla":
        rows = reader.schema("trip struct<legs:array<struct<shape:string>>,summary:struct<length:double,time:double>>").json(path)
        coords = F.flatten(F.transform("trip.legs", lambda leg: T.polyline(leg["shape"], 6)))
        return rows.select(file, coords.alias("coords"), F.col("trip.summary.length").alias("km"), F.col("trip.summary.time").alias("seconds"))
    if engine == "brouter":
        rows = reader.schema("features array<struct<geometry:struct<coordinates:array<array<double>>>,properties:map<string,string>>>").json(path)
        first = F.col("features")[0]
        coords = F.transform(first["geometry"]["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lng")))
        number = lambda k: first["properties"][k].cast("double")
        return rows.select(file, coords.alias("coords"), (number("track-length") / 1000).alias("km"), number("total-time").alias("seconds"))
    if engine == "google":
        rows = reader.schema("routes array<struct<polyline:struct<encodedPolyline:string>,distanceMeters:double,duration:string>>").json(path)
        first = F.col("routes")[0]
        return rows.select(file, T.polyline(first["polyline"]["encodedPolyline"], 5).alias("coords"), (first["distanceMeters"] / 1000).alias("km"), F.regexp_extract(first["duration"], r"^([0-9.]+)s$", 1).try_cast("double").alias("seconds"))
    raise ValueError(f"no reader for {engine}")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows of a log (``day`` among their columns) added to what is there, by day."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def save_scan(ways: DataFrame, path: str, city: str) -> None:
    """A city's audit scan in place of the one before; other cities' stay."""
    ways.withColumn("city", F.lit(city)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def load_scan(spark: SparkSession, path: str, city: str) -> DataFrame:
    """A city's audit scan; no rows if there is none."""
    return spark.read.parquet(path).where(F.col("city") == city).drop("city")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """City profiles: text files with ``key: value`` lines between two lines of dashes, then prose. file, fields (a map) and prose."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), "value")
    parts = F.split("value", r"(?m)^---\s*$", 3)  # nothing, the fields, and the prose
    lines = F.filter(F.split(F.coalesce(F.get(parts, 1), F.lit("")), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*:")))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    prose = F.regexp_replace(F.coalesce(F.get(parts, 2), F.col("value")), r"^\s+|\s+$", "")
    return rows.select("file", F.map_from_entries(pairs).alias("fields"), prose.alias("prose"))


def write_tiles(ways: DataFrame, path: str) -> None:
    """Ways by the tile of their first vertex, so that a read of a corridor opens only its tiles."""
    from lanecraft.functions import geo

    first = F.col("coords")[0]
    tiled = ways.withColumn("tile_row", geo.tile(first["lat"])).withColumn("tile_col", geo.tile(first["lng"]))
    tiled.repartition("tile_row", "tile_col").write.mode("append").partitionBy("tile_row", "tile_col").parquet(path)


def read_tiles(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """The ways of ``tiles(tile_row, tile_col)``; any number of them. Spark prunes partitions where it finds ``tiles`` small."""
    return spark.read.parquet(path).join(tiles.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_semi")
