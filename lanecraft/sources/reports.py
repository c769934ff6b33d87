"""Reports of riders on street segments, and answers of other routers kept by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecraft.operators import tables

#: Columns of a report; those in NEEDED may not be null. Fixed values.
FEEDBACK = "id string, timestamp timestamp, route_log_id string, lat double, lng double, osm_way_id long, feedback_type string, comment string, travel_mode string"
NEEDED = ("id", "timestamp", "lat", "lng", "feedback_type")


def append_feedback(rows: DataFrame, path: str) -> int:
    """Adds reports to the table at ``path``, by day; how many were added.

    A report whose id is there already, or comes twice among ``rows`` (the earliest counts), isn't added again. Reports
    without an id, time, place or kind are an error, and then none is added.
    """
    spark = rows.sparkSession
    names = [f.split()[0] for f in FEEDBACK.split(", ")]
    rows = rows.select(*names)
    new = tables.latest(rows, ["id"], [F.col("timestamp"), *(F.col(c) for c in names if c not in ("id", "timestamp"))]).checkpoint()
    lacking = rows.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in NEEDED)).first()
    if bad := [c for c in NEEDED if lacking[c]]:
        raise ValueError(f"reports without {', '.join(bad)}")
    there = read_feedback(spark, path)
    if there is not None:
        new = new.join(there.select("id"), "id", "left_anti").checkpoint()
    added = new.count()
    if added:
        new.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")).repartition("day").write.mode("append").partitionBy("day").parquet(path)
    return added


def read_feedback(spark: SparkSession, path: str) -> DataFrame | None:
    """All reports, with ``day``; None where none was ever added."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"{FEEDBACK}, day string").parquet(path)


def queue(entries: DataFrame, deleted: DataFrame | None = None, cleared: Column | None = None, most: int = 100) -> DataFrame:
    """The newest ``most`` of each region's ``entries(id, region, created_at)``, a null region being one, without the ``deleted(id)`` and those ``cleared``.

    Entries that were dropped when the queue was full don't come back when others are deleted. Of equally old ones the greater ids stay.
    """
    kept = tables.latest(entries, ["region"], [F.desc("created_at"), F.desc("id")], most)
    if deleted is not None:
        kept = kept.join(deleted.select("id").distinct(), "id", "left_anti")
    return kept.where(~F.coalesce(cleared, F.lit(False))) if cleared is not None else kept


def pair_key(city: Column, origin: Column, destination: Column) -> Column:
    return F.concat(city, F.lit(":"), origin, F.lit("→"), destination)


def write_answers(answers: DataFrame, path: str) -> None:
    """``answers(city, origin, destination, route)`` as JSON lines of key and route; a pair without an answer is kept as null."""
    rows = answers.select(pair_key(F.col("city"), F.col("origin"), F.col("destination")).alias("key"), "route")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_answers(spark: SparkSession, path: str, route: str) -> DataFrame:
    """key and route, a struct of the type ``route``."""
    return spark.read.schema(f"key string, route {route}").json(path)
