"""A table in files by hash of its key, of which an upsert writes only the parts it touches.

A folder holds one folder of Parquet files for each part and version, and ``manifest`` files that say which version of each
part counts. A manifest is written whole under the next number after the parts it names, so a reader sees all of an
upsert or nothing of it, and a writer that is lost leaves files that no manifest names. Two writers at once must not be.
Values may be null: a null that was fetched is kept like any other, until it is older than ``ttl_ms``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """part and folder by the latest manifest; None if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    numbers = [int(s.getPath().getName()) for s in system.listStatus(folder) if s.getPath().getName().isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema("number long, part int, folder string").json(f"{path}/manifest/{max(numbers)}") if numbers else None


def read(spark: SparkSession, path: str, schema: str, now: int | None = None, ttl_ms: int | None = None, fetched: str = "fetched_at") -> DataFrame:
    """The rows that count; with ``ttl_ms`` those fetched no longer ago than that. No rows where nothing was written."""
    current = _manifests(spark, path)
    folders = [r["folder"] for r in current.select("folder").collect()] if current is not None else []  # at most PARTS
    rows = spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
    return rows.where(F.lit(now) - F.col(fetched) <= ttl_ms) if ttl_ms is not None else rows


def upsert(rows: DataFrame, path: str, key: str, version: str, parts: int = PARTS) -> None:
    """Adds ``rows``, of which the row with the greatest ``version`` of each ``key`` counts, also against those that are there.

    Only the parts that ``rows`` fall into are read and written; ``parts`` must be the same each time. Equal versions: any one.
    Null keys are a key.
    """
    spark = rows.sparkSession
    columns = rows.columns
    place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    new = rows.withColumn("_part", place).checkpoint()
    touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most PARTS
    if not touched:
        return
    current = _manifests(spark, path)
    held = {r["part"]: r for r in current.collect()} if current is not None else {}
    folders = [f"{path}/{held[p]['folder']}" for p in touched if p in held]
    every = new
    if folders:
        every = every.unionByName(spark.read.schema(rows.schema).parquet(*folders).withColumn("_part", place))
    latest = every.groupBy(F.col("_part"), F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(F.col(version).isNotNull(), version)).alias("r")).select("_part", "r.*")
    name = uuid.uuid4().hex
    latest.repartition("_part").write.partitionBy("_part").parquet(f"{path}/parts/{name}")
    number = max((r["number"] for r in held.values()), default=0) + 1
    kept = [(number, p, r["folder"]) for p, r in held.items() if p not in touched]
    manifest = spark.createDataFrame([*kept, *((number, p, f"parts/{name}/_part={p}") for p in touched)], "number long, part int, folder string")
    manifest.coalesce(1).write.json(f"{path}/manifest/{number}")
