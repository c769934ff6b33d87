"""Segments of a route: islands of equal items, healing of short gaps, and how good a route is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecraft.functions import geo


def islands(points: DataFrame, route: str, order: str, same: Column, first: str = "seg") -> DataFrame:
    """``points`` with the number of their island: a new one where ``same`` (of the point before) isn't true."""
    w = Window.partitionBy(route).orderBy(order)
    starts = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return points.withColumn("_new", starts).withColumn(first, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def segments(points: DataFrame) -> DataFrame:
    """route, seg, item, is_walking, path_level, n_coords, metres, start and stop of ``points(route, idx, lat, lng, item, is_walking)``.

    The path level is that of its points where they have one (``path_level``), else null; start and stop are its ends as
    (lat, lng). Walked points are one kind whatever their item, and have none. A segment after the first also holds the last point
    of the one before, so the segments' lengths add up to the route's. Where points tell by which way they were come to
    (``way_id``), ``way_ids`` are those of its points, in order.
    """
    w = Window.partitionBy("route").orderBy("idx")
    kind = F.when(F.col("is_walking"), F.lit("\u0001walk")).otherwise(F.col("item"))
    keyed = points.withColumn("_kind", kind)
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0))
    keyed = keyed.withColumn("_step", step)
    point = F.struct("lat", "lng")
    keyed = keyed.withColumn("_from", F.coalesce(F.lag(point).over(w), point))
    level = F.first("path_level") if "path_level" in points.columns else F.lit(None).cast("string")
    travelled = []
    if "way_id" in points.columns:
        keyed = keyed.withColumn("_ways", F.array_compact(F.array(F.lag("way_id").over(w), F.col("way_id"))))
        travelled = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ways")))).alias("way_ids")]
    found = islands(keyed, "route", "idx", F.col("_kind").eqNullSafe(F.lag("_kind").over(w)))
    return found.groupBy("route", "seg").agg(
        F.first(F.when(~F.col("is_walking"), F.col("item"))).alias("item"),
        F.first("is_walking").alias("is_walking"),
        level.alias("path_level"),
        (F.count("*") + F.when(F.col("seg") > 0, 1).otherwise(0)).alias("n_coords"),
        F.sum("_step").alias("metres"),
        F.min_by("_from", "idx").alias("start"),
        F.max_by(point, "idx").alias("stop"),
        *travelled,
    )


def healed(segments: DataFrame, preferred: Column, most: int = 5) -> DataFrame:
    """Short segments between two preferred ones take the item and the path level of the one before; never walked ones, never the ends."""
    w = Window.partitionBy("route").orderBy("seg")
    good = preferred & ~F.col("is_walking")
    out = segments.withColumn("_good", F.coalesce(good, F.lit(False)))
    gap = ~F.col("is_walking") & ~F.col("_good") & (F.col("n_coords") <= most) & F.lag("_good").over(w) & F.lead("_good").over(w)
    gap = F.coalesce(gap, F.lit(False))
    taken = {c: F.when(gap, F.lag(c).over(w)).otherwise(F.col(c)) for c in ("item", "path_level")}
    return out.withColumns({"healed": gap, **taken}).drop("_good")


def coalesced(segments: DataFrame, gap_m: float = 20.0) -> DataFrame:
    """``segments`` with ``run``: neighbours of one item, of which one begins within ``gap_m`` of where the other ends, are one run."""
    w = Window.partitionBy("route").orderBy("seg")
    gap = geo.haversine(F.lag("stop.lat").over(w), F.lag("stop.lng").over(w), F.col("start.lat"), F.col("start.lng"))
    return islands(segments, "route", "seg", F.col("item").eqNullSafe(F.lag("item").over(w)) & (gap <= gap_m), "run")


LEVELS = ("1a", "1b", "2a", "2b", "3", "4")


def quality(segments: DataFrame, preferred: Column, by_level: bool = False) -> DataFrame:
    """Shares of a route's length that are preferred, other and walked; zeros for a route without length.

    With ``by_level`` also ``by_level``, a map from path level to the share that is preferred and of that level, without levels that have none.
    """
    good = F.coalesce(preferred, F.lit(False))
    part = lambda c: F.sum(F.when(c, F.col("metres")).otherwise(0.0))
    total = F.sum("metres")
    share = lambda c: F.when(total > 0, part(c) / total).otherwise(0.0)
    walk = F.col("is_walking")
    columns = [share(~walk & good).alias("preferred"), share(~walk & ~good).alias("other"), share(walk).alias("walking")]
    if by_level:
        entries = F.array(*(F.struct(F.lit(k).alias("k"), share(~walk & good & F.coalesce(F.col("path_level") == k, F.lit(False))).alias("v")) for k in LEVELS))
        columns.append(F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0)).alias("by_level"))
    return segments.groupBy("route").agg(*columns)


def lts_breakdown(segments: DataFrame) -> DataFrame:
    """Shares of length by lts, the worst lts (1 if there is no length) and the family score of ``segments(route, lts, metres)``."""
    total = F.sum("metres")
    shares = {f"p{k}": F.when(total > 0, F.sum(F.when(F.col("lts") == k, F.col("metres")).otherwise(0.0)) / total).otherwise(0.0) for k in (1, 2, 3, 4)}
    out = segments.groupBy("route").agg(*(c.alias(k) for k, c in shares.items()), F.when(total > 0, F.max("lts")).otherwise(1).alias("worst"))
    raw = F.floor(F.col("p1") * 100 + F.col("p2") * 70 + F.col("p3") * 30 + 0.5)
    return out.withColumn("score", F.when(F.col("p4") > 0, F.least(raw, F.lit(40))).when(F.col("p3") > 0.1, F.least(raw, F.lit(60))).otherwise(raw).cast("long"))


def score_label(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 70, "yellow").when(score >= 50, "orange").otherwise("red")
