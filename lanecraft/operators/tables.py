"""Caches, logs, audits and benchmark reports as queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecraft.functions import geo, streets

from . import graph

DAY_MS = 86_400_000


def expired(now: Column, fetched: Column, days: int = 30) -> Column:
    return now - fetched > days * DAY_MS


def evicted(cache: DataFrame, now: int, most: int, days: int = 30) -> DataFrame:
    """key and why of what leaves a cache of ``(key, ord, fetched_at, last_accessed)``: the expired, then the longest unused above ``most``.

    The cut is found from the side of those that stay, which are at most ``most``: the first of them is the threshold.
    ``ord`` tells apart what was accessed at one time; a null access counts as the oldest.
    """
    old = cache.where(expired(F.lit(now), F.col("fetched_at"), days))
    rest = cache.where(~expired(F.lit(now), F.col("fetched_at"), days))
    newest = rest.select("last_accessed", "ord").orderBy(F.desc("last_accessed"), F.desc("ord")).limit(most)
    edge = newest.agg(F.min(F.struct("last_accessed", "ord")).alias("edge"), F.count("*").alias("n")).first()
    if most and edge["n"] < most:
        oldest = rest.limit(0)
    elif not most:
        oldest = rest
    else:
        at, place = (F.lit(edge["edge"][c]).cast(rest.schema[c].dataType) for c in ("last_accessed", "ord"))
        oldest = rest.where(F.struct("last_accessed", "ord") < F.struct(at.alias("last_accessed"), place.alias("ord")))
    return old.select("key", F.lit("expired").alias("why")).unionByName(oldest.select("key", F.lit("unused").alias("why")))


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key of both."""
    every = old.unionByName(new)
    return every.groupBy(key).agg(F.max_by(F.struct(*every.columns), version).alias("r")).select("r.*")


def merged_preferences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Preferences by name: the new text, but the date of creation of the old row."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col("a.name") == F.col("b.name"), "full_outer").select(
        F.coalesce("b.name", "a.name").alias("name"), F.coalesce("b.text", "a.text").alias("text"), F.coalesce("a.created_at", "b.created_at").alias("created_at")
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most).drop("_at")


def audit_groups(ways: DataFrame, samples: int = 5, t: streets.Tags = streets.flat) -> DataFrame:
    """signature, item, ways, km and the first ``samples`` way ids (as text) of a scan whose ways may be there twice.

    Samples are the smallest ids; they are cut before they are gathered, so a group of any size sends a few from each task.
    """
    once = graph.with_class(ways.dropDuplicates(["way_id"]), t)
    keyed = once.select("way_id", streets.signature(t).alias("signature"), "item", (geo.length(F.col("coords")) / 1000).alias("km"))
    sums = keyed.groupBy("signature", "item").agg(F.count("*").alias("ways"), F.sum("km").alias("km"))
    first = latest(keyed, ["signature", "item"], [F.col("way_id").asc()], samples).groupBy("signature", "item").agg(F.array_join(F.array_sort(F.collect_list(F.col("way_id"))), ",").alias("samples"))
    return sums.join(first, (sums["signature"] == first["signature"]) & sums["item"].eqNullSafe(first["item"])).select(sums["signature"], sums["item"], "ways", "km", "samples")


def audit_bucket(accepted: Column, walks: Column, mult: Column) -> Column:
    return F.when(~accepted | walks | (mult > 1.01), "not-preferred").otherwise("preferred")


def audit_tag(accepted: Column, walks: Column, mult: Column) -> Column:
    return F.when(~accepted, "rej").when(walks, "walk").when(mult > 1.01, "rough").otherwise("ok")


def compared(samples: DataFrame, engines: list[str], own: str = "client") -> DataFrame:
    """One row per city, mode and pair with km and pct of each engine. Missing engines are null."""
    return samples.groupBy("city", "mode", "pair").pivot("engine", engines).agg(F.first("km").alias("km"), F.first("pct").alias("pct"))


def verdict(own: Column, other: Column, margin: float = 0.05) -> Column:
    """W, T or L; null if one is missing."""
    d = own - other
    return F.when(d > margin, "W").when(d < -margin, "L").when(d.isNotNull(), "T")


def shortest_rival(engines: list[str]) -> Column:
    return F.array_min(F.array(*(F.col(f"{e}_km") for e in engines)))


def ranked(routes: DataFrame, slack: float = 1.75) -> DataFrame:
    """Routes of a request: those not over ``slack`` times the fastest first, then by preferred share; ties keep their order."""
    w = Window.partitionBy("request")
    out = routes.withColumn("eligible", F.col("seconds") <= F.min("seconds").over(w) * slack)
    return out.withColumn("place", F.row_number().over(w.orderBy(F.col("eligible").desc(), F.col("preferred").desc(), "ord")))


def debounced(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """Events after which none of their key follows within the gap."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    following = F.lead(F.col(ts)).over(w)
    return events.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") - F.col(ts) > gap_ms)).drop("_next")


def verified(fixtures: DataFrame, geocoded: DataFrame, error_m: float = 150.0, warn_m: float = 50.0) -> DataFrame:
    """id, severity and metres of the distinct places of ``fixtures(id, lat, lng)`` against ``geocoded(id, lat, lng)``.

    A place that wasn't geocoded is skipped; one that was without a result has no match.
    """
    once = fixtures.groupBy("id").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    found = geocoded.select("id", F.col("lat").alias("glat"), F.col("lng").alias("glng"), F.lit(True).alias("asked"))
    metres = F.when(F.col("glat").isNotNull(), geo.haversine(F.col("lat"), F.col("lng"), F.col("glat"), F.col("glng")))
    severity = F.when(F.col("asked").isNull(), "skipped").when(metres.isNull(), "no-match").when(metres >= error_m, "error").when(metres >= warn_m, "warn").otherwise("ok")
    return once.join(found, "id", "left").select("id", severity.alias("severity"), metres.alias("metres"))


def run_summary(samples: DataFrame, engines: list[str], own: str = "client") -> DataFrame:
    """One row of a run: samples, the mean share preferred of each engine, and how many samples are flagged as too long."""
    least = shortest_rival([e for e in engines if e != own])
    means = (F.coalesce(F.avg(f"{e}_pct"), F.lit(0.0)).alias(f"{e}_pct") for e in engines)
    return compared(samples, engines, own).agg(F.count("*").alias("samples"), *means, F.count_if(F.col(f"{own}_km") > 1.2 * least).alias("flagged"))


def filtered_audit(groups: DataFrame, statuses: list[str], text: str = "") -> DataFrame:
    """Audit groups of some statuses whose signature or item holds a text, whatever its case."""
    held = F.contains(F.lower(F.concat_ws(" ", "signature", "item")), F.lit(text.strip().lower()))
    return groups.where(F.col("status").isin(statuses) & held)


def touched(cache: DataFrame, reads: DataFrame, days: int = 30) -> DataFrame:
    """A cache ``(key, fetched_at, last_accessed)`` after ``reads(key, at)``: a read that still finds its entry touches it."""
    hit = (F.col("at") >= F.col("fetched_at")) & ~expired(F.col("at"), F.col("fetched_at"), days)
    last = reads.join(cache.select("key", "fetched_at"), "key").where(hit).groupBy("key").agg(F.max("at").alias("_at"), F.count("*").alias("hits"))
    return cache.join(last, "key", "left").select("key", "fetched_at", F.greatest("last_accessed", F.coalesce("_at", "last_accessed")).alias("last_accessed"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def without(preferences: DataFrame, gone: DataFrame) -> DataFrame:
    """Preferences but those whose name is in ``gone``."""
    return preferences.join(gone.select("name").distinct(), "name", "left_anti")


def activated(preferences: DataFrame, chosen: str | None) -> DataFrame:
    """Preferences with ``active``: only the chosen one is, and none if no preference has that name."""
    return preferences.withColumn("active", F.coalesce(F.col("name") == F.lit(chosen), F.lit(False)))
