"""Small fixed tables: modes, the legend, regions and cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAVED = ["asphalt", "concrete", "paving_stones", "compacted"]
SOFT = [*PAVED, "wood", "fine_gravel"]
SMOOTH = ["asphalt", "concrete", "compacted"]
#: Mode, accepted levels, multipliers by level, surfaces, cobbles, ride, slow and walk km/h, gradient cap in %, refused items. Fixed values.
MODES = [
    ("kid-starting-out", ["1a"], {}, SOFT, "walk", 5.0, 3.0, 1.0, 5.0, []),
    ("kid-confident", ["1a", "1b"], {}, SOFT, "slow", 10.0, 5.0, 2.0, 5.0, []),
    ("kid-traffic-savvy", ["1a", "1b", "2a", "2b"], {"2a": 1.5, "2b": 1.5}, PAVED, "reject", 16.0, 10.0, 3.0, 7.0, []),
    ("carrying-kid", ["1a", "1b", "2a", "2b"], {"2a": 1.2, "2b": 1.2}, SMOOTH, "reject", 20.0, 12.0, 4.0, 7.0, []),
    ("training", ["1a", "1b", "2a", "2b", "3"], {}, SMOOTH, "reject", 30.0, 20.0, 5.0, 8.0, ["Elevated sidewalk path"]),
]
ROUGH_MULT = 5.0
DEFAULT_MODE = "kid-starting-out"
#: Legend item and its level. Fixed values.
ITEMS = {
    "Bike path": "1a", "Shared use path": "1a", "Elevated sidewalk path": "1a", "Fahrradstrasse": "1b", "Living street": "1b", "Bike boulevard": "1b",
    "Painted bike lane on quiet street": "2a", "Shared bus lane on quiet street": "2a", "Quiet street": "2b", "Painted bike lane on major road": "3", "Major road": "3",
}
#: Levels that a mode prefers, and items it doesn't although of such a level. Fixed values.
PREFERRED = {
    "kid-starting-out": (["1a"], []), "kid-confident": (["1a", "1b"], []), "kid-traffic-savvy": (["1a", "1b", "2a"], []),
    "carrying-kid": (["1a", "1b", "2a"], ["Elevated sidewalk path"]), "training": (["1a", "1b", "2a"], ["Elevated sidewalk path"]),
}
OPTIONAL_LEVELS = ("2b", "3")
#: Region rules in order. Fixed values.
BERLIN = [
    {"kind": "promote", "names": ["Landwehrkanal", "Mauerweg", "Berliner Mauerweg", "Teltowkanal", "Spreeweg"], "lts": 1, "car_free": True},
    {"kind": "demote", "names": ["Oranienstraße", "Oranienstrasse"], "tags": {"highway": "tertiary"}, "lts": 3, "clear_priority": True},
    {"kind": "zone", "box": (52.5160, 13.3950, 52.5260, 13.4200), "surface": "cobblestone"},
]
#: City, south, west, north, east. Fixed values.
CITIES = [
    ("Amsterdam", 52.30, 4.80, 52.42, 5.00), ("Antwerp", 51.17, 4.35, 51.28, 4.50), ("Berkeley", 37.85, -122.32, 37.92, -122.23), ("Berlin", 52.34, 13.08, 52.68, 13.76),
    ("Bogotá", 4.55, -74.15, 4.75, -74.05), ("Bordeaux", 44.80, -0.65, 44.88, -0.54), ("Buenos Aires", -34.66, -58.52, -34.52, -58.35), ("Cape Town", -34.00, 18.40, -33.85, 18.55),
    ("Copenhagen", 55.61, 12.45, 55.73, 12.65), ("Hamburg", 53.40, 9.80, 53.65, 10.20), ("Kigali", -1.99, 30.03, -1.92, 30.13), ("Malmö", 55.54, 12.94, 55.63, 13.08),
    ("Marin", 37.83, -122.60, 38.08, -122.40), ("Munich", 48.08, 11.46, 48.22, 11.68), ("Oakland", 37.73, -122.33, 37.85, -122.16), ("Oslo", 59.87, 10.66, 59.97, 10.85),
    ("Paris", 48.80, 2.23, 48.92, 2.42), ("Portland, OR", 45.46, -122.74, 45.60, -122.57), ("San Francisco", 37.70, -122.52, 37.81, -122.35), ("Strasbourg", 48.53, 7.69, 48.62, 7.82),
    ("Taipei", 25.00, 121.48, 25.12, 121.60), ("Tokyo", 35.60, 139.65, 35.78, 139.85), ("Utrecht", 52.04, 5.05, 52.13, 5.18), ("Vancouver, BC", 49.20, -123.22, 49.31, -123.02), ("Vienna", 48.14, 16.28, 48.28, 16.47),
]


def modes(spark: SparkSession, overrides: dict[str, dict] | None = None, rough: float | None = None) -> DataFrame:
    """One row per mode. ``overrides`` (by mode: rough_mult, level_mult and speeds) win over ``rough``, that over the defaults."""
    rows = []
    for mode, accepted, mult, surfaces, cobbles, ride, slow, walk, gradient, refused in MODES:
        own = (overrides or {}).get(mode, {})
        rows.append((mode, accepted, {**mult, **own.get("level_mult", {})}, surfaces, cobbles, own.get("ride_kmh", ride), own.get("slow_kmh", slow), own.get("walk_kmh", walk), gradient, refused, own.get("rough_mult", rough if rough is not None else ROUGH_MULT)))
    schema = "mode string, accepted array<string>, level_mult map<string,double>, surfaces array<string>, cobbles string, ride_kmh double, slow_kmh double, walk_kmh double, gradient_cap double, reject_items array<string>, rough_mult double"
    return spark.createDataFrame(rows, schema)


def preferred(mode: str, optional: bool = False) -> list[str]:
    """Items that a mode prefers; with ``optional`` also those of the optional levels. An unknown mode prefers none."""
    if mode not in PREFERRED:
        return []
    levels, without = PREFERRED[mode]
    return [i for i, level in ITEMS.items() if level in levels and i not in without or optional and level in OPTIONAL_LEVELS]


def legend(spark: SparkSession, optional: bool = False) -> DataFrame:
    rows = [(mode, item, level, item in preferred(mode, optional), k) for mode in PREFERRED for k, (item, level) in enumerate(ITEMS.items())]
    return spark.createDataFrame(rows, "mode string, item string, level string, preferred boolean, ord int")


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, k) for k, c in enumerate(CITIES)], "city string, south double, west double, north double, east double, ord int")


def with_rule(rows: DataFrame, asked: str, modes: DataFrame) -> DataFrame:
    """``rows`` with the columns of the mode that the column ``asked`` names; the default's where it names none of them."""
    known = F.broadcast(modes.select(F.col("mode").alias("_known")))
    named = rows.join(known, F.col(asked) == F.col("_known"), "left").withColumn("mode", F.coalesce("_known", F.lit(DEFAULT_MODE))).drop("_known")
    return named.join(F.broadcast(modes), "mode")


def visible(mode: Column, opted: Column, selected: Column) -> Column:
    """Whether a user sees a mode: training only if they opted in, or have it selected."""
    return (mode != "training") | opted | (selected == mode)


def resolved(asked: Column, has_key: Column, needs_key: list[str], known: list[str], fallback: str) -> tuple[Column, Column]:
    """What is used for what is asked, and why it is another: "unknown" or "no-key"."""
    reason = F.when(asked.isNull(), None).when(~asked.isin(known), "unknown").when(asked.isin(needs_key) & ~has_key, "no-key")
    return F.when(asked.isNotNull() & reason.isNull(), asked).otherwise(fallback), reason


def merged(defaults: Column, own: Column) -> Column:
    """A map of defaults under one of own settings."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)


def merged_by_mode(defaults: Column, own: Column) -> Column:
    """The same a level deeper: maps of settings by mode. A mode that only one of the two names keeps what that one says; null is an empty map."""
    empty = F.create_map().cast("map<string,map<string,double>>")
    inner = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(defaults, empty), F.coalesce(own, empty), lambda _, a, b: merged(F.coalesce(a, inner), F.coalesce(b, inner)))
