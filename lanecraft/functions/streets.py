"""Street classification as Column expressions over the tags of a way.

Tags are optional strings. A missing tag is null, and tests for a value are false then; tests that a tag is *not* a
value must say so with null-safe equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import once

Tags = Callable[[str], Column]


def flat(key: str) -> Column:
    """A tag that is promoted to a column, as ``sources.ways`` has them."""
    return F.col(key.replace(":", "_"))


def of_map(column: str = "tags") -> Tags:
    return lambda key: F.col(column)[key]


def is_in(value: Column, options: Iterable[str]) -> Column:
    """Never null, so that it can be negated."""
    return F.coalesce(value.isin(*options), F.lit(False))


def is_(value: Column, option: str) -> Column:
    return value.eqNullSafe(F.lit(option))


# --- Fixed values -----------------------------------------------------------------------------------------------
CYCLEWAY_KEYS = ("cycleway", "cycleway:right", "cycleway:left", "cycleway:both")
CYCLEWAY_VALUES = ("track", "lane", "opposite_track", "opposite_lane", "share_busway")
SEPARATION_KEYS = ("cycleway:separation", "cycleway:right:separation", "cycleway:left:separation", "cycleway:both:separation")
SEPARATION_VALUES = ("flex_post", "separation_kerb", "guard_rail")
ROUGH_SURFACES = ("mud", "sand", "grass", "gravel", "pebblestone", "woodchips", "cobblestone", "sett", "unhewn_cobblestone", "cobblestone:flattened")
COBBLES = ("cobblestone", "sett", "unhewn_cobblestone")
BAD_SMOOTHNESS = ("bad", "very_bad", "horrible", "very_horrible", "impassable")
SIGNATURE_KEYS = ("highway", "bicycle_road", "cyclestreet", "cycleway", "cycleway:right", "cycleway:left", "cycleway:both", "surface", "smoothness", "maxspeed", "bicycle", "segregated", "tracktype")
ROAD_RANK = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6, "service_other": 7}
DEFAULT_SPEED = {"living_street": 15, "residential": 30, "unclassified": 30, "tertiary": 50, "secondary": 50, "primary": 60, "trunk": 80}
DENSITY = {"living_street": "low", "residential": "low", "unclassified": "low", "tertiary": "moderate", "secondary": "moderate", "primary": "high", "trunk": "high"}


def number(value: Column) -> Column:
    """Leading integer of a tag: 0 if the tag is missing, null if it begins with no number."""
    digits = F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(value.isNull(), F.lit(0)).otherwise(F.nullif(digits, F.lit("")).try_cast("int"))


@once
def lane_kind(t: Tags) -> Column:
    """The first cycleway key that is there; the left one isn't looked at."""
    return F.coalesce(t("cycleway"), t("cycleway:right"), t("cycleway:both"))


def any_lane(t: Tags, values: Iterable[str]) -> Column:
    """Any of the four cycleway keys."""
    out = F.lit(False)
    for key in CYCLEWAY_KEYS:
        out = out | is_in(t(key), values)
    return out


@once
def overlay_scan(t: Tags) -> Column:
    """Which ways the overlay asks for; six branches, an element of several is there once."""
    highway = t("highway")
    return (
        is_(highway, "cycleway")
        | is_(t("bicycle_road"), "yes")
        | is_(highway, "living_street")
        | (is_in(highway, ("residential", "path", "track")) & ~is_(t("bicycle"), "no"))
        | (is_(highway, "footway") & is_in(t("bicycle"), ("yes", "designated")))
        | any_lane(t, CYCLEWAY_VALUES)
    )


@once
def audit_scan(t: Tags) -> Column:
    highway = t("highway")
    return (
        is_(highway, "cycleway")
        | is_(t("bicycle_road"), "yes")
        | is_(t("cyclestreet"), "yes")
        | is_in(highway, ("living_street", "residential", "tertiary", "unclassified"))
        | (is_(highway, "service") & ~is_(t("service"), "parking_aisle"))
        | (is_in(highway, ("path", "track")) & ~is_(t("bicycle"), "no"))
        | (is_(highway, "footway") & is_in(t("bicycle"), ("yes", "designated")))
        | any_lane(t, CYCLEWAY_VALUES)
    )


def mapped(value: Column, options: dict) -> Column:
    out = F.lit(None)
    for key, result in reversed(options.items()):
        out = F.when(is_(value, key), F.lit(result)).otherwise(out)
    return out


def classified(t: Tags, lane: Column | None = None, speed: Column | None = None, lanes: Column | None = None) -> dict[str, Column]:
    """lts, path_level, car_free, bike_priority, bike_infra, speed_kmh, density, surface and smoothness of a way.

    ``lane``, ``speed`` and ``lanes`` are columns that hold what ``lane_kind`` and ``number`` say, if there are any.
    """
    highway, bicycle = t("highway"), t("bicycle")
    lane = lane_kind(t) if lane is None else lane
    speed, lanes = number(t("maxspeed")) if speed is None else speed, number(t("lanes")) if lanes is None else lanes
    road = is_(t("bicycle_road"), "yes") | is_(t("cyclestreet"), "yes")
    on_foot = is_(highway, "footway") & is_in(bicycle, ("yes", "designated"))
    on_path = is_(highway, "path") & ~is_(bicycle, "no")
    track, painted, bus = is_in(lane, ("track", "opposite_track")), is_in(lane, ("lane", "opposite_lane")), is_(lane, "share_busway")
    living, residential = is_(highway, "living_street"), is_(highway, "residential")
    no_cars = is_(t("motor_vehicle"), "no") | is_(t("access"), "no")
    car_free = is_in(highway, ("cycleway", "pedestrian", "track")) | on_path | on_foot | track | no_cars
    priority = road | living | (residential & is_in(t("motor_vehicle"), ("destination", "permissive")))
    infra = is_(highway, "cycleway") | on_path | on_foot | road | track | painted | bus
    by_foot = is_in(highway, ("cycleway", "path", "footway", "pedestrian"))
    kmh = F.when(speed > 0, speed).when(by_foot, F.lit(None)).otherwise(mapped(highway, DEFAULT_SPEED)).cast("int")
    lts = (
        F.when(is_in(highway, ("cycleway", "path", "pedestrian", "track")) | on_foot | living | road, 1)
        .when(track, F.when(speed > 50, 2).otherwise(1))
        .when(residential & ((speed <= 30) | (speed == 0)) & (lanes <= 2), 1)
        .when(painted, F.when(((speed <= 30) & (lanes <= 2)) | ((speed <= 50) & (lanes <= 3)), 2).otherwise(3))
        .when(bus, 2)
        .when(residential, F.when((speed <= 50) & (lanes <= 3), 2).otherwise(3))
        .when(is_(highway, "tertiary"), F.when(speed <= 30, 2).when(speed <= 50, 3).otherwise(4))
        .when(is_(highway, "unclassified"), F.when(speed <= 30, 2).otherwise(3))
        .when(is_in(highway, ("secondary", "primary", "trunk")), 4)
        .otherwise(3)
    )
    level = path_level(lts, car_free, priority, infra, kmh)
    density = F.when(by_foot, F.lit(None)).otherwise(mapped(highway, DENSITY)).cast("string")
    return {
        "lts": lts, "path_level": level, "car_free": car_free, "bike_priority": priority, "bike_infra": infra,
        "speed_kmh": kmh, "density": density, "surface_": t("surface"), "smoothness_": t("smoothness"),
    }


def path_level(lts: Column, car_free: Column, priority: Column, infra: Column, kmh: Column) -> Column:
    calm = kmh.isNull() | (kmh <= 30)
    return F.when(lts == 4, "4").when(lts == 3, "3").when(car_free, "1a").when(priority, "1b").when(infra & calm, "2a").when(infra, "3").otherwise("2b")


@once
def separated(t: Tags) -> Column:
    out = t("cycleway:buffer").isNotNull() & (F.coalesce(t("cycleway:buffer"), F.lit("")) != "")
    for key in SEPARATION_KEYS:
        out = out | is_in(t(key), SEPARATION_VALUES)
    return out


def item(t: Tags, level: Column) -> Column:
    """The legend's name for a way of a level; null on level 4."""
    highway = t("highway")
    track, lane, bus = any_lane(t, ("track", "opposite_track")), any_lane(t, ("lane", "opposite_lane")), any_lane(t, ("share_busway",))
    shared = is_(highway, "footway") | (is_(highway, "path") & is_in(t("bicycle"), ("yes", "designated")))
    local = is_(highway, "residential") & is_in(t("motor_vehicle"), ("destination", "permissive"))
    road = is_(t("bicycle_road"), "yes") | is_(t("cyclestreet"), "yes")
    free = F.when(shared, "Shared use path").when(track | (lane & separated(t)), "Elevated sidewalk path").otherwise("Bike path")
    priority = F.when(road, "Fahrradstrasse").when(is_(highway, "living_street"), "Living street").when(local, "Bike boulevard").otherwise("Fahrradstrasse")
    return (
        F.when(level == "1a", free)
        .when(level == "1b", priority)
        .when(level == "2a", F.when(bus, "Shared bus lane on quiet street").otherwise("Painted bike lane on quiet street"))
        .when(level == "2b", "Quiet street")
        .when(level == "3", F.when(lane | bus, "Painted bike lane on major road").otherwise("Major road"))
    )


def by_rules(t: Tags, rules: list[tuple[dict[str, str], str]], otherwise: Column) -> Column:
    """The first rule all of whose tags match; a rule without tags matches all."""
    out = otherwise
    for match, name in reversed(rules):
        hit = F.lit(True)
        for key, value in match.items():
            hit = hit & is_(t(key), value)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def rough(surface: Column, smoothness: Column) -> Column:
    return is_in(smoothness, BAD_SMOOTHNESS) | is_in(surface, ROUGH_SURFACES)


@once
def walking_only(t: Tags) -> Column:
    highway = t("highway")
    return is_(highway, "steps") | (is_in(highway, ("footway", "pedestrian")) & ~is_in(t("bicycle"), ("yes", "designated")))


#: Classes one can't walk along, and classes that need no sidewalk to be walked. Fixed values.
NO_WALK = ("motorway", "motorway_link", "trunk", "trunk_link", "raceway", "construction", "proposed")
SELF_WALK = ("cycleway", "path", "track", "footway", "pedestrian", "steps", "living_street", "bridleway", "service")


@once
def bridge_walkable(t: Tags) -> Column:
    """Whether a rejected way may be walked to reach the next good one."""
    none = ("no", "none")
    without = is_in(t("sidewalk"), none) | is_(t("sidewalk:both"), "no") | (is_(t("sidewalk:left"), "no") & is_(t("sidewalk:right"), "no"))
    refused = is_in(t("highway"), NO_WALK) | is_(t("foot"), "no") | is_in(t("access"), ("no", "private"))
    return ~refused & (is_in(t("highway"), SELF_WALK) | ~without)


@once
def one_way(t: Tags) -> Column:
    return (is_(t("oneway"), "yes") | is_(t("oneway:bicycle"), "yes")) & ~is_(t("oneway:bicycle"), "no")


@once
def signature(t: Tags) -> Column:
    """The tags that count for an audit, as k=v in fixed order; missing ones are left out."""
    return F.concat_ws("|", *(F.when(t(k).isNotNull(), F.concat(F.lit(f"{k}="), t(k))) for k in SIGNATURE_KEYS))


def external_item(use: Column, lane: Column, road_class: Column, bicycle_road: Column) -> Column:
    """The legend's name for an edge as another router describes it."""
    rank = F.coalesce(mapped(road_class, ROAD_RANK), F.lit(5))
    return (
        F.when(F.coalesce(bicycle_road, F.lit(False)), "Fahrradstrasse")
        .when(is_in(use, ("cycleway", "path", "mountain_bike")), "Bike path")
        .when(is_in(use, ("footway", "pedestrian")), "Shared use path")
        .when(is_(lane, "separated"), "Elevated sidewalk path")
        .when(is_(lane, "dedicated"), "Painted bike lane on quiet street")
        .when(is_(use, "living_street"), "Living street")
        .when(is_(lane, "share_busway"), "Shared bus lane on quiet street")
        .when(is_(lane, "shared"), F.lit(None))
        .when(rank >= 6, "Quiet street")
        .when(rank >= 4, "Major road")
    )


def overlaid(cls: dict[str, Column], name: Column, t: Tags, lat: Column, lng: Column, rules: list[dict], derive: bool = False) -> dict[str, Column]:
    """A classification after a region's rules, in order. The path level stays unless ``derive`` asks for it anew."""
    out = dict(cls)
    for rule in rules:
        hit = F.lit(True)
        if names := rule.get("names"):
            hit = F.lit(False)
            for part in names:
                hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(part.lower())), F.lit(False))
        if refs := rule.get("refs"):
            hit = hit & is_in(t("ref"), refs)
        for key, value in rule.get("tags", {}).items():
            hit = hit & is_(t(key), value)
        if rule["kind"] == "promote":
            out["lts"] = F.when(hit, F.least(out["lts"], F.lit(rule["lts"]))).otherwise(out["lts"])
            for flag in ("car_free", "bike_priority", "bike_infra"):
                if rule.get(flag):
                    out[flag] = out[flag] | hit
        elif rule["kind"] == "demote":
            out["lts"] = F.when(hit, F.greatest(out["lts"], F.lit(rule["lts"]))).otherwise(out["lts"])
            if rule.get("clear_priority"):
                out["bike_priority"] = out["bike_priority"] & ~hit
        else:
            south, west, north, east = rule["box"]
            inside = F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))
            out["surface_"] = F.when(inside, F.lit(rule["surface"])).otherwise(out["surface_"])
    if derive:
        out["path_level"] = path_level(out["lts"], out["car_free"], out["bike_priority"], out["bike_infra"], out["speed_kmh"])
    return out


def tolerant(surface: Column, fine: list[str]) -> Column:
    """A rider who doesn't mind a surface sees none."""
    return F.when(~is_in(surface, fine), surface) if fine else surface


def decision(level: Column, item_name: Column, surface: Column, smoothness: Column, m: Callable[[str], Column]) -> dict[str, Column]:
    """What a mode (columns that ``m`` names) does with a way: accepted, reason, walks, speed and multiplier."""
    cobbles = is_in(surface, COBBLES)
    is_rough = rough(surface, smoothness)
    times = F.coalesce(F.element_at(m("level_mult"), level), F.lit(1.0))
    # Right of the first test that holds.
    reason = (
        F.when(~F.array_contains(m("accepted"), level), "level")
        .when(F.coalesce(F.array_contains(m("reject_items"), item_name), F.lit(False)), "path-type")
        .when(cobbles & (m("cobbles") == "reject"), "cobbles")
        .when(~cobbles & surface.isNotNull() & ~F.coalesce(F.array_contains(m("surfaces"), surface), F.lit(False)), "surface")
    )
    ok = reason.isNull()
    walks = ok & cobbles & (m("cobbles") == "walk")
    speed = F.when(walks, m("walk_kmh")).when(ok & cobbles, m("slow_kmh")).when(ok, m("ride_kmh"))
    factor = F.when(is_rough, m("rough_mult")).otherwise(F.lit(1.0))
    return {"accepted_": ok, "reason": reason, "walks": walks, "kmh": speed, "mult": F.when(ok & cobbles, factor).when(ok, factor * times)}


def tag_rows(t: Tags, keys: list[str]) -> Column:
    """The tags that are there, as k=v."""
    return F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), t(k)) for k in keys)))
