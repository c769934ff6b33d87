"""Geometry on the sphere and on tile grids, as Column expressions in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def length(coords: Column) -> Column:
    """Metres along an array of (lat, lng) structs, without a shuffle."""
    n = F.size(coords)
    legs = F.zip_with(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def midpoint(coords: Column) -> Column:
    return F.element_at(coords, (F.floor(F.size(coords) / 2) + 1).cast("int"))


def tile(degrees: Column, size: float = 0.1) -> Column:
    """Row or column of a tile; IEEE division, as a decimal would put some edges into another tile."""
    return F.floor(degrees / F.lit(size)).cast("int")


def mercator_tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional x and y at a zoom."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    return (lng + 180.0) / 360.0 * n, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * n


def pixel(fraction: Column, size: int = 256) -> Column:
    return F.least(F.greatest(F.floor((fraction - F.floor(fraction)) * size), F.lit(0)), F.lit(size - 1)).cast("int")


def terrain_metres(r: Column, g: Column, b: Column) -> Column:
    return F.lit(-10000.0) + (r * 65536 + g * 256 + b) * F.lit(0.1)


def gradient_percent(rise: Column, run: Column) -> Column:
    """Null where an end has no elevation or the way is under 30 m."""
    return F.when(run >= 30, F.abs(rise) / run * 100)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def tile_box(row: Column, col: Column, size: float = 0.1) -> dict[str, Column]:
    """The box of a tile."""
    return {"south": row * F.lit(size), "west": col * F.lit(size), "north": (row + 1) * F.lit(size), "east": (col + 1) * F.lit(size)}


def padded_box(lat: Column, lng: Column, pad: float) -> list[Column]:
    """Aggregates: the box of points, wider by ``pad`` of its span on each side."""
    south, north, west, east = F.min(lat), F.max(lat), F.min(lng), F.max(lng)
    return [(south - (north - south) * pad).alias("south"), (north + (north - south) * pad).alias("north"), (west - (east - west) * pad).alias("west"), (east + (east - west) * pad).alias("east")]


def scannable(lat_span: float = 0.15, lng_span: float = 0.2) -> Column:
    """Whether a box (south, north, west, east) is small enough for one scan."""
    return (F.col("north") - F.col("south") <= lat_span) & (F.col("east") - F.col("west") <= lng_span)


def tileable(most: int = 30, size: float = 0.1) -> Column:
    """Whether a box touches at most ``most`` tiles."""
    many = lambda a, b: tile(F.col(b), size) - tile(F.col(a), size) + 1
    return many("south", "north") * many("west", "east") <= most
