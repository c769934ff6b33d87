"""Fewer vertices for a map's zoom."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETAIL_ZOOM = 16


def kept(points: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of many lines stay, by Douglas and Peucker: those further than ``tolerance`` from the line of their neighbours kept.

    Line i is ``points[ends[i]:ends[i + 1]]``. All lines are halved together, a level a step: of each stretch between two kept
    vertices the farthest one in between is found, the first of equally far ones, and where it stays two shorter
    stretches follow. So a step is a few numpy calls however many lines there are, and there are as many as the deepest needs.
    """
    keep = np.zeros(len(points), bool)
    some = np.diff(ends) > 0
    first, last = ends[:-1][some], ends[1:][some] - 1
    keep[first] = keep[last] = True
    while True:
        inner = last - first - 1
        first, last, inner = first[inner > 0], last[inner > 0], inner[inner > 0]
        if not len(first):
            return keep
        begins = np.concatenate([[0], np.cumsum(inner)])
        at = np.arange(begins[-1]) + np.repeat(first + 1 - begins[:-1], inner)
        line, rest = np.repeat(points[last] - points[first], inner, axis=0), points[at] - np.repeat(points[first], inner, axis=0)
        span = (line * line).sum(axis=1)
        along = np.clip(np.divide((rest * line).sum(axis=1), span, out=np.zeros(len(at)), where=span > 0), 0, 1)
        far = ((rest - along[:, None] * line) ** 2).sum(axis=1)
        worst = np.maximum.reduceat(far, begins[:-1])
        where = np.minimum.reduceat(np.where(far == np.repeat(worst, inner), at, len(points)), begins[:-1])
        stays = worst > tolerance * tolerance
        keep[where[stays]] = True
        first, last = np.concatenate([first[stays], where[stays]]), np.concatenate([where[stays], last[stays]])


def reduced(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The vertices of one line that stay."""
    return points[kept(points, np.array([0, len(points)]), tolerance)]


def simplified(ways: DataFrame, zoom: int, pixels: float = 1.5) -> DataFrame:
    """``ways(way_id, coords)`` with ``simple``: as they are from zoom 16 on and under three vertices, else reduced to what ``pixels`` show."""
    tolerance = 360 / (2**zoom * 256) * pixels

    @F.pandas_udf("array<struct<lat:double,lng:double>>")
    def simple(lats: pd.Series, lngs: pd.Series) -> pd.Series:
        ends = np.concatenate([[0], np.cumsum(lats.map(len).to_numpy())]).astype(np.int64)
        points = np.column_stack([np.concatenate(lats.to_list()), np.concatenate(lngs.to_list())])
        keep = kept(points, ends, tolerance)
        return pd.Series([[{"lat": a, "lng": b} for a, b in points[i:j][keep[i:j]].tolist()] for i, j in zip(ends, ends[1:], strict=False)])

    same = F.transform("coords", lambda c: F.struct(c["lat"].alias("lat"), c["lng"].alias("lng")))
    if zoom >= DETAIL_ZOOM:
        return ways.withColumn("simple", same)
    return ways.withColumn("simple", F.when(F.size("coords") < 3, same).otherwise(simple(F.col("coords.lat"), F.col("coords.lng"))))
