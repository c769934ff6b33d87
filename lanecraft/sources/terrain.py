"""Elevation tiles: PNG pictures whose pixels are heights, read as files or rows, and looked up for places.

A tile is a square of the Mercator grid at a zoom, 256 pixels wide; a pixel's red, green and blue tell its height. The
decoder takes pictures of 8 bits a channel (grey, colour, palette, with or without alpha), not interlaced. A tile that is
none of these, is cut off or has a wrong checksum has no heights, and neither have places on tiles that aren't there.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecraft.functions import geo

ZOOM, SIZE = 12, 256
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type. Fixed values.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(png: bytes) -> dict[bytes, bytes]:
    """The picture's chunks by type, those of one type joined."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG")
    out, at = {}, 8
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        out[kind] = out.get(kind, b"") + body
        at += size + 12
        if kind == b"IEND":
            return out
    raise ValueError("cut off")


def unfiltered(rows: np.ndarray, channels: int) -> np.ndarray:
    """Lines of bytes, the first of each its filter, as they were before filtering."""
    kinds, lines = rows[:, 0], rows[:, 1:].reshape(len(rows), -1, channels).astype(np.int64)
    above = np.zeros_like(lines[0])
    for line, kind in zip(lines, kinds, strict=True):
        if kind == 1:
            np.cumsum(line, axis=0, out=line)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            left = corner = np.zeros(channels, np.int64)
            for x in range(len(line)):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
                left = line[x] = (line[x] + guess) & 255
                corner = up
        elif kind:
            raise ValueError("unknown filter")
        line &= 255
        above = line
    return lines


def pixels(png: bytes) -> np.ndarray:
    """Red, green and blue of a picture, by row and column."""
    parts = chunks(png)
    width, height, depth, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or colour not in CHANNELS or compression or filtering or interlace:
        raise ValueError("not a picture of 8 bits a channel without interlacing")
    channels = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    values = unfiltered(raw.reshape(height, 1 + width * channels), channels)
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[values[:, :, 0]]
    return (values[:, :, :3] if channels > 2 else values[:, :, :1].repeat(3, axis=2)).astype(np.uint8)


def picture(rgb: np.ndarray) -> bytes:
    """A PNG of red, green and blue by row and column; each line is stored as its difference to the line above."""
    lines = rgb.astype(np.uint8).reshape(len(rgb), -1)
    below = np.diff(lines, axis=0, prepend=np.zeros_like(lines[:1]))
    body = zlib.compress(np.column_stack([np.full(len(lines), 2, np.uint8), below]).tobytes())
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    parts = [(b"IHDR", head), (b"IDAT", body), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """``z``, ``x``, ``y`` and ``png`` of the files ``z/x/y.png`` below ``path``."""
    at = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k).cast("int")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    return files.where(F.regexp_like("path", F.lit(r"/\d+/\d+/\d+\.png$"))).select(at(1).alias("z"), at(2).alias("x"), at(3).alias("y"), F.col("content").alias("png"))


def on_tile(lat: Column, lng: Column, zoom: int = ZOOM) -> dict[str, Column]:
    """The tile and the pixel of a place; ``pixel`` counts along the lines. Beyond the poles, where the grid ends, ``y`` is null."""
    x, y = geo.mercator_tile(lat, lng, zoom)
    return {"x": F.floor(x).cast("int"), "y": F.floor(y).cast("int"), "pixel": geo.pixel(y) * SIZE + geo.pixel(x)}


def tiles_of(places: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """x and y of the tiles that ``places(lat, lng)`` lie on; none for a place without a tile."""
    at = on_tile(F.col("lat"), F.col("lng"), zoom)
    return places.select(at["x"].alias("x"), at["y"].alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()


def heights(places: DataFrame, tiles: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """``lat``, ``lng`` and ``metres`` of all different ``places(lat, lng)``; null without tile (beyond the poles, too), or where it can't be decoded.

    ``tiles(z, x, y, png)``. A task decodes a tile for the pixels that are asked for, which are no more than it has however
    many places lie on it; of several rows of one tile any one that can be decoded counts.
    """
    asked = places.select("lat", "lng").distinct().withColumns(on_tile(F.col("lat"), F.col("lng"), zoom))
    wanted = asked.select("x", "y", "pixel").where("x IS NOT NULL AND y IS NOT NULL").distinct()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = np.array([p for p in table.column("pixel").to_pylist() if p is not None], np.int64)
        metres: list = [None] * len(at)
        for png in table.column("png").to_pylist():
            if png is not None and len(at):
                try:
                    rgb = pixels(png).reshape(-1, 3).astype(np.int64)
                    metres = (-10000.0 + (rgb[at] @ np.array([65536, 256, 1])) * 0.1).tolist()
                    break
                except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                    continue
        x, y = (k.as_py() for k in key)
        return pa.table({"x": pa.array([x] * len(at), pa.int32()), "y": pa.array([y] * len(at), pa.int32()), "pixel": pa.array(at, pa.int32()), "metres": pa.array(metres, pa.float64())})

    own = tiles.where(F.col("z") == zoom).select("x", "y", "png").join(wanted.select("x", "y").distinct(), ["x", "y"], "left_semi")
    found = own.unionByName(wanted, allowMissingColumns=True).groupBy("x", "y").applyInArrow(run, "x int, y int, pixel int, metres double")
    return asked.join(found, ["x", "y", "pixel"], "left").select("lat", "lng", "metres")


def with_ends(ways: DataFrame, tiles: DataFrame) -> DataFrame:
    """``ways`` with ``metres1`` and ``metres2``, the heights of their first and last vertex, for ``graph.edges``' elevation."""
    ends = ways.where(F.size("coords") > 0).select("way_id", F.element_at("coords", 1).alias("a"), F.element_at("coords", -1).alias("b"))
    known = heights(ends.select("a.lat", "a.lng").unionByName(ends.select("b.lat", "b.lng")), tiles).checkpoint()
    for k, end in enumerate("ab", 1):
        own = known.select(F.col("lat").alias(f"_lat{k}"), F.col("lng").alias(f"_lng{k}"), F.col("metres").alias(f"metres{k}"))
        ends = ends.join(own, (F.col(f"{end}.lat") == F.col(f"_lat{k}")) & (F.col(f"{end}.lng") == F.col(f"_lng{k}")), "left")
    return ways.join(ends.select("way_id", "metres1", "metres2"), "way_id", "left")
