"""Regions of the sky as ranges of HEALPix pixels, tables sorted by pixel, and scans that read only what a region needs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import Region, healpix_nested, healpix_ring, in_cones, nested_pixel, nested_place, sphere, valid_position

#: Order of the pixels by which tables are sorted: 12 * 4**12 pixels, about 0.9 arc minutes wide.
ORDER = 12
PIXEL = "healpix_12"


def _squeeze(v: np.ndarray) -> np.ndarray:
    """Every other bit of a number, the lowest one first."""
    out = np.zeros_like(v)
    for i in range(30):
        out |= (v >> np.int64(2 * i) & 1) << np.int64(i)
    return out


def centres(order: int, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, b) in degrees of the centres of nested pixels.

    A pixel is a place (x, y) on one of twelve faces; how far its centre stands from the north pole, in rings, gives the
    latitude, its place along the ring the longitude.
    """
    n = 1 << order
    pixels = np.asarray(pixels, np.int64)
    face, inside = pixels // (n * n), pixels % (n * n)
    x, y = _squeeze(inside), _squeeze(inside >> 1)
    row, column = face // 4, face % 4
    ring = (row + 2) * n - x - y - 1
    turn = 2 * column + (row == 0) + (row == 2) + 0.0 * ring
    north, south = ring < n, ring > 3 * n
    size = np.where(north, ring, np.where(south, 4 * n - ring, n)).astype(float)
    z = np.where(north, 1 - size**2 / (3 * n * n), np.where(south, size**2 / (3 * n * n) - 1, (2 * n - ring) * 2 / (3 * n)))
    longitude = (turn + (x - y) / size) * 45.0
    return longitude % 360.0, np.degrees(np.arcsin(np.clip(z, -1, 1)))


def radius(order: int) -> float:
    """Degrees from the centre of any pixel to its farthest corner, at most.

    The farthest corners are those of the pixels that touch the rings at sin b = 2/3.
    """
    n = 1 << order
    z = 1 - (1 - 1 / n) ** 2 / 3
    a, b = math.asin(2 / 3), math.asin(z)
    turn = math.pi / (4 * n)
    chord = math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(turn)
    return math.degrees(math.acos(min(1.0, chord))) * (1 + 1e-9) + 1e-9


def _longitude(l: np.ndarray, centre: float) -> np.ndarray:
    return np.abs((l - centre + 180.0) % 360.0 - 180.0)


@dataclass(frozen=True)
class Cone:
    l: float
    b: float
    radius: float

    def inside(self, l: Column, b: Column) -> Column:
        return in_cones(l, b, [(self.l, self.b, self.radius)])

    def sides(self, l: np.ndarray, b: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """For discs of a radius around positions: which lie inside as a whole, which may hold points inside."""
        lat, lat0 = np.radians(b), math.radians(self.b)
        half = np.sin((lat - lat0) / 2) ** 2 + np.cos(lat) * math.cos(lat0) * np.sin(np.radians(l - self.l) / 2) ** 2
        far = np.degrees(2 * np.arcsin(np.sqrt(np.clip(half, 0, 1))))
        return far + margin < self.radius - 1e-9, far - margin <= self.radius + 1e-9


@dataclass(frozen=True)
class Box:
    """A region between two latitudes and two longitudes."""

    region: Region

    def inside(self, l: Column, b: Column) -> Column:
        return F.coalesce(self.region.inside(l, b), F.lit(False))

    def sides(self, l: np.ndarray, b: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        r, slack = self.region, 1e-9
        near_pole = np.abs(b) + margin >= 90.0
        share = np.sin(math.radians(min(margin, 90.0))) / np.maximum(np.cos(np.radians(b)), 1e-300)
        reach = np.where(near_pole | (share >= 1), 180.0, np.degrees(np.arcsin(np.minimum(share, 1.0))))
        off = _longitude(l, r.l_centre)
        low, high = b - margin, b + margin
        whole = (low >= r.b_low + slack) & (high <= r.b_high - slack) & ((off + reach <= r.width / 2 - slack) | (r.width >= 360))
        some = (high >= r.b_low - slack) & (low <= r.b_high + slack) & (off - reach <= r.width / 2 + slack)
        return whole, some


Shape = Cone | Box


def cover(shapes: Sequence[Shape], order: int = ORDER, most: int = 64) -> list[tuple[int, int]]:
    """At most about `most` ranges [first, last] of nested pixels of an order that hold every point of the shapes.

    The twelve faces are split into quarters, level by level: what lies outside all shapes goes, what lies inside one is
    kept as a whole, the rest is split further, until the ranges are as many as wanted. Ranges that touch are joined.
    """
    whole: list[tuple[int, int]] = []
    open_, level = np.arange(12, dtype=np.int64), 0
    ranges: list[tuple[int, int]] = [(0, 12 * 4**order - 1)]
    while True:
        l, b = centres(level, open_)
        kept, some = np.zeros(len(open_), bool), np.zeros(len(open_), bool)
        for s in shapes:
            k, t = s.sides(l, b, radius(level))
            kept, some = kept | k, some | t
        scale = 4 ** (order - level)
        whole = whole + [(p * scale, (p + 1) * scale - 1) for p in open_[kept].tolist()]
        open_ = open_[some & ~kept]
        now = _joined(whole + [(p * scale, (p + 1) * scale - 1) for p in open_.tolist()])
        if len(now) > most and level > 0:
            return ranges
        ranges = now
        if level == order or not len(open_):
            return ranges
        open_, level = (open_[:, None] * 4 + np.arange(4)).ravel(), level + 1


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def within(pixel: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a pixel is in one of the ranges: plain comparisons, as a tree of few levels, that reach the scan."""
    tests = [(pixel >= low) & (pixel <= high) if low != high else pixel == low for low, high in ranges]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def with_pixel(rows: DataFrame, l: str = "l", b: str = "b", order: int = ORDER, name: str = PIXEL) -> DataFrame:
    """`rows` with the nested pixel of their position; null without a valid one.

    Sines and places are columns of their own: inside a condition, Spark would compute them for each mention.
    """
    n, (t, z) = 1 << order, sphere(F.col(l), F.col(b))
    placed = rows.withColumns({"__valid": valid_position(F.col(l), F.col(b)), "__t": t, "__z": z})
    face, x, y = nested_place(n, F.when(F.col("__valid"), F.col("__t")), F.when(F.col("__valid"), F.col("__z")))
    placed = placed.withColumns({"__face": face, "__x": x, "__y": y})
    pixel = F.when(F.col("__valid"), nested_pixel(n, F.col("__face"), F.col("__x"), F.col("__y")))
    return placed.withColumn(name, pixel).select(*(c for c in rows.columns if c != name), name)


def save_sorted(rows: DataFrame, path: str, l: str = "l", b: str = "b", order: int = ORDER, name: str = PIXEL, files: int | None = None, group_bytes: int = 128 << 20) -> None:
    """Writes `rows` as Parquet, sorted by pixel over all files: each file and row group holds one stretch of the sky,
    which its statistics tell. Crowded pixels are split by source_id where the rows have one.
    """
    n = files or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [name] + (["source_id"] if "source_id" in rows.columns else [])
    placed = with_pixel(rows, l, b, order, name).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed.write.option("parquet.block.size", group_bytes).parquet(path)


def read_inside(spark: SparkSession, path: str, shapes: Sequence[Shape], l: str = "l", b: str = "b", order: int = ORDER, name: str = PIXEL, most: int = 64) -> DataFrame:
    """The rows of a table of save_sorted inside any of the shapes.

    The cover's ranges skip files' row groups and pages by their statistics; the exact test runs on what is left. Rows
    without a valid position have no pixel and are in no shape.
    """
    exact = F.lit(False)
    for s in shapes:
        exact = exact | s.inside(F.col(l), F.col(b))
    return spark.read.parquet(path).filter(within(F.col(name), cover(shapes, order, most))).filter(exact)


def lookup(points: DataFrame, values: DataFrame, nside: int, l: str = "l", b: str = "b", nested: bool = False) -> DataFrame:
    """`points` with pix and the columns of a HEALPix table (pix, ...): nulls where it has no such pixel.

    The pixels of a table are distinct, and those that many points share are read once from its side of the join.
    """
    pixel = healpix_nested if nested else healpix_ring
    return points.withColumn("pix", pixel(nside, F.col(l), F.col(b))).join(values, "pix", "left")


def points_inside(values: DataFrame, shapes: Sequence[Shape], order: int, pix: str = "pix", most: int = 64) -> DataFrame:
    """The rows of a nested HEALPix table of an order whose pixels may meet the shapes: only their ranges are read."""
    return values.filter(within(F.col(pix), cover(shapes, order, most)))
