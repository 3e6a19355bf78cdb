"""Planar algebra as Column expressions: boxes, segments, Hilbert keys, tiles, projections between 4326 and 3857."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the side of the Web-Mercator square, and the radius of its sphere, in metres.
MERCATOR_HALF, MERCATOR_RADIUS = 20037508.342789244, 6378137.0
SIDES = ("xmin", "ymin", "xmax", "ymax")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)


def box_relation(kind: str, a: tuple, b: tuple) -> Column:
    """Predicates of closed axis-aligned boxes, or points as boxes without extent, read from left to right.

    touches: they meet, their interiors don't. overlaps: interiors meet, neither holds the other. crosses: never, for two
    boxes of area. contains: the right lies in the left and their interiors meet; within: the other way round."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a, b
    meet = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    inner = (ax0 < bx1) & (ax1 > bx0) & (ay0 < by1) & (ay1 > by0)
    holds = (ax0 <= bx0) & (ax1 >= bx1) & (ay0 <= by0) & (ay1 >= by1)
    held = (bx0 <= ax0) & (bx1 >= ax1) & (by0 <= ay0) & (by1 >= ay1)
    if kind == "intersects":
        return meet
    if kind == "contains":
        return holds & inner
    if kind == "within":
        return held & inner
    if kind == "touches":
        return meet & ~inner
    if kind == "overlaps":
        return inner & ~holds & ~held
    if kind == "crosses":
        return meet & F.lit(False)
    raise ValueError(f"predicate {kind!r} is not one of intersects, contains, within, touches, crosses, overlaps")


def hilbert_index(x: Column, y: Column, bbox: tuple, order: int = 16) -> Column:
    """Distance along the Hilbert curve of 2^order cells a side over bbox (xmin, ymin, xmax, ymax); points outside are held
    to its edge, and an extent of zero is cell 0. An unrolled loop over bits, all in integer Column arithmetic."""
    if not 1 <= order <= 31:
        raise ValueError(f"order must be 1 to 31, not {order}")
    x0, y0, x1, y1 = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in bbox)
    side = (1 << order) - 1

    def cell(v: Column, lo: Column, hi: Column) -> Column:
        at = F.floor(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * side)
        return F.when(hi <= lo, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(side), at))).cast("long")

    # a fold over the bits keeps the expression small whatever the order
    start = F.struct(cell(x, x0, x1).alias("x"), cell(y, y0, y1).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, level: Column) -> Column:
        s = F.expr("1L") * F.pow(F.lit(2.0), level).cast("long")
        rx = F.when(acc["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - acc["x"]).otherwise(acc["x"]), F.when(flip, side - acc["y"]).otherwise(acc["y"])
        swap = ry == 0
        return F.struct(
            F.when(swap, fy).otherwise(fx).alias("x"), F.when(swap, fx).otherwise(fy).alias("y"),
            (acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"),
        )

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"])


def tile_bounds_3857(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    size = 2 * MERCATOR_HALF / F.pow(F.lit(2.0), z)
    return -MERCATOR_HALF + x * size, MERCATOR_HALF - (y + 1) * size, -MERCATOR_HALF + (x + 1) * size, MERCATOR_HALF - y * size


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """The same for one tile; z is 0 to 24 and x, y lie in its square."""
    if not (0 <= z <= 24 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"tile {z}/{x}/{y} is not one of zoom levels 0 to 24")
    size = 2 * MERCATOR_HALF / (1 << z)
    return -MERCATOR_HALF + x * size, MERCATOR_HALF - (y + 1) * size, -MERCATOR_HALF + (x + 1) * size, MERCATOR_HALF - y * size


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def tile_of(x: Column, y: Column, z: int) -> tuple[Column, Column]:
    """Tile column and row of Web-Mercator coordinates, held to the square."""
    n = 1 << z
    size = 2 * MERCATOR_HALF / n
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c))).cast("int")
    return hold((x + MERCATOR_HALF) / size), hold((MERCATOR_HALF - y) / size)


def segment_intersection(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Struct (x, y) where two segments cross or meet, null for parallel or apart."""
    d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    t = F.try_divide((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3), F.nullif(d, F.lit(0.0)))
    u = F.try_divide((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1), F.nullif(d, F.lit(0.0)))
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y")))


def perpendicular_foot(px, py, ax, ay, bx, by) -> Column:
    """Struct (x, y) of the point of the segment nearest to p."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), F.nullif(length, F.lit(0.0))), F.lit(0.0))))
    return F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y"))


def shoelace_centroid(xs: Column, ys: Column) -> Column:
    """Struct (x, y, area) of a closed ring's coordinate arrays."""
    i = F.sequence(F.lit(1), F.size(xs) - 1)
    cross = lambda k: F.element_at(xs, k) * F.element_at(ys, k + 1) - F.element_at(xs, k + 1) * F.element_at(ys, k)
    fold = lambda f: F.aggregate(i, F.lit(0.0), lambda a, k: a + f(k))
    twice = fold(cross)
    cx = fold(lambda k: (F.element_at(xs, k) + F.element_at(xs, k + 1)) * cross(k))
    cy = fold(lambda k: (F.element_at(ys, k) + F.element_at(ys, k + 1)) * cross(k))
    return F.struct(F.try_divide(cx, 3 * twice).alias("x"), F.try_divide(cy, 3 * twice).alias("y"), (F.abs(twice) / 2).alias("area"))


def meters_per_pixel(latitude: Column, zoom: Column, tile_px: int = 512) -> Column:
    lat = F.greatest(F.lit(-85.051129), F.least(F.lit(85.051129), latitude))
    return 2 * math.pi * MERCATOR_RADIUS * F.cos(F.radians(lat)) / (tile_px * F.pow(F.lit(2.0), zoom))


#: Mantissas of round numbers.
NICE = (1.0, 2.0, 2.5, 5.0, 10.0)


def nice_at_least(v: Column) -> Column:
    """The smallest of NICE x 10^n that is v or more."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = F.round(v / p, 12)
    out = F.lit(10.0)
    for nice in reversed(NICE[:-1]):
        out = F.when(m <= nice, F.lit(nice)).otherwise(out)
    return out * p


def scale_bar(latitude: Column, zoom: Column, max_width_px: float) -> Column:
    """Struct (distance, width_px): the largest 1, 2 or 5 x 10^n metres that max_width_px can show."""
    per = meters_per_pixel(latitude, zoom)
    most = per * max_width_px
    p = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    m = most / p
    d = p * F.when(m >= 5, 5.0).when(m >= 2, 2.0).otherwise(1.0)
    return F.struct(d.alias("distance"), (d / per).alias("width_px"))
