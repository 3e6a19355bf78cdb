"""Contours of tall surfaces (row, col, x, y, value): levels, isolines, bands, gaps for labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from . import tracing
from .grids import NICE
from .polygons import area, chaikin

#: Lines from one index line to the next, levels of a default set, and the most that corners may be cut.
INDEX_EVERY, LEVELS, SMOOTHING_MAX = 5, 12, 0.5


def auto_levels(lo: float, hi: float, target: int = LEVELS) -> list[float]:
    """Multiples, strictly inside the range, of the round interval nearest to range / target on a log scale."""
    require(hi > lo, f"the surface is flat at {lo}; it has no contours")
    want = (hi - lo) / target
    e = math.floor(math.log10(want))
    step = min((m * 10.0**k for k in (e - 1, e, e + 1) for m in NICE), key=lambda s: abs(math.log(s / want)))
    return [k * step for k in range(math.floor(lo / step) + 1, math.ceil(hi / step)) if lo < k * step < hi]


def interval_of(levels: list[float]) -> float:
    return float(np.median(np.diff(sorted(levels)))) if len(levels) > 1 else 0.0


def lines(surface: DataFrame, levels: list[float], *, smoothing: float = 0.0, min_length: float = 0.0, index_every: int = INDEX_EVERY, **tiles: int) -> DataFrame:
    """(value, is_index, length, geometry): marching squares, saddles parted by the mean of their corners, traced by tiles; every
    fifth level by position is an index. Lines of no length, where the surface just touches a level, are left out."""
    ordered = sorted(float(v) for v in levels)

    def run(batches):
        for b in batches:
            out = []
            for g, closed, xs, ys in b[["g", "closed", "xs", "ys"]].itertuples(index=False):
                line = chaikin(_distinct(xs, ys), smoothing, closed)
                n = float(np.hypot(*np.diff(line, axis=0).T).sum())
                if n > 0 and n >= min_length:
                    out.append((ordered[g], g % index_every == 0, n, wkb.encode("LineString", line)))
            yield pd.DataFrame(out, columns=["value", "is_index", "length", "geometry"])

    return tracing.level_lines(surface, ordered, **tiles).mapInPandas(run, "value double, is_index boolean, length double, geometry binary")


def _distinct(xs, ys) -> np.ndarray:
    """The points of a line without those that repeat the one before."""
    p = np.column_stack((xs, ys))
    return p[np.concatenate(([True], (np.diff(p, axis=0) != 0).any(axis=1)))]


def index_levels(contours: DataFrame) -> DataFrame:
    return contours.where("is_index").select("value").distinct().orderBy("value")


def bands(surface: DataFrame, levels: list[float], *, smoothing: float = 0.0, min_area: float | None = None, **tiles: int) -> DataFrame:
    """(band, lower, upper, is_open_ended, part, area, geometry): the polygons between neighbouring levels, one row for each
    connected part, holes with it.

    The first and last band run to the surface's own extremes and are open ended; levels outside the surface give no band. The
    edges are those that lines() draws. Cells without a value are outside. Parts and holes smaller than min_area, by default one cell,
    are left out and filled."""
    require(0 <= smoothing <= SMOOTHING_MAX, f"smoothing {smoothing} is not between 0 and {SMOOTHING_MAX}; beyond that an edge leaves its level")
    seen = surface.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    r = seen.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("value", "x", "y", "row", "col")]).first()
    require(r["min_value"] is not None, "the surface has no value in any cell, so there is nothing to fill")
    cell = (r["max_x"] - r["min_x"]) / max(1, r["max_col"] - r["min_col"]) * (r["max_y"] - r["min_y"]) / max(1, r["max_row"] - r["min_row"])
    tiny = 1e-9 * cell
    least = max(tiny, cell if min_area is None else min_area)
    inner = [float(v) for v in sorted(levels) if r["min_value"] < v < r["max_value"]]
    ends = [r["min_value"], *inner, r["max_value"]]

    def run(batches):
        for b in batches:
            out = []
            for g, part, rings in b[["g", "outer", "rings"]].itertuples(index=False):
                shell, *holes = (chaikin(_distinct(x["xs"], x["ys"]), smoothing, True) for x in sorted(rings, key=lambda x: not x["is_outer"]))
                if len(shell) > 3 and abs(area(shell)) >= least:
                    kept = [shell, *(h for h in holes if len(h) > 3 and abs(area(h)) >= least)]
                    size = abs(area(shell)) - sum(abs(area(h)) for h in kept[1:])
                    out.append((g, ends[g], ends[g + 1], g in (0, len(inner)), part, size, wkb.encode("Polygon", kept)))
            yield pd.DataFrame(out, columns=["band", "lower", "upper", "is_open_ended", "part", "area", "geometry"])

    rings = tracing.band_rings(surface, [-math.inf, *inner, math.inf], tiny, **tiles)
    held = rings.groupBy("g", "outer").agg(F.collect_list(F.struct((F.col("ring") == F.col("outer")).alias("is_outer"), "xs", "ys")).alias("rings"))
    return held.mapInPandas(run, "band int, lower double, upper double, is_open_ended boolean, part bigint, area double, geometry binary")


def anchor_distances(length: Column, gap: float, spacing: float) -> Column:
    """Places of labels along a line, evenly from its middle; none where the gap doesn't fit."""
    n = F.greatest(F.lit(1), F.floor(length / spacing)).cast("int")
    return F.when(length < 2 * gap, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) * length / n))


def gap_length(text: Column, metres_per_pixel: float, size_px: float) -> Column:
    return (F.char_length(text) + 2) * size_px * 0.58 * metres_per_pixel


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees of text along a direction, turned to be read upright: from -90 to below 90."""
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 90, F.lit(180.0)) - 90


def cut_gaps(line: np.ndarray, anchors: list[float], gap: float) -> list[np.ndarray]:
    """The parts of a line without the gap around each anchor."""
    s = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
    at = lambda v: np.array([np.interp(v, s, line[:, 0]), np.interp(v, s, line[:, 1])])
    out, start = [], 0.0
    for a in [*sorted(anchors), None]:
        stop = s[-1] if a is None else max(start, a - gap / 2)
        if stop > start:
            inner = line[(s > start) & (s < stop)]
            out.append(np.concatenate(([at(start)], inner, [at(stop)])))
        start = s[-1] if a is None else min(s[-1], a + gap / 2)
    return out


def label(contours: DataFrame, gap: float, spacing: float) -> DataFrame:
    """(value, kind, x, y, bearing, geometry): pieces of lines with gaps, and label points."""

    def run(batches):
        for b in batches:
            out = []
            for v, g in zip(b["value"], b["geometry"]):
                line = np.asarray(wkb.decode(g)[1])
                s = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
                n = max(1, int(s[-1] // spacing))
                anchors = [] if s[-1] < 2 * gap else [(i + 0.5) * s[-1] / n for i in range(n)]
                out += [(v, "line", None, None, None, wkb.encode("LineString", p)) for p in cut_gaps(line, anchors, gap)]
                for a in anchors:
                    p, q = ([np.interp(t, s, line[:, k]) for k in (0, 1)] for t in (max(0, a - gap / 2), min(s[-1], a + gap / 2)))
                    turn = (math.degrees(math.atan2(q[1] - p[1], q[0] - p[0])) + 90) % 180 - 90
                    out.append((v, "label", float(np.interp(a, s, line[:, 0])), float(np.interp(a, s, line[:, 1])), turn, None))
            yield pd.DataFrame(out, columns=["value", "kind", "x", "y", "bearing", "geometry"])

    return contours.select("value", "geometry").mapInPandas(run, "value double, kind string, x double, y double, bearing double, geometry binary")


def levels_of(surface: DataFrame, target: int = LEVELS) -> list[float]:
    r = surface.where("value IS NOT NULL AND NOT isnan(value)").agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    return auto_levels(r["a"], r["b"], target)


def interval_column(levels: DataFrame) -> DataFrame:
    """One row: the median spacing of a table of levels."""
    return levels.select((F.lead("level").over(W.orderBy("level")) - F.col("level")).alias("d")).agg(F.percentile("d", F.lit(0.5)).alias("interval"))
