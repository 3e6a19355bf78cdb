"""Overlay of polygon layers: intersect, clip, erase, union and dissolve of WKB polygons with any rings and holes.

Pairs come from the blocked join of boxes; each pair's overlay is a kernel in an Arrow batch. The kernel cuts the plane at
the heights of all vertices and crossings. Between two heights no edges cross, so what is inside follows from their order
from west to east; the sides of what is kept and the parts of each height that lie at its border make up the rings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from ..functions.geometry import SIDES
from ..scratch import cut
from .polygons import area, clip_convex
from .spatial import pairs

#: Heights and places closer than this share of the extent are one.
SNAP = 1e-12
#: Edges of one overlay at most: their crossings are looked for pair by pair.
EDGES_MAX = 20_000
#: Edges of the polygons that one polygon is cut by at a time; polygons of a strip of a dissolve, and unions that are united at a time.
BATCH_EDGES, STRIP, FAN = 4_000, 64, 8


def rings_of(kind: str, coords) -> list[np.ndarray]:
    require(kind in ("Polygon", "MultiPolygon"), f"an overlay takes polygons, not a {kind}")
    return [np.asarray(r, float) for p in ([coords] if kind == "Polygon" else coords) for r in p]


def _edges(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(edges [n, 4] that rise from (x1, y1) to (x2, y2), the part of each)."""
    runs = [(np.concatenate((r[:-1], r[1:]), axis=1), i) for i, rings in enumerate(parts) for r in rings]
    e = np.concatenate([np.zeros((0, 4)), *(a for a, _ in runs)])
    owner = np.repeat([i for _, i in runs], [len(a) for a, _ in runs]).astype(int)
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
    rising = e[:, 1] < e[:, 3]
    return e[rising], owner[rising]


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    out = [np.zeros(0)]
    d = e[:, 2:] - e[:, :2]
    for i in range(len(e) - 1):
        o = e[i + 1 :]
        o_d, gap = d[i + 1 :], o[:, :2] - e[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            den = d[i, 0] * o_d[:, 1] - d[i, 1] * o_d[:, 0]
            t = (gap[:, 0] * o_d[:, 1] - gap[:, 1] * o_d[:, 0]) / den
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / den
        out.append(e[i, 1] + t[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)] * d[i, 1])
    return np.concatenate(out)


def _snapped(v: np.ndarray, gap: float) -> np.ndarray:
    """Distinct values, those within a gap of the one before left out."""
    v = np.unique(v)
    return v[np.concatenate(([True], np.diff(v) > gap))] if len(v) else v


def _at(e: np.ndarray, y: float) -> np.ndarray:
    x = e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
    return np.where(y <= e[:, 1], e[:, 0], np.where(y >= e[:, 3], e[:, 2], x))


def _loops(steps: dict[tuple, list[tuple]], place: Callable) -> Iterator[list[tuple]]:
    """Closed walks along the steps, turning left as sharply as they can, cut wherever one comes back to a node."""
    while steps:
        walk = [next(iter(steps))]
        seen = {walk[0]: 0}
        while True:
            here = walk[-1]
            ways = steps[here]
            if len(walk) > 1 and len(ways) > 1:
                (x, y), (px, py) = place(here), place(walk[-2])
                back = math.atan2(py - y, px - x)
                turn = lambda to: (back - math.atan2(place(to)[1] - y, place(to)[0] - x)) % (2 * math.pi)  # noqa: E731, B023
                ways.sort(key=turn, reverse=True)
            to = ways.pop()
            if not ways:
                del steps[here]
            if to in seen:
                start = seen[to]
                yield walk[start:]
                for node in walk[start + 1 :]:
                    del seen[node]
                walk = walk[: start + 1]
                if start == 0 and to not in steps:
                    break
            else:
                seen[to] = len(walk)
                walk.append(to)


def _straightened(ring: np.ndarray) -> np.ndarray:
    """A closed ring without the vertices that lie on a straight line between their neighbours."""
    p = ring[:-1]
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9 * np.hypot(*a.T) * np.hypot(*b.T)
    p = p[bend]
    return np.concatenate((p, p[:1])) if len(p) > 2 else np.zeros((0, 2))


def assembled(rings: list[np.ndarray]) -> tuple[str, list] | None:
    """Counter-clockwise rings with the clockwise ones inside them as holes; None for none."""
    outer = [r for r in rings if area(r) > 0]
    parts = [[r] for r in outer]
    for hole in (r for r in rings if area(r) < 0):
        x, y = (hole[0] + hole[1]) / 2
        around = [i for i, r in enumerate(outer) if _around(r, x, y)]
        if around:
            parts[min(around, key=lambda i: area(outer[i]))].append(hole)
    if not parts:
        return None
    return ("Polygon", parts[0]) if len(parts) == 1 else ("MultiPolygon", parts)


def _around(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return bool(((b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > x).sum() % 2)


def overlay(parts: list[list[np.ndarray]], keep: Callable[[np.ndarray], np.ndarray]) -> tuple[str, list] | None:
    """The places that keep picks, given [places, parts] of whether each is inside each part by the even-odd rule; a Polygon
    or MultiPolygon, or None where nothing is left. Slivers narrower than SNAP of the extent vanish."""
    e, owner = _edges(parts)
    if not len(e):
        return None
    require(len(e) <= EDGES_MAX, f"an overlay of {len(e)} edges; {EDGES_MAX} is the most, split or simplify the polygons")
    extent = max(np.ptp(e[:, [0, 2]]), np.ptp(e[:, [1, 3]]), np.abs(e).max() * 1e-3)
    gap = SNAP * extent
    levels = _snapped(np.concatenate((e[:, 1], e[:, 3], _crossings(e))), gap)
    slabs = []
    for lo, hi in zip(levels[:-1], levels[1:]):
        mid = (lo + hi) / 2
        on = np.flatnonzero((e[:, 1] <= mid) & (mid < e[:, 3]))
        on = on[np.argsort(_at(e[on], mid), kind="stable")]
        member = np.zeros((len(on), len(parts)), np.int64)
        member[np.arange(len(on)), owner[on]] = 1
        within = keep(np.cumsum(member, axis=0) % 2 == 1) if len(on) else np.zeros(0, bool)
        change = np.diff(within.astype(int), prepend=0)
        left, right = on[change > 0], on[change < 0]
        slabs.append((_at(e[left], lo), _at(e[left], hi), _at(e[right], lo), _at(e[right], hi)))
    none = (np.zeros(0),) * 4
    grid, nodes = [], []
    for i, _ in enumerate(levels):
        below, above = slabs[i - 1] if i else none, slabs[i] if i < len(slabs) else none
        grid.append(_snapped(np.concatenate((below[1], below[3], above[0], above[2])), gap))
        find = lambda x, g=grid[-1]: np.searchsorted(g, x + gap / 2, "right") - 1
        nodes.append((find(below[1]), find(below[3]), find(above[0]), find(above[2])))
    steps: dict[tuple, list[tuple]] = {}

    def step(a: tuple, b: tuple) -> None:
        if a != b:
            steps.setdefault(a, []).append(b)

    for i in range(len(levels)):
        cover = np.zeros((2, len(grid[i]) + 1), int)
        for row, (a, b) in enumerate((nodes[i][:2], nodes[i][2:])):
            np.add.at(cover[row], a, 1), np.add.at(cover[row], b, -1)
        below, above = np.cumsum(cover, axis=1) > 0
        for k in np.flatnonzero(below[:-1] != above[:-1]).tolist():
            step(*(((i, k), (i, k + 1)) if above[k] else ((i, k + 1), (i, k))))
        if i < len(slabs):
            same = nodes[i][2:] + nodes[i + 1][:2]
            for a, b, c, d in zip(*(x.tolist() for x in same)):
                if a == b and c == d:
                    continue
                step((i + 1, c), (i, a)), step((i, b), (i + 1, d))
    place = lambda n: (grid[n[0]][n[1]], levels[n[0]])
    rings = []
    for loop in _loops(steps, place):
        ring = _straightened(np.array([place(n) for n in [*loop, loop[0]]]))
        if len(ring) and abs(area(ring)) > gap * extent:
            rings.append(ring)
    return assembled(rings)


both = lambda m: m.all(axis=1)
first_only = lambda m: m[:, 0] & ~m[:, 1:].any(axis=1)
any_of = lambda m: m.any(axis=1)


inside_mask = lambda m: m[:, 0] & m[:, 1:].any(axis=1)


def _over(geometries: list, keep: Callable) -> bytes | None:
    made = overlay([rings_of(*wkb.decode(bytes(g))) for g in geometries], keep)
    return None if made is None else wkb.encode(*made)


def _convex(rings: list[np.ndarray]) -> np.ndarray | None:
    """The one ring of a convex polygon, counter-clockwise; None for other polygons."""
    if len(rings) != 1 or len(rings[0]) < 4:
        return None
    r = rings[0] if area(rings[0]) > 0 else rings[0][::-1]
    d = np.diff(r, axis=0)
    n = np.roll(d, -1, axis=0)
    turns = d[:, 0] * n[:, 1] - d[:, 1] * n[:, 0]
    # all turns to the left, and once around in all
    return r if (turns > 0).all() and abs(np.arctan2(turns, (d * n).sum(axis=1)).sum() - 2 * math.pi) < 1e-6 else None


def _common(a: bytes, b: bytes) -> bytes | None:
    """The common part of two polygons; convex ones are clipped edge by edge, others go through the kernel."""
    one, two = (rings_of(*wkb.decode(bytes(g))) for g in (a, b))
    p, q = _convex(one), _convex(two)
    if p is None or q is None:
        made = overlay([one, two], both)
        return None if made is None else wkb.encode(*made)
    extent = max(np.ptp(p), np.ptp(q), max(np.abs(p).max(), np.abs(q).max()) * 1e-3)
    part = clip_convex(p, q)
    part = part[np.concatenate(([True], np.hypot(*np.diff(part, axis=0).T) > SNAP * extent))] if len(part) else part
    part = np.concatenate((part, part[:1])) if len(part) and (part[0] != part[-1]).any() else part
    return wkb.encode("Polygon", [part]) if len(part) > 3 and area(part) > SNAP * extent * extent else None


def _against(first: bytes, others: list, keep: Callable) -> bytes | None:
    """keep over first and many others, a batch of BATCH_EDGES edges at a time: what is cut away by one is gone for the next, and
    what lies inside several batches is united."""
    rings = [rings_of(*wkb.decode(bytes(g))) for g in others]
    now, batch, size, found = rings_of(*wkb.decode(bytes(first))), [], 0, []

    def done() -> list:
        made = overlay([now, *batch], keep)
        return [] if made is None else rings_of(*made)

    for k, r in enumerate(rings):
        batch.append(r)
        size += sum(map(len, r))
        if size >= BATCH_EDGES or k + 1 == len(rings):
            if keep is first_only:
                now = done()
                if not now:
                    return None
            else:
                found.append(done())
            batch, size = [], 0
    if keep is first_only:
        return wkb.encode(*overlay([now], any_of))
    made = overlay([f for f in found if f], any_of) if any(found) else None
    return None if made is None else wkb.encode(*made)


def with_boxes(layer: DataFrame) -> DataFrame:
    """layer with the box of each geometry; null geometries go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xy = [np.concatenate(rings_of(*wkb.decode(bytes(g)))) for g in b["geometry"]]
            for i, (side, end) in enumerate(zip(SIDES, (np.min, np.min, np.max, np.max))):
                b[side] = np.array([end(p[:, i % 2]) for p in xy], float)
            yield b

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in layer.schema] + [f"{s} double" for s in SIDES])
    return layer.where("geometry IS NOT NULL").mapInPandas(run, schema)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    r = with_boxes(right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c != "geometry"}))
    return pairs(with_boxes(left).withColumnRenamed("geometry", "__lg"), r.withColumnRenamed("geometry", "__rg"))


def intersect_polygons(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each pair of polygons with a common area: left's columns, right's under right_, and the common part."""
    met = _met(left, right)
    names = [c for c in left.columns if c != "geometry"] + [f"right_{c}" for c in right.columns if c != "geometry"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["geometry"] = [_common(x, y) for x, y in zip(b["__lg"], b["__rg"])]
            yield b.drop(columns=["__lg", "__rg"])

    schema = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in names) + ", geometry binary"
    return met.select(*names, "__lg", "__rg").mapInPandas(run, schema).where("geometry IS NOT NULL")


def clip_polygons(layer: DataFrame, mask: bytes, invert: bool = False) -> DataFrame:
    """layer cut to a mask polygon (WKB), or with invert to what lies outside it; what vanishes goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["geometry"] = [_over([g, mask], first_only if invert else both) for g in b["geometry"]]
            yield b

    return layer.where("geometry IS NOT NULL").mapInPandas(run, layer.schema).where("geometry IS NOT NULL")


def _each_against(left: DataFrame, right: DataFrame, keep: Callable, alone: bool) -> DataFrame:
    """left, each row's polygon against all of right that its box meets, with a row number for the group, as left's own columns
    may repeat or be null; alone: whether rows that meet none stay."""
    rows = cut(left.where("geometry IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()))
    masks = right.where("geometry IS NOT NULL").select(F.col("geometry").alias("geometry"))
    met = _met(rows.select("__row", "geometry"), masks).select("__row", "__lg", "__rg")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"__row": pdf["__row"].iloc[:1], "__cut": [_against(pdf["__lg"].iloc[0], list(pdf["__rg"]), keep)]})

    done = met.groupBy("__row").applyInPandas(work, "__row bigint, __cut binary").withColumn("__met", F.lit(True))
    out = rows.join(done, "__row", "left" if alone else "inner").where("__cut IS NOT NULL OR __met IS NULL")
    return out.select(*[F.coalesce("__cut", "geometry").alias(c) if c == "geometry" else F.col(c) for c in left.columns])


def erase_polygons(left: DataFrame, right: DataFrame) -> DataFrame:
    """left without what any polygon of right covers; what vanishes goes, and so do rows without a geometry. Each row is cut by
    itself, whatever its columns hold."""
    return _each_against(left, right, first_only, True)


def clip_layer(left: DataFrame, right: DataFrame) -> DataFrame:
    """left cut to what the polygons of right cover together; what vanishes goes."""
    return _each_against(left, right, inside_mask, False)


def union_polygons(left: DataFrame, right: DataFrame) -> DataFrame:
    """The common parts of both layers with the columns of both (right's under right_), then what only one of them covers, with
    nulls for the other's columns."""
    named = right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c != "geometry"})
    out = intersect_polygons(left, right)
    return out.unionByName(erase_polygons(left, right), allowMissingColumns=True).unionByName(erase_polygons(named, left), allowMissingColumns=True)


def dissolve_polygons(layer: DataFrame, by: str) -> DataFrame:
    """(by, geometry): the union of the polygons of each value; null is a value.

    A value's extent is cut into strips from west to east, of STRIP polygons on average. Strips are united first, each in a task, then
    FAN neighbouring unions at a time, until one is left: a kernel sees just the outlines of what was united before."""
    kind = layer.schema[by].dataType.simpleString()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: pdf[by].iloc[:1], "__strip": pdf["__strip"].iloc[:1], "geometry": [_over(list(pdf["geometry"]), any_of)]})

    schema = f"`{by}` {kind}, __strip bigint, geometry binary"
    boxed = with_boxes(layer.select(by, "geometry"))
    span = boxed.groupBy(by).agg(F.min("xmin").alias("__lo"), F.max("xmin").alias("__hi"), F.count("*").alias("__n"))
    strip = F.floor((F.col("xmin") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * F.ceil(F.col("__n") / STRIP))
    span = span.withColumnRenamed(by, "__by")
    same = boxed[by].eqNullSafe(span["__by"])
    dealt = boxed.join(span, same).select(by, "geometry", strip.cast("bigint").alias("__strip"))
    strips = ((span.agg(F.max("__n")).first()[0] or 0) + STRIP - 1) // STRIP + 1
    now = dealt.groupBy(by, "__strip").applyInPandas(joined, schema)
    while strips > 1:
        strips = -(-strips // FAN)
        now = now.withColumn("__strip", F.floor(F.col("__strip") / FAN).cast("bigint")).where("geometry IS NOT NULL").groupBy(by, "__strip").applyInPandas(joined, schema)
    return now.select(by, "geometry").where("geometry IS NOT NULL")
