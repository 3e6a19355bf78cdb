"""Joins of points and polygons by what their shapes share, not their boxes.

A polygon is dealt to grid cells. A cell that no edge touches is wholly inside or of no interest; one with edges holds those edges and
whether its lower left corner is inside. A point is then judged by its own cell alone: from the corner up and across to the point,
inside changes at each edge that the way crosses. So no polygon goes anywhere whole, however many points it holds. Two polygons that
share a cell are a pair; the kernel decides what their whole outlines have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from ..functions.geometry import SIDES
from ..layers import same_frame
from ..scratch import cut
from .aggregate import Stat
from .overlay import rings_of, with_boxes
from .polygons import area
from .spatial import block_size

PREDICATES = ("intersects", "contains", "within", "touches", "crosses", "overlaps")
#: Edges of two polygons that are compared at once.
BLOCK = 1_000_000


def outline(geometry: bytes) -> np.ndarray:
    """The edges [n, 4] of a polygon with its inside on their left: outer rings turn left, holes right."""
    kind, coords = wkb.decode(bytes(geometry))
    rings_of(kind, coords)
    out = [np.zeros((0, 4))]
    for rings in [coords] if kind == "Polygon" else coords:
        for k, r in enumerate(np.asarray(r, float) for r in rings):
            r = r if (area(r) > 0) == (k == 0) else r[::-1]
            e = np.concatenate((r[:-1], r[1:]), axis=1)
            out.append(e[(e[:, :2] != e[:, 2:]).any(axis=1)])
    return np.concatenate(out)


def _side(e: np.ndarray, x, y) -> np.ndarray:
    """Above 0 where (x, y) is left of an edge, 0 on its line."""
    return (e[..., 2] - e[..., 0]) * (y - e[..., 1]) - (x - e[..., 0]) * (e[..., 3] - e[..., 1])


def where_is(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for places inside an outline, 0 on it, -1 outside."""
    out = np.empty(len(x), int)
    for a in range(0, len(x), max(1, BLOCK // max(1, len(e)))):
        px, py = x[a : a + max(1, BLOCK // max(1, len(e))), None], y[a : a + max(1, BLOCK // max(1, len(e))), None]
        s = _side(e[None], px, py)
        low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        on = (s == 0) & (px >= low[:, 0]) & (px <= high[:, 0]) & (py >= low[:, 1]) & (py <= high[:, 1])
        up, down = (e[:, 1] <= py) & (e[:, 3] > py) & (s > 0), (e[:, 1] > py) & (e[:, 3] <= py) & (s < 0)
        wound = (up.sum(axis=1) - down.sum(axis=1)) != 0
        out[a : a + len(px)] = np.where(on.any(axis=1), 0, np.where(wound, 1, -1))
    return out


def cells_of(e: np.ndarray, size: float) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """(cell x, cell y, whether its lower left corner is inside, its edges) of an outline; cells without edges are inside."""
    if not len(e):
        return
    at: dict[tuple[int, int], list[int]] = {}
    for i, (x1, y1, x2, y2) in enumerate(e.tolist()):
        (xa, ya), (xb, yb) = ((x1, y1), (x2, y2)) if x1 <= x2 else ((x2, y2), (x1, y1))
        for cx in range(int(np.floor(xa / size)), int(np.floor(xb / size)) + 1):
            # the part of the edge over this column of cells, and a little more, so that rounding leaves no cell out
            u, v = max(xa, cx * size), min(xb, (cx + 1) * size)
            yu, yv = (ya, yb) if xa == xb else (ya + (u - xa) / (xb - xa) * (yb - ya), ya + (v - xa) / (xb - xa) * (yb - ya))
            slack = 1e-9 * size
            for cy in range(int(np.floor((min(yu, yv) - slack) / size)), int(np.floor((max(yu, yv) + slack) / size)) + 1):
                at.setdefault((cx, cy), []).append(i)
    xs = [k[0] for k in at]
    by_row: dict[int, None] = dict.fromkeys(k[1] for k in at)
    for cy in sorted(by_row):
        y = cy * size
        cross = e[(e[:, 1] <= y) != (e[:, 3] <= y)]
        columns = np.arange(min(xs), max(xs) + 1)
        right = _side(cross[None], columns[:, None] * size, y) * np.sign(cross[:, 3] - cross[:, 1])[None] > 0
        inside = right.sum(axis=1) % 2 == 1
        for cx, corner in zip(columns.tolist(), inside.tolist()):
            own = at.get((cx, cy))
            if own is not None or corner:
                yield cx, cy, corner, e[own] if own is not None else e[:0]


def _cut_at(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """(a's edges cut where b's touch or cross them, whether any do)."""
    parts, met = [], False
    step = max(1, BLOCK // max(1, len(b)))
    for k in range(0, len(a), step):
        e = a[k : k + step]
        s1, s2 = _side(b[None], e[:, None, 0], e[:, None, 1]), _side(b[None], e[:, None, 2], e[:, None, 3])
        t1, t2 = _side(e[:, None], b[None, :, 0], b[None, :, 1]), _side(e[:, None], b[None, :, 2], b[None, :, 3])
        cross = (np.sign(s1) * np.sign(s2) <= 0) & (np.sign(t1) * np.sign(t2) <= 0) & ~((s1 == 0) & (s2 == 0))
        d = e[:, 2:] - e[:, :2]
        long = (d * d).sum(axis=1)
        flat = (s1 == 0) & (s2 == 0)
        ends = [(((b[None, :, c] - e[:, None, 0]) * d[:, None, 0] + (b[None, :, c + 1] - e[:, None, 1]) * d[:, None, 1]) / long[:, None]) for c in (0, 2)]
        along = flat & (np.minimum(*ends) <= 1) & (np.maximum(*ends) >= 0)
        met = met or bool(cross.any() or along.any())
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(cross, s1 / (s1 - s2), np.nan)
        for i in range(len(e)):
            at = np.concatenate((f[i][cross[i]], *(x[i][along[i]] for x in ends), [0.0, 1.0]))
            at = np.unique(np.clip(at, 0, 1))
            p = e[i, :2] + at[:, None] * d[i]
            parts.append(np.concatenate((p[:-1], p[1:]), axis=1))
    return np.concatenate([np.zeros((0, 4)), *parts]), met


def relation(a: np.ndarray, b: np.ndarray) -> dict[str, bool]:
    """What two outlines are to each other, by the places of their cut edges' middles."""
    pieces_a, met = _cut_at(a, b)
    pieces_b, _ = _cut_at(b, a)
    mid = lambda p: ((p[:, 0] + p[:, 2]) / 2, (p[:, 1] + p[:, 3]) / 2)
    scale = max(np.ptp(np.concatenate((a, b))[:, [0, 2]]), np.ptp(np.concatenate((a, b))[:, [1, 3]]), 1e-300)
    in_b, in_a = _where_near(b, *mid(pieces_a), scale), _where_near(a, *mid(pieces_b), scale)
    shared = pieces_a[in_b == 0]
    along = _same_way(shared, b, scale)
    inner = bool((in_b > 0).any() or (in_a > 0).any() or (along > 0).any())
    a_out = bool((in_b < 0).any() or (in_a > 0).any() or (along < 0).any())
    b_out = bool((in_a < 0).any() or (in_b > 0).any() or (along < 0).any())
    return {"intersects": inner or met, "touches": met and not inner, "overlaps": inner and a_out and b_out, "contains": inner and not b_out, "within": inner and not a_out, "crosses": False}


def _where_near(e: np.ndarray, x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """where_is(), with places at rounding distance of the outline on it: a middle of two rounded places is seldom exact."""
    out = where_is(e, x, y)
    length = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    low, high = np.minimum(e[:, :2], e[:, 2:]) - 1e-12 * scale, np.maximum(e[:, :2], e[:, 2:]) + 1e-12 * scale
    for k in range(0, len(x), max(1, BLOCK // max(1, len(e)))):
        px, py = x[k : k + max(1, BLOCK // max(1, len(e))), None], y[k : k + max(1, BLOCK // max(1, len(e))), None]
        near = (np.abs(_side(e[None], px, py)) <= 1e-12 * scale * length) & (px >= low[:, 0]) & (px <= high[:, 0]) & (py >= low[:, 1]) & (py <= high[:, 1])
        out[k : k + len(px)][near.any(axis=1)] = 0
    return out


def _same_way(p: np.ndarray, e: np.ndarray, scale: float) -> np.ndarray:
    """Of pieces that lie on an outline: 1 where its edge there goes the same way, -1 where it goes against."""
    out = np.zeros(len(p), int)
    length = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    for i, (x1, y1, x2, y2) in enumerate(p.tolist()):
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        d = (e[:, 2] - e[:, 0]) * (x2 - x1) + (e[:, 3] - e[:, 1]) * (y2 - y1)
        turn = np.abs((e[:, 2] - e[:, 0]) * (y2 - y1) - (e[:, 3] - e[:, 1]) * (x2 - x1))
        near = (np.abs(_side(e, x, y)) <= 1e-12 * scale * length) & (turn <= 1e-9 * np.abs(d))
        low, high = np.minimum(e[:, :2], e[:, 2:]) - 1e-12 * scale, np.maximum(e[:, :2], e[:, 2:]) + 1e-12 * scale
        near &= (x >= low[:, 0]) & (x <= high[:, 0]) & (y >= low[:, 1]) & (y <= high[:, 1])
        out[i] = int(np.sign(d[near][0])) if near.any() else 0
    return out


def _numbered(layer: DataFrame, name: str) -> DataFrame:
    """layer with a number of its own for each row, computed once."""
    return cut(layer.withColumn(name, F.monotonically_increasing_id()))


def dealt(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(key, cx, cy, corner, edges) of polygons (key, geometry)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, g in zip(b[key], b["geometry"]):
                for cx, cy, corner, e in cells_of(outline(g), size):
                    out.append((k, cx, cy, corner, [dict(zip(("x1", "y1", "x2", "y2"), r)) for r in e.tolist()]))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=[key, "cx", "cy", "corner", "edges"])
                        out = []
            yield pd.DataFrame(out, columns=[key, "cx", "cy", "corner", "edges"])

    edge = "struct<x1: double, y1: double, x2: double, y2: double>"
    return polygons.where("geometry IS NOT NULL").select(key, "geometry").mapInPandas(run, f"{key} bigint, cx bigint, cy bigint, corner boolean, edges array<{edge}>")


def place_in(x: Column, y: Column, size: float) -> Column:
    """1 inside, 0 on the outline, -1 outside, of a point by its cell's corner and edges."""
    x0, y0 = F.col("cx") * F.lit(size), F.col("cy") * F.lit(size)
    side = lambda e, px, py: (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])
    span = lambda a, b, v: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = F.exists("edges", lambda e: (side(e, x, y) == 0) & span(e["x1"], e["x2"], x) & span(e["y1"], e["y2"], y))

    def crossed(e: Column) -> Column:
        """Edges between the corner and (x0, y), then between there and (x, y). A place on an edge counts as a little to the east of
        it, and where that is still on it, a little above: both ways then agree on which side of an edge (x0, y) is."""
        east = F.when(e["x2"] > e["x1"], 1.0).otherwise(-1.0)
        north = F.when(e["y2"] > e["y1"], 1.0).otherwise(-1.0)
        above = lambda py: (side(e, x0, py) * east > 0) | ((side(e, x0, py) == 0) & ((e["y2"] - e["y1"]) * east <= 0))
        up = ((e["x1"] <= x0) != (e["x2"] <= x0)) & (above(y) != above(y0))
        across = ((e["y1"] <= y) != (e["y2"] <= y)) & ((side(e, x0, y) * north > 0) != (side(e, x, y) * north > 0))
        return F.when(up, 1).otherwise(0) + F.when(across, 1).otherwise(0)

    odd = F.aggregate("edges", F.lit(0), lambda a, e: a + crossed(e)) % 2 == 1
    inside = F.when(F.size("edges") == 0, F.col("corner")).otherwise(F.col("corner") != odd)
    return F.when(on, 0).when(inside, 1).otherwise(-1)


def _wide(polygons: DataFrame) -> float:
    boxes = with_boxes(polygons.select("geometry")).select(*SIDES)
    return block_size(boxes, boxes) / 2


def points_in(points: DataFrame, polygons: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """points (x, y) with the key of each polygon that they lie in or on, and place (1 inside, 0 on the outline). A polygon with a
    third of all points takes as many cells as it covers; a crowded cell is split by Spark's own skew join."""
    size = size or _wide(polygons)
    cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("bigint")
    met = points.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"cx": cell("x"), "cy": cell("y")}).join(dealt(polygons, key, size), ["cx", "cy"])
    return met.withColumn("place", place_in(F.col("x"), F.col("y"), size)).where("place >= 0").drop("cx", "cy", "corner", "edges")


def polygon_pairs(left: DataFrame, right: DataFrame, predicate: str, size: float | None = None) -> DataFrame:
    """(__l, __r) of polygons (__l or __r, geometry) that stand in a relation. Pairs share a cell; for intersects, a cell that lies
    wholly in one of them settles it, else the kernel compares the outlines."""
    size = size or max(_wide(left), _wide(right))
    state = lambda df, k: dealt(df, k, size).select(k, "cx", "cy", (F.size("edges") == 0).alias(f"{k}_full"))
    met = state(left, "__l").join(state(right, "__r"), ["cx", "cy"]).groupBy("__l", "__r").agg(F.max(F.col("__l_full") | F.col("__r_full")).alias("sure"))
    met = cut(met)
    asked = met.where("NOT sure") if predicate == "intersects" else met
    both = asked.join(left.select("__l", F.col("geometry").alias("__lg")), "__l").join(right.select("__r", F.col("geometry").alias("__rg")), "__r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[relation(outline(x), outline(y))[predicate] for x, y in zip(b["__lg"], b["__rg"])], ["__l", "__r"]]

    found = both.mapInPandas(run, "__l bigint, __r bigint")
    return found.unionByName(met.where("sure").select("__l", "__r")) if predicate == "intersects" else found


def spatial_join_shapes(left: DataFrame, right: DataFrame, predicate: str = "intersects", *, how: str = "inner", transfer: list[str] | None = None) -> DataFrame:
    """A row for each left row and polygon of right that stand in the relation, with right's transferred columns; a name that left
    has gets the prefix right_. how = left keeps left rows without a match.

    left has points (x, y) or polygons (geometry). Points lie within a polygon that they are inside of, touch one whose outline they
    are on, and intersect both; they contain, cross and overlap none. Null geometries match nothing; repeated rows each match."""
    require(how in ("inner", "left"), f"how must be inner or left, not {how!r}")
    require(predicate in PREDICATES, f"predicate {predicate!r} is not one of {', '.join(PREDICATES)}")
    same_frame(left, right)
    names = transfer if transfer is not None else [c for c in right.columns if c != "geometry"]
    r = _numbered(right, "__r")
    new = {c: f"right_{c}" if c in left.columns else c for c in names}
    columns = r.select("__r", *[F.col(c).alias(n) for c, n in new.items()])
    lf = _numbered(left, "__l")
    if "geometry" in left.columns:
        found = polygon_pairs(lf.select("__l", "geometry"), r.select("__r", "geometry"), predicate)
    else:
        want = {"intersects": "place >= 0", "within": "place = 1", "touches": "place = 0"}.get(predicate, "false")
        found = points_in(lf.select("__l", "x", "y"), r.select("__r", "geometry"), "__r").where(want).select("__l", "__r")
    return lf.join(found, "__l", how).join(columns, "__r", "left" if how == "left" else "inner").select(*left.columns, *new.values())


def summarize_within_shapes(zones: DataFrame, features: DataFrame, stats: list[Stat]) -> DataFrame:
    """zones (geometry) with statistics of the features that meet each, points (x, y) or polygons; one on a shared edge counts in
    both. A zone without features has count 0 and no other values. Rows are added up by zone before they leave their tasks."""
    same_frame(zones, features)
    z = _numbered(zones, "__r")
    if "geometry" in features.columns:
        lf = _numbered(features, "__l")
        found = lf.join(polygon_pairs(lf.select("__l", "geometry"), z.select("__r", "geometry"), "intersects"), "__l").drop("geometry", "__l")
    else:
        found = points_in(features.drop("place"), z.select("__r", "geometry"), "__r")
    out = z.join(found.groupBy("__r").agg(*[s.column() for s in stats]), "__r", "left").drop("__r")
    zero = {s.name: F.coalesce(s.name, F.lit(0).cast("long")) for s in stats if s.op == "count"}
    return out.withColumns(zero) if zero else out
