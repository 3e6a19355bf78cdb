"""Polygon work on layers of (id, geometry: WKB): hulls, Voronoi cells, buffers, clips, smoothing, simplifying, splits, labels.

Per-feature work runs in Arrow batches. Work over all features first shrinks each task's points to what can matter."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from ..scratch import cut

#: Segments of a quarter circle.
QUARTER = 8
#: Points and edges that one round of a concave hull looks up, the fewest and the most points for an edge; edges that a block of its
#: ring holds, and what sums of distances may be off by.
LOOKED_UP, EDGES, FEWEST, MOST, BLOCK, OFF = 1 << 17, 4096, 32, 1024, 128, 1e-9
#: Points that a tile of Voronoi cells is made for, neighbours that are tried first, distances held at once.
TILE, NEAR, PAIRS = 500, 32, 1 << 21


def area(ring: np.ndarray) -> float:
    """Signed; above 0 for counter-clockwise rings."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise and closed, by a monotone chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.concatenate((p, p[:1]))

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = chain(p) + chain(p[::-1])
    return np.array([*ring, ring[0]])


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A closed ring cut to a convex, counter-clockwise, closed window; empty where apart."""
    out = ring[:-1]
    for a, b in zip(window[:-1], window[1:]):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        got = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                got.append(out[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                got.append(out[i] + side[i] / (side[i] - side[j]) * (out[j] - out[i]))
        out = np.array(got)
    return np.concatenate((out, out[:1])) if len(out) > 2 else np.zeros((0, 2))


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a closed ring, by crossings."""
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if y1 != y2:
            cross = (y1 > y) != (y2 > y)
            out ^= cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def chaikin(line: np.ndarray, smoothing: float, closed: bool, passes: int = 2) -> np.ndarray:
    """Corners cut at a quarter of the smoothing over a half; the ends of open lines stay."""
    t = 0.25 * smoothing / 0.5
    if t <= 0 or len(line) < 3:
        return line
    for _ in range(passes):
        a, b = line[:-1], line[1:]
        cut = np.stack([a + t * (b - a), b + t * (a - b)], axis=1).reshape(-1, 2)
        line = np.concatenate((cut, cut[:1])) if closed else np.concatenate((line[:1], cut[1:-1], line[-1:]))
    return line


def simplify_line(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker."""
    keep, stack = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, m = line[j] - line[i], line[i + 1 : j] - line[i]
        n = math.hypot(*d)
        off = np.abs(d[0] * m[:, 1] - d[1] * m[:, 0]) / n if n else np.hypot(m[:, 0], m[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def _rings(f: Callable[[np.ndarray, bool], np.ndarray]) -> Callable:
    def run(kind: str, c):
        if kind == "LineString":
            return kind, f(np.asarray(c), False)
        if kind == "Polygon":
            return kind, [f(np.asarray(r), True) for r in c]
        if kind.startswith("Multi") and kind != "MultiPoint":
            return kind, [run(kind[5:], x)[1] for x in c]
        return kind, c

    return run


def each(layer: DataFrame, f: Callable, geometry: str = "geometry") -> DataFrame:
    """layer with its geometries put through f(kind, coords); features that vanish go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [None if g is None else f(*wkb.decode(g)) for g in b[geometry]]
            b[geometry] = [None if o is None else wkb.encode(*o) for o in out]
            yield b

    return layer.mapInPandas(run, layer.schema).where(F.col(geometry).isNotNull())


def smooth(layer: DataFrame, smoothing: float) -> DataFrame:
    return each(layer, _rings(lambda r, closed: chaikin(r, smoothing, closed)))


def simplify(layer: DataFrame, tolerance: float) -> DataFrame:
    require(tolerance > 0, f"the tolerance must be above 0, not {tolerance}")

    def f(r: np.ndarray, closed: bool) -> np.ndarray:
        s = simplify_line(r, tolerance)
        return s if not closed or len(s) >= 4 else r

    return each(layer, _rings(f))


def simplification_loss(a: float, b: float) -> float:
    return abs(a - b) / a if a else 0.0


def measures(layer: DataFrame) -> DataFrame:
    """layer with area and length."""
    from pyspark.sql.functions import pandas_udf

    def walk(kind, c):
        if kind == "LineString":
            return 0.0, float(np.hypot(*np.diff(np.asarray(c), axis=0).T).sum())
        if kind == "Polygon":
            a = [abs(area(np.asarray(r))) for r in c]
            return a[0] - sum(a[1:]), sum(float(np.hypot(*np.diff(np.asarray(r), axis=0).T).sum()) for r in c)
        if kind.startswith("Multi"):
            got = [walk(kind[5:], x) for x in c]
            return sum(g[0] for g in got), sum(g[1] for g in got)
        return 0.0, 0.0

    @pandas_udf("area double, length double")
    def run(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else walk(*wkb.decode(v)) for v in g], columns=["area", "length"])

    return layer.withColumn("__m", run("geometry")).withColumns({"area": F.col("__m.area"), "length": F.col("__m.length")}).drop("__m")


def circle(x: float, y: float, r: float, quarter: int = QUARTER) -> np.ndarray:
    a = np.linspace(0, 2 * math.pi, 4 * quarter + 1)
    ring = np.stack([x + r * np.cos(a), y + r * np.sin(a)], axis=1)
    ring[-1] = ring[0]
    return ring


def buffer(layer: DataFrame, distance: float, resolution: int = QUARTER) -> DataFrame:
    """Points grow to discs and convex polygons by the hull of discs at their corners; convex polygons shrink by moved edges.
    Other shapes are refused: their outline isn't theirs to guess."""
    require(distance != 0, "a buffer of 0 changes nothing; give a distance")

    def f(kind, c):
        if kind == "Point":
            return ("Polygon", [circle(*c, distance, resolution)]) if distance > 0 else None
        require(kind == "Polygon" and len(c) == 1, f"buffers of {kind} with holes or parts aren't supported; explode the layer first")
        ring = np.asarray(c[0])
        ring = ring if area(ring) > 0 else ring[::-1]
        convex = abs(abs(area(hull(ring[:-1]))) - abs(area(ring))) <= 1e-9 * abs(area(ring))
        require(convex, "buffers of polygons that aren't convex aren't supported; use their hull")
        if distance > 0:
            return "Polygon", [hull(np.concatenate([circle(x, y, distance, resolution) for x, y in ring[:-1]]))]
        out = ring
        for a, b in zip(ring[:-1], ring[1:]):
            d = (b - a) / math.hypot(*(b - a))
            n = np.array([-d[1], d[0]]) * -distance
            far = 1e9
            p, q = a + n - d * far, b + n + d * far
            window = np.array([p, q, q + np.array([-d[1], d[0]]) * far, p + np.array([-d[1], d[0]]) * far, p])
            out = clip_convex(out, window)
            if not len(out):
                return None
        return "Polygon", [out]

    return each(layer, f)


def clip_to_convex(layer: DataFrame, window: np.ndarray) -> DataFrame:
    """Polygons and points cut to a convex window; what lies outside goes."""

    def f(kind, c):
        if kind == "Point":
            return (kind, c) if inside(np.array([c[0]]), np.array([c[1]]), window)[0] else None
        require(kind == "Polygon" and len(c) == 1, f"{kind} with holes or parts isn't supported here; explode the layer first")
        r = clip_convex(np.asarray(c[0]), window)
        return ("Polygon", [r]) if len(r) else None

    return each(layer, f)


def _points(layer: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(kind, c):
            if kind == "Point":
                return [c]
            if kind in ("LineString", "MultiPoint"):
                return list(c)
            return [p for x in c for p in (walk(kind[5:], x) if kind.startswith("Multi") else list(x))]

        for b in batches:
            got = [p for g in b["geometry"] if g is not None for p in walk(*wkb.decode(g))]
            yield pd.DataFrame(np.array(got, float).reshape(-1, 2), columns=["x", "y"])

    return layer.select("geometry").mapInPandas(run, "x double, y double")


def _hull_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    best = np.zeros((0, 2))
    for b in batches:
        best = hull(np.concatenate((best, b[["x", "y"]].to_numpy())))
    if len(best):
        yield pd.DataFrame(best, columns=["x", "y"])


def convex_hull(layer: DataFrame, dissolve_all: bool = True) -> DataFrame:
    """(geometry) one hull over all, from the hulls of each task's points; or each feature's own."""
    if not dissolve_all:
        return each(layer, lambda kind, c: ("Polygon", [hull(np.concatenate([np.asarray(r) for r in c]) if kind == "Polygon" else np.asarray(c).reshape(-1, 2))]))

    def whole(batches):
        for b in _hull_batches(batches):
            yield pd.DataFrame({"geometry": [wkb.encode("Polygon", [b.to_numpy()])]})

    return _points(layer).mapInPandas(_hull_batches, "x double, y double").coalesce(1).mapInPandas(whole, "geometry binary")


class _Ring:
    """A ring's edges in blocks with boxes, so that a triangle meets only the edges about it."""

    def __init__(self, edges: np.ndarray):
        self.blocks, self.block, self.box = [], {}, np.zeros((0, 4))
        for k in range(0, len(edges), BLOCK // 2):
            self._add(edges[k : k + BLOCK // 2])

    def _add(self, edges: np.ndarray) -> None:
        self.blocks.append({(e[0], e[1]): (e[2], e[3]) for e in edges.tolist()})
        self.block |= dict.fromkeys(self.blocks[-1], len(self.blocks) - 1)
        self.box = np.concatenate((self.box, self._box(edges)))

    @staticmethod
    def _box(edges: np.ndarray) -> np.ndarray:
        xy = edges.reshape(-1, 2)
        return np.concatenate((xy.min(axis=0), xy.max(axis=0)))[None]

    def _edges(self, n: int) -> np.ndarray:
        return np.array([(*i, *j) for i, j in self.blocks[n].items()])

    def after(self, a: tuple) -> tuple | None:
        return self.blocks[self.block[a]][a]

    def crossed(self, a: tuple, k: tuple, b: tuple) -> bool:
        """Whether an edge crosses the segment from a or from b to k."""
        t = np.array([a, k, b])
        lo, hi = t.min(axis=0), t.max(axis=0)
        for n in np.nonzero((self.box[:, :2] <= hi).all(axis=1) & (self.box[:, 2:] >= lo).all(axis=1))[0]:
            e = self._edges(n).reshape(-1, 2, 2)
            e = e[(e.min(axis=1) <= hi).all(axis=1) & (e.max(axis=1) >= lo).all(axis=1)]
            if _cross(t[0], t[1], e).any() or _cross(t[2], t[1], e).any():
                return True
        return False

    def dig(self, a: tuple, k: tuple, b: tuple) -> None:
        """The edge from a to b goes through k."""
        n = self.block[a]
        self.blocks[n] |= {a: k, k: b}
        self.block[k] = n
        self.box[n, :2], self.box[n, 2:] = np.minimum(self.box[n, :2], k), np.maximum(self.box[n, 2:], k)
        if len(self.blocks[n]) > BLOCK:
            e = self._edges(n)
            e = e[np.argsort(e[:, int(np.argmax(self.box[n, 2:] - self.box[n, :2]))], kind="stable")]
            half = len(e) // 2
            self.blocks[n] = {(r[0], r[1]): (r[2], r[3]) for r in e[:half].tolist()}
            self.box[n] = self._box(e[:half])
            self._add(e[half:])


def _sums(xy: np.ndarray, a, b) -> np.ndarray:
    """Distances from a and b, added."""
    return np.hypot(*(xy - a).T) + np.hypot(*(xy - b).T)


def _nearest(batches: Iterator[np.ndarray], edges: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(edge, rows of sum, x, y): of all batches of points, those with the least distances from an edge's ends added, up to twice the
    edge's length, by that sum, x and y; the first most of them. Points are tried in the box of the ellipse that still counts."""
    a, b = edges[:, :2], edges[:, 2:]
    d = np.hypot(*(b - a).T)
    way = (b - a) / np.where(d > 0, d, 1)[:, None]
    mid, bound, best = (a + b) / 2, 2 * d * (1 + OFF), {}
    for xy in batches:
        if not len(xy):
            continue
        xy = xy[np.argsort(xy[:, 0], kind="stable")]
        u = bound * (1 + OFF)
        flat = np.sqrt((u[:, None] * way) ** 2 + np.maximum(u * u - d * d, 0)[:, None] * way[:, ::-1] ** 2) / 2
        flat += OFF * (np.abs(mid) + u[:, None])
        lo, hi = mid - flat, mid + flat
        i, j = np.searchsorted(xy[:, 0], lo[:, 0], "left"), np.searchsorted(xy[:, 0], hi[:, 0], "right")
        for e in np.nonzero((i < j) & (lo[:, 1] <= xy[:, 1].max()) & (hi[:, 1] >= xy[:, 1].min()))[0]:
            p = xy[i[e] : j[e]]
            p = p[(p[:, 1] >= lo[e, 1]) & (p[:, 1] <= hi[e, 1])]
            s = _sums(p, a[e], b[e])
            new = np.column_stack((s, p))[s <= bound[e]]
            if not len(new):
                continue
            got = np.concatenate((best[e], new)) if e in best else new
            best[e] = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))[:most]]
            if len(best[e]) == most:
                bound[e] = best[e][-1, 0]
    yield from best.items()


def _dig(ring: np.ndarray, count: int, ratio: float, look: Callable[[np.ndarray, int, np.ndarray], dict[int, np.ndarray]]) -> np.ndarray:
    """The outline left after digging from the hull of count points: the longest edge above the ratio's length gives way to the
    nearest point that isn't used, while edges don't cross.

    Points are looked up: look(edges, most, used) gives for the edges what _nearest does over all points but the used ones. An edge
    is dug as long as its nearest point is known for sure. Points that an edge's list doesn't have lie beyond some sum of distances
    from its ends; from the ends of an edge dug out of it they lie beyond that sum less the other edge's length, so the list serves
    both. When the longest edge's list is used up, it is looked up again, and with it the next ones that need it."""
    first = [tuple(v) for v in ring[:-1].tolist()]
    edges = _Ring(np.column_stack((ring[:-1], ring[1:])))
    long = lambda a, b: math.hypot(b[0] - a[0], b[1] - a[1])
    used, near = dict.fromkeys(first), {}
    heap = [(-long(a, b), a, b) for a, b in zip(first, first[1:] + first[:1])]
    heapq.heapify(heap)
    limit = ratio * -heap[0][0]

    def found(d: float, a: tuple, b: tuple) -> tuple | bool | None:
        """The nearest point of an edge; False where none can be near enough, None where that isn't known."""
        rows, known = near.get(a, (np.zeros((0, 3)), 0.0))
        for n in range(len(rows)):
            if (k := tuple(rows[n, 1:].tolist())) not in used:
                near[a] = rows[n:], known
                return k
        near[a] = rows[:0], known
        return False if known >= 2 * d * (1 + OFF) else None

    while heap and -heap[0][0] > limit and len(used) < count:
        d, a, b = heap[0]
        d, k = -d, found(-d, a, b)
        if k is None:
            heap.sort()
            ask = []
            for e in heap:
                if -e[0] <= limit or len(ask) == EDGES:
                    break
                if found(-e[0], *e[1:]) is None:
                    ask.append(e)
            most = min(MOST, max(FEWEST, LOOKED_UP // len(ask)))
            got = look(np.array([(*e[1], *e[2]) for e in ask]), most, np.array(list(used)))
            for n, e in enumerate(ask):
                rows = got.get(n, np.zeros((0, 3)))
                near[e[1]] = rows, rows[-1, 0] if len(rows) == most else -2 * e[0] * (1 + OFF)
            continue
        heapq.heappop(heap)
        rows, known = near.pop(a)
        if k is False or max(long(a, k), long(k, b)) >= d or edges.crossed(a, k, b):
            continue
        edges.dig(a, k, b)
        used[k] = None
        for s, e, other in ((a, k, long(k, b)), (k, b, long(a, k))):
            if long(s, e) > limit:
                sure, own = (known - other) * (1 - OFF) - OFF * other, _sums(rows[:, 1:], s, e)
                mine = np.column_stack((own, rows[:, 1:]))[own < sure]
                near[s] = mine[np.lexsort((mine[:, 2], mine[:, 1], mine[:, 0]))], sure
                heapq.heappush(heap, (-long(s, e), s, e))
    walk, at = [first[0]], edges.after(first[0])
    while at != first[0]:
        walk.append(at)
        at = edges.after(at)
    return np.array([*walk, first[0]])


def concave(points: np.ndarray, ratio: float) -> np.ndarray:
    """The concave outline of points at hand; empty ones, as NaN, have no part in it."""
    p = np.unique(points[~np.isnan(points).any(axis=1)], axis=0)
    require(bool(np.isfinite(p).all()), "a concave hull needs finite coordinates")
    ring = hull(p)
    if len(p) < 4 or ratio >= 1:
        return ring

    def look(edges: np.ndarray, most: int, used: np.ndarray) -> dict[int, np.ndarray]:
        out = set(map(tuple, used.tolist()))
        return dict(_nearest([np.array([v for v in p.tolist() if tuple(v) not in out]).reshape(-1, 2)], edges, most))

    return _dig(ring, len(p), ratio, look)


def _cross(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    c, d = edges[:, 0], edges[:, 1]
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def concave_hull(layer: DataFrame, ratio: float = 0.3) -> DataFrame:
    """(geometry) one concave outline over all points of the layer, however many; empty ones have no part in it.

    Points stay where Spark holds them; the driver digs the ring, which the one row of the result holds anyway, and each round looks
    up a bounded number of points nearest to those edges that come next."""
    require(0 <= ratio <= 1, f"the ratio must be 0 to 1, not {ratio}")
    spark = layer.sparkSession
    p = cut(_points(layer).dropna().distinct().sortWithinPartitions("x"))
    count, far = p.agg(F.count("*"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    require(count == 0 or far < math.inf, "a concave hull needs finite coordinates")
    ring = hull(p.mapInPandas(_hull_batches, "x double, y double").repartition(1).mapInPandas(_hull_batches, "x double, y double").toPandas().to_numpy(float))

    def look(edges: np.ndarray, most: int, used: np.ndarray) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for e, rows in _nearest((b[["x", "y"]].to_numpy() for b in batches), edges, most):
                yield pd.DataFrame({"e": e, "s": rows[:, 0], "x": rows[:, 1], "y": rows[:, 2]})

        free = p.join(F.broadcast(spark.createDataFrame(pa.table({"x": used[:, 0], "y": used[:, 1]}))), ["x", "y"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("e").orderBy("s", "x", "y"))
        got = free.mapInPandas(run, "e int, s double, x double, y double").withColumn("n", rank).where(F.col("n") <= most).toPandas().sort_values(["e", "n"])
        return {int(e): g[["s", "x", "y"]].to_numpy() for e, g in got.groupby("e")}

    if ratio < 1 and count > 3:
        ring = _dig(ring, count, ratio, look)
    return spark.createDataFrame([(wkb.encode("Polygon", [ring]),)] if len(ring) else [], "geometry binary")


def _clip_many(ring: np.ndarray, size: np.ndarray, mid: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open convex rings [rings, vertices, 2], the first size vertices of each, cut to the side of mid that way points away from."""
    at = np.arange(ring.shape[1])
    side = ((ring - mid[:, None]) * way[:, None]).sum(axis=2)
    own = at < size[:, None]
    cut_ = np.nonzero((own & (side > 0)).any(axis=1))[0]
    if not len(cut_):
        return ring, size
    r, s, own = ring[cut_], side[cut_], own[cut_]
    after = np.where(at + 1 < size[cut_, None], at + 1, 0)
    r2, s2 = np.take_along_axis(r, after[:, :, None], 1), np.take_along_axis(s, after, 1)
    meets = own & (((s < 0) & (s2 > 0)) | ((s > 0) & (s2 < 0)))
    t = np.divide(s, s - s2, out=np.zeros_like(s), where=meets)
    both = np.stack([r, r + t[:, :, None] * (r2 - r)], axis=2).reshape(len(r), -1, 2)
    keep = np.stack([own & (s <= 0), meets], axis=2).reshape(len(r), -1)
    left = keep.sum(axis=1)
    size = size.copy()
    size[cut_] = np.where(left > 2, left, 0)
    most = max(int(size.max()), 1)
    out = np.zeros((len(ring), max(most, ring.shape[1]), 2))
    out[:, : ring.shape[1]] = ring
    first = np.argsort(~keep, axis=1, kind="stable")[:, :most]
    out[cut_, : first.shape[1]] = np.take_along_axis(both, first[:, :, None], 1)
    return out[:, :most], size


def _reach(ring: np.ndarray, size: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Distances of the rings' vertices from their points, 0 beyond a ring's size."""
    return np.where(np.arange(ring.shape[1]) < size[:, None], np.hypot(*np.moveaxis(ring - xy[:, None], 2, 0)), 0.0)


def _cells(own: np.ndarray, xy: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings and their sizes of the points own (numbers into xy) among all of xy; size 0 where another lies at the same place."""
    ring, size = np.repeat(window[None, :-1], len(own), axis=0), np.full(len(own), len(window) - 1)
    far = np.hypot(*(xy[own, None] - xy[None]).transpose(2, 0, 1))
    todo, at, k = np.arange(len(own)), 1, min(NEAR, len(xy))
    while len(todo):
        near = np.argpartition(far[todo], k - 1, axis=1)[:, :k] if k < len(xy) else np.broadcast_to(np.arange(k), (len(todo), k))
        d = np.take_along_axis(far[todo], near, 1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        if at == 1 and k > 1:
            size[todo[d[:, 1] == 0]] = 0
        r, s, c = ring[todo], size[todo], xy[own[todo]]
        for j in range(at, k):
            live = np.nonzero((s > 0) & (d[:, j] <= 2 * _reach(r, s, c).max(axis=1)))[0]
            if not len(live):
                break
            q = xy[near[live, j]]
            got, n = _clip_many(r[live], s[live], (q + c[live]) / 2, (q - c[live]) / d[live, j, None])
            if got.shape[1] > r.shape[1]:
                r = np.pad(r, ((0, 0), (0, got.shape[1] - r.shape[1]), (0, 0)))
            r[live, : got.shape[1]], s[live] = got, n
        if r.shape[1] > ring.shape[1]:
            ring = np.pad(ring, ((0, 0), (0, r.shape[1] - ring.shape[1]), (0, 0)))
        ring[todo, : r.shape[1]], size[todo] = r, s
        todo = todo[(s > 0) & (d[:, -1] <= 2 * _reach(r, s, c).max(axis=1))] if k < len(xy) else todo[:0]
        at, k = k, min(8 * k, len(xy))
    return ring, size


def voronoi(points: DataFrame, clip_to: np.ndarray | None = None) -> DataFrame:
    """(id, x, y, geometry): each point's Thiessen cell in a convex window, by default the extent with a margin of 10 % of its
    larger side. Points at one place have no cell. Every cell is cut by bisectors with its neighbours, nearest first, until none
    can reach it.

    Points go to tiles, and each tile is solved with the eight around it. What could still cut a cell lies nearer to one of its
    corners than its own point does: where such a circle leaves those tiles, the points in the circles are looked up and cut it too."""
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, x0, x1, y0, y1 = p.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    require(n >= 3, f"Voronoi cells need 3 points or more, not {n}")
    pad = 0.1 * max(x1 - x0, y1 - y0)
    box = np.array([[x0 - pad, y0 - pad], [x1 + pad, y0 - pad], [x1 + pad, y1 + pad], [x0 - pad, y1 + pad], [x0 - pad, y0 - pad]])
    window = clip_to if clip_to is not None else box
    side = max(math.sqrt((x1 - x0) * (y1 - y0) * TILE / n), max(x1 - x0, y1 - y0) * TILE / n) or 1.0
    lo, hi = np.array([x0, y0]), np.array([x1, y1])
    at = lambda c, low: F.floor((F.col(c) - low) / side).cast("long")
    tiled = p.withColumns({"cx": at("x", x0), "cy": at("y", y0)})
    about = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    kind = points.schema["id"].dataType.simpleString()

    def span(ring: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tiles, from and to, that the circle of each corner meets; a little wider, as a corner is rounded."""
        r = np.hypot(*(ring - c).T)[:, None] * (1 + 1e-9)
        first, last = (np.floor((np.clip(e, lo, hi) - lo) / side).astype(int) for e in (ring - r, ring + r))
        return first, last

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        xy, ids, out = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy(), []
        home, step = np.nonzero(pdf["own"].to_numpy())[0], max(1, PAIRS // len(pdf))
        for k in range(0, len(home), step):
            own = home[k : k + step]
            for i, r, m in zip(own, *_cells(own, xy, window)):
                if m:
                    first, last = span(r[:m], xy[i])
                    done = (first >= np.array(key) - 1).all() and (last <= np.array(key) + 1).all()
                    out.append((ids[i], *xy[i], wkb.encode("Polygon", [np.concatenate((r[:m], r[:1]))]), done))
        return pd.DataFrame(out, columns=["id", "x", "y", "geometry", "done"])

    shape = f"id {kind}, x double, y double, geometry binary"
    first = cut(tiled.select("id", "x", "y", about.alias("t")).select("t.*", "id", "x", "y").groupBy("cx", "cy").applyInPandas(solve, f"{shape}, done boolean"))
    left = first.withColumn("cell", F.monotonically_increasing_id()).where("NOT done").drop("done")

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, x, y, g in zip(b["cell"], b["x"], b["y"], b["geometry"]):
                ring, c = np.asarray(wkb.decode(g)[1][0])[:-1], np.array([x, y])
                r = np.hypot(*(ring - c).T) * (1 + 1e-9)
                seen = {(i, j) for a, z in zip(*span(ring, c)) for i in range(a[0], z[0] + 1) for j in range(a[1], z[1] + 1)}
                out += [(cell, i, j, x, y, [float(v) for v in np.column_stack((ring, r)).ravel()]) for i, j in seen]
            yield pd.DataFrame(out, columns=["cell", "cx", "cy", "px", "py", "circles"])

    circles = left.mapInPandas(looked_up, "cell long, cx long, cy long, px double, py double, circles array<double>")
    v = lambda k, i: F.get("circles", 3 * k + i)
    inside_ = F.exists(F.sequence(F.lit(0), (F.size("circles") / 3).cast("int") - 1), lambda k: (F.col("x") - v(k, 0)) * (F.col("x") - v(k, 0)) + (F.col("y") - v(k, 1)) * (F.col("y") - v(k, 1)) < v(k, 2) * v(k, 2))
    found = circles.join(tiled.select("cx", "cy", "x", "y"), ["cx", "cy"]).where("x <> px OR y <> py").where(inside_)
    by = found.groupBy("cell").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x, y, g, xs, ys in zip(b["id"], b["x"], b["y"], b["geometry"], b["xs"], b["ys"]):
                ring = np.asarray(wkb.decode(g)[1][0])[None, :-1]
                c, m = np.array([[x, y]]), np.array([ring.shape[1]])
                for q in np.column_stack((xs, ys)) if xs is not None else ():
                    ring, m = _clip_many(ring, m, (q + c) / 2, q - c)
                if m[0]:
                    out.append((i, x, y, wkb.encode("Polygon", [np.concatenate((ring[0, : m[0]], ring[0, :1]))])))
            yield pd.DataFrame(out, columns=["id", "x", "y", "geometry"])

    return first.where("done").drop("done").unionAll(left.join(by, "cell", "left").select("id", "x", "y", "geometry", "xs", "ys").mapInPandas(again, shape))


def split_polygon(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The parts of a convex ring on both sides of the line through a and b; the ring alone where it isn't cut."""
    d = (b - a) / math.hypot(*(b - a))
    n, far = np.array([-d[1], d[0]]), 4 * (np.abs(ring).max() + np.abs(a).max() + 1)
    parts = []
    for s in (1, -1):
        w = np.array([a - d * far, a + d * far, a + d * far + s * n * far, a - d * far + s * n * far, a - d * far])
        r = clip_convex(ring, w if area(w) > 0 else w[::-1])
        if len(r):
            parts.append(r)
    return parts


def split(layer: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """Polygons of the layer split by a line; parts carry split_from_id."""
    kind = layer.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, g in zip(batch["id"], batch["geometry"]):
                k, c = wkb.decode(g)
                require(k == "Polygon" and len(c) == 1, f"{k} with holes or parts can't be split here; explode the layer first")
                parts = split_polygon(np.asarray(c[0]), np.array(a, float), np.array(b, float))
                out += [(i, n, i if len(parts) > 1 else None, wkb.encode("Polygon", [r])) for n, r in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "part", "split_from_id", "geometry"])

    return layer.select("id", "geometry").mapInPandas(run, f"id {kind}, part int, split_from_id {kind}, geometry binary")


def explode(layer: DataFrame) -> DataFrame:
    """A row (with column part) for each part of multi-geometries."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<binary>")
    def run(g: pd.Series) -> pd.Series:
        def parts(v):
            k, c = wkb.decode(v)
            return [wkb.encode(k[5:], x) for x in c] if k.startswith("Multi") else [v]

        return pd.Series([None if v is None else parts(v) for v in g])

    return layer.select(*[c for c in layer.columns if c != "geometry"], F.posexplode(run("geometry")).alias("part", "geometry"))


def combine(layer: DataFrame, by: str) -> DataFrame:
    """(by, geometry): the geometries of a group as one multi-geometry of their kind, undissolved."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [wkb.decode(g) for g in pdf["geometry"]]
        kinds = {k.removeprefix("Multi") for k, _ in got}
        require(len(kinds) == 1, f"a group holds {' and '.join(sorted(kinds))}; combine one kind at a time")
        parts = [p for k, c in got for p in (c if k.startswith("Multi") else [c])]
        return pd.DataFrame({by: [key[0]], "geometry": [wkb.encode("Multi" + kinds.pop(), parts)]})

    return layer.groupBy(by).applyInPandas(run, f"{by} {layer.schema[by].dataType.simpleString()}, geometry binary")


def pole(ring: np.ndarray, precision: float) -> tuple[float, float, float]:
    """(x, y, clearance) of the point of a ring farthest from its edge, by halving cells."""
    a, b = ring[:-1], ring[1:]
    d = b - a
    n2 = np.maximum((d * d).sum(axis=1), 1e-300)

    def away(x: float, y: float) -> float:
        t = np.clip(((np.array([x, y]) - a) * d).sum(axis=1) / n2, 0, 1)
        m = float(np.hypot(*(a + t[:, None] * d - np.array([x, y])).T).min())
        return m if inside(np.array([x]), np.array([y]), ring)[0] else -m

    lo, hi = ring.min(axis=0), ring.max(axis=0)
    h = float(min(hi - lo)) / 2 or 1.0
    cells = [(x, y, h) for x in np.arange(lo[0] + h, hi[0] + h, 2 * h) for y in np.arange(lo[1] + h, hi[1] + h, 2 * h)]
    best = max(((away(x, y), x, y) for x, y in [tuple(ring[:-1].mean(axis=0))] + [c[:2] for c in cells]))
    heap = [(-(away(x, y) + h * math.sqrt(2)), x, y, h) for x, y, h in cells]
    heapq.heapify(heap)
    while heap:
        top, x, y, h = heapq.heappop(heap)
        if -top - best[0] <= precision:
            break
        h /= 2
        for dx in (-h, h):
            for dy in (-h, h):
                v = away(x + dx, y + dy)
                best = max(best, (v, x + dx, y + dy))
                heapq.heappush(heap, (-(v + h * math.sqrt(2)), x + dx, y + dy, h))
    return best[1], best[2], best[0]


def label_anchors(layer: DataFrame, tolerance_ratio: float = 0.01) -> DataFrame:
    """layer's id with x, y, clearance: the centroid where it lies inside, else the pole of the largest part."""
    kind = layer.schema["id"].dataType.simpleString()

    def anchor(k, c):
        rings = [np.asarray(c[0])] if k == "Polygon" else [np.asarray(x[0]) for x in c]
        ring = max(rings, key=lambda r: abs(area(r)))
        x, y = ring[:, 0], ring[:, 1]
        cr = x[:-1] * y[1:] - x[1:] * y[:-1]
        s = 3 * cr.sum()
        cx, cy = ((x[:-1] + x[1:]) * cr).sum() / s, ((y[:-1] + y[1:]) * cr).sum() / s
        px, py, clear = pole(ring, tolerance_ratio * math.sqrt(abs(area(ring))))
        return (float(cx), float(cy), clear) if inside(np.array([cx]), np.array([cy]), ring)[0] else (px, py, clear)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, *anchor(*wkb.decode(g))) for i, g in zip(b["id"], b["geometry"]) if g is not None and wkb.decode(g)[0] in ("Polygon", "MultiPolygon")]
            yield pd.DataFrame(got, columns=["id", "x", "y", "clearance"])

    return layer.select("id", "geometry").mapInPandas(run, f"id {kind}, x double, y double, clearance double")
