"""Surface estimation by linear systems: kriging, splines, minimum curvature, cross-validation, regression kriging.

Grid cells are spread over tasks; the control points, of a checked number, are broadcast as arrays, and each batch of cells
finds its neighbours and solves its systems by NumPy. Beyond the number, cells meet their neighbours through neighbours.knn
first (`local_kriging`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from .neighbours import knn
from .variogram import Model

#: Control points that may be broadcast, neighbours of kriging and splines, and cells of a block.
CONTROL_MAX, NEIGHBOURS, BLOCK = 2_000_000, 48, 512
#: Nodes a side of the coarsest grid of minimum curvature.
COARSEST = 16


def _control(control: DataFrame):
    n = control.limit(CONTROL_MAX + 1).count()
    require(1 <= n <= CONTROL_MAX, f"gridding takes 1 to {CONTROL_MAX} control points, not {n}")
    rows = control.select("id", "x", "y", "value").where("value IS NOT NULL").toPandas().sort_values("id")
    return rows[["x", "y"]].to_numpy(float), rows["value"].to_numpy(float)


class _Tree:
    """Neighbours by a grid of buckets."""

    def __init__(self, xy: np.ndarray, k: int):
        self.xy, self.k = xy, min(k, len(xy))
        lo, hi = xy.min(axis=0), xy.max(axis=0)
        self.lo, self.size = lo, float(max((hi - lo).max(), 1e-9) / max(1.0, np.sqrt(len(xy) / 4)))
        cell = np.floor((xy - lo) / self.size).astype(np.int64)
        self.shape = cell.max(axis=0) + 1
        code = cell[:, 0] * self.shape[1] + cell[:, 1]
        self.order = np.argsort(code, kind="stable")
        self.starts = np.searchsorted(code[self.order], np.arange(self.shape[0] * self.shape[1] + 1))

    def near(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, distances) of the k nearest, ties by index."""
        c = np.floor((p - self.lo) / self.size).astype(np.int64)
        ring = 1
        while True:
            x = np.arange(max(0, c[0] - ring), min(self.shape[0], c[0] + ring + 1))
            y0, y1 = max(0, c[1] - ring), min(self.shape[1], c[1] + ring + 1)
            got = np.concatenate([self.order[self.starts[i * self.shape[1] + y0] : self.starts[i * self.shape[1] + y1]] for i in x]) if len(x) and y0 < y1 else np.zeros(0, np.int64)
            whole = len(got) == len(self.xy)
            if len(got) >= self.k or whole:
                d = np.hypot(*(self.xy[got] - p).T)
                pick = np.lexsort((got, d))[: self.k]
                if whole or d[pick[-1]] <= ring * self.size:
                    return got[pick], d[pick]
            ring *= 2


def drift_basis(xy: np.ndarray, order: int) -> np.ndarray:
    x, y = xy[:, 0], xy[:, 1]
    terms = [np.ones(len(xy))] + ([x, y] if order > 0 else []) + ([x * x, x * y, y * y] if order > 1 else [])
    return np.stack(terms, axis=1)


def solve_kriging(near: np.ndarray, z: np.ndarray, node: np.ndarray, model: Model, *, order: int = 0, mean: float | None = None, block: np.ndarray | None = None) -> tuple[float, float]:
    """(estimate, variance) at a node from its neighbours: ordinary (order 0), universal (1, 2), or simple with a mean. block:
    offsets whose average the estimate is of. A singular system falls back to the nearest value."""
    s = model.stretched(near)
    targets = model.stretched(node + (block if block is not None else np.zeros((1, 2))))
    c = model.covariance(np.hypot(s[:, None, 0] - s[None, :, 0], s[:, None, 1] - s[None, :, 1]))
    k = model.covariance(np.hypot(s[:, None, 0] - targets[None, :, 0], s[:, None, 1] - targets[None, :, 1])).mean(axis=1)
    own = model.sill if block is None else float(model.covariance(np.hypot(targets[:, None, 0] - targets[None, :, 0], targets[:, None, 1] - targets[None, :, 1])).mean())
    try:
        if mean is not None:
            w = np.linalg.solve(c, k)
            return float(mean + w @ (z - mean)), float(max(0.0, own - w @ k))
        scale = max(float(np.abs(near - node).max()), 1e-12)
        f = drift_basis((near - node) / scale, order)
        f0 = drift_basis(np.zeros((1, 2)), order)[0]
        n, m = len(z), f.shape[1]
        a = np.zeros((n + m, n + m))
        a[:n, :n], a[:n, n:], a[n:, :n] = c, f, f.T
        out = np.linalg.solve(a, np.concatenate((k, f0)))
        return float(out[:n] @ z), float(max(0.0, own - out[:n] @ k - out[n:] @ f0))
    except np.linalg.LinAlgError:
        return float(z[0]), float(model.sill)


def _estimate(cells: DataFrame, control: DataFrame, solve, k: int, schema: str = "cell_id long, value double, variance double") -> DataFrame:
    shared = cells.sparkSession.sparkContext.broadcast(_control(control))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, z = shared.value
        tree = _Tree(xy, k)
        for b in batches:
            out = []
            for i, x, y in zip(b["cell_id"], b["x"], b["y"]):
                p = np.array([x, y])
                at, d = tree.near(p)
                out.append((i, *solve(xy[at], z[at], d, p)))
            yield pd.DataFrame(out, columns=["cell_id", "value", "variance"])

    return cells.select("cell_id", "x", "y").mapInPandas(run, schema)


def kriging(cells: DataFrame, control: DataFrame, model: Model, *, k: int = NEIGHBOURS, order: int = 0, mean: float | None = None, radius: float | None = None, least: int = 1, block: float | None = None) -> DataFrame:
    """(cell_id, value, variance): ordinary, universal (order 1 or 2), simple (mean) or block (cell size, 4 x 4 points) kriging
    with neighbours within the radius, the model's range by default; fewer than `least` give no value."""
    require(order in (0, 1, 2), f"the drift order must be 0, 1 or 2, not {order}")
    reach = radius or model.range
    grid = None
    if block:
        o = (np.arange(4) + 0.5) / 4 * block - block / 2
        grid = np.stack(np.meshgrid(o, o), axis=-1).reshape(-1, 2)

    def solve(near, z, d, node):
        ok = d <= reach
        near, z, d = near[ok], z[ok], d[ok]
        if len(z) < max(least, 1):
            return None, None
        if len(z) == 1 and mean is None:
            return float(z[0]), float(model.gamma(d[0]) * 2)
        fits = max((o for o in range(order + 1) if len(z) > (1, 3, 6)[o]), default=0)
        if d[0] == 0 and grid is None and model.nugget == 0:
            return float(z[0]), 0.0
        return solve_kriging(near, z, node, model, order=fits, mean=mean, block=grid)

    return _estimate(cells, control, solve, k)


def local_kriging(cells: DataFrame, control: DataFrame, model: Model, k: int = 16) -> DataFrame:
    """Ordinary kriging for any number of control points: neighbours by a blocked join, one small system for each cell."""
    near = knn(cells.select(F.col("cell_id").alias("query_id"), "x", "y"), control, k, max_radius=model.range).join(control.select("id", "x", "y", F.col("value").alias("z")), "id")
    joined = near.join(cells.select(F.col("cell_id").alias("query_id"), F.col("x").alias("cx"), F.col("y").alias("cy")), "query_id")
    gathered = joined.groupBy("query_id", "cx", "cy").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y", "z"))).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, cx, cy, n in zip(b["query_id"], b["cx"], b["cy"], b["n"]):
                xy, z = np.array([[r["x"], r["y"]] for r in n]), np.array([r["z"] for r in n])
                out.append((i, *((float(z[0]), float(model.sill)) if len(z) == 1 else solve_kriging(xy, z, np.array([cx, cy]), model))))
            yield pd.DataFrame(out, columns=["cell_id", "value", "variance"])

    return gathered.mapInPandas(run, "cell_id long, value double, variance double")


KERNELS = {"thin_plate": lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0), "cubic": lambda r: r**3, "quintic": lambda r: -(r**5), "linear": lambda r: -r}


def spline(cells: DataFrame, control: DataFrame, *, kernel: str = "thin_plate", smoothing: float = 0.0, k: int = NEIGHBOURS, radius: float | None = None) -> DataFrame:
    """(cell_id, value, variance null): local radial basis functions with a linear part; coincident controls are averaged."""
    require(kernel in KERNELS, f"kernel {kernel!r} is not one of {', '.join(KERNELS)}")
    f = KERNELS[kernel]
    merged = control.groupBy(F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y")).agg(F.min("id").alias("id"), F.avg("value").alias("value"))

    def solve(near, z, d, node):
        if radius is not None and d[0] > radius:
            return None, None
        scale = max(float(np.abs(near - node).max()), 1e-12)
        p = (near - node) / scale
        order = 1 if len(z) >= 4 else 0
        b = drift_basis(p, order)
        n, m = len(z), b.shape[1]
        a = np.zeros((n + m, n + m))
        a[:n, :n] = f(np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])) + smoothing * np.eye(n)
        a[:n, n:], a[n:, :n] = b, b.T
        w = np.linalg.lstsq(a, np.concatenate((z, np.zeros(m))), rcond=None)[0]
        return float(w[:n] @ f(np.hypot(*p.T)) + w[n]), None

    return _estimate(cells, merged, solve, k)


def overshoot(surface: DataFrame, control: DataFrame) -> DataFrame:
    """One row: how far the surface's range exceeds the control's, relative to it."""
    a = surface.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    c = control.agg(F.min("value").alias("c"), F.max("value").alias("d"))
    return a.join(F.broadcast(c)).select(F.try_divide(F.greatest(F.col("b") - F.col("d"), F.lit(0.0)) + F.greatest(F.col("c") - F.col("a"), F.lit(0.0)), F.col("d") - F.col("c")).alias("overshoot"))


def cross_validate(control: DataFrame, model: Model, *, k: int = NEIGHBOURS, most: int | None = None) -> DataFrame:
    """One row (n, rmse, mean_error, mae, std): each control point estimated from the others, or about `most` of them by a hash."""
    n = control.count() if most is not None else 0
    xy, z = _control(control)
    shared = control.sparkSession.sparkContext.broadcast((xy, z))
    asked = control if most is None or n <= most else control.where(F.xxhash64("id") / 2.0**64 + 0.5 < most / n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, z = shared.value
        tree = _Tree(xy, k + 1)
        for b in batches:
            out = []
            for x, y, v in zip(b["x"], b["y"], b["value"]):
                at, d = tree.near(np.array([x, y]))
                own = np.flatnonzero((d == 0) & (z[at] == v))  # only the control left out goes, not others at its place
                at = np.delete(at, own[:1])
                if len(at) > 1:
                    out.append((solve_kriging(xy[at], z[at], np.array([x, y]), model)[0] - v,))
            yield pd.DataFrame(out, columns=["e"])

    e = asked.select("x", "y", "value").mapInPandas(run, "e double")
    return e.agg(F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean_error"), F.avg(F.abs("e")).alias("mae"), F.stddev_pop("e").alias("std"))


def minimum_curvature_array(nx: int, ny: int, cells: np.ndarray, z: np.ndarray, *, tension: float = 0.0, blocked: set | None = None, soft: set | None = None, iterations: int = 20_000, tolerance: float = 1e-7) -> tuple[np.ndarray, int]:
    """(surface [ny, nx], iterations): least squares of second differences (and first, by the tension) that pass near the data at
    fractional cells (col, row), by conjugate gradients without a matrix. blocked: links (row, col, way) no difference spans, as a
    fault parts the surface; soft: links that only second differences don't span, as a breakline bends it.

    A grid starts from the surface, without such links, of one half as fine, and so on down to COARSEST nodes a side. A
    surface that doesn't reach the tolerance (the residual's share of the right-hand side) within the iterations is an error."""
    v0 = None
    if min(nx, ny) > 2 * COARSEST:
        cx, cy = (nx + 1) // 2, (ny + 1) // 2
        scale = np.array([(cx - 1) / (nx - 1), (cy - 1) / (ny - 1)])
        rough, _ = minimum_curvature_array(cx, cy, cells * scale, z, tension=tension, iterations=iterations, tolerance=tolerance)
        v0 = _stretched(rough, nx, ny).ravel()
    open_e, open_s = np.ones((ny, nx - 1), bool), np.ones((ny - 1, nx), bool)
    for r, c, way in blocked or ():
        (open_e if way == "e" else open_s)[r, c] = False
    flat_e, flat_s = open_e.copy(), open_s.copy()
    for r, c, way in soft or ():
        (flat_e if way == "e" else flat_s)[r, c] = False
    c0, r0 = np.clip(np.floor(cells[:, 0]).astype(int), 0, nx - 2), np.clip(np.floor(cells[:, 1]).astype(int), 0, ny - 2)
    fx, fy = cells[:, 0] - c0, cells[:, 1] - r0
    at = np.stack([r0 * nx + c0, r0 * nx + c0 + 1, (r0 + 1) * nx + c0, (r0 + 1) * nx + c0 + 1])
    wt = np.stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy])
    xx, yy = flat_e[:, :-1] & flat_e[:, 1:], flat_s[:-1] & flat_s[1:]
    data, grad = 1000.0, max(tension, 1e-6)

    def normal(v: np.ndarray) -> np.ndarray:
        s = v.reshape(ny, nx)
        out = np.zeros_like(s)
        d = np.where(xx, s[:, :-2] - 2 * s[:, 1:-1] + s[:, 2:], 0)
        out[:, :-2] += d
        out[:, 1:-1] -= 2 * d
        out[:, 2:] += d
        d = np.where(yy, s[:-2] - 2 * s[1:-1] + s[2:], 0)
        out[:-2] += d
        out[1:-1] -= 2 * d
        out[2:] += d
        d = np.where(open_e, s[:, 1:] - s[:, :-1], 0) * grad
        out[:, 1:] += d
        out[:, :-1] -= d
        d = np.where(open_s, s[1:] - s[:-1], 0) * grad
        out[1:] += d
        out[:-1] -= d
        flat = out.ravel()
        np.add.at(flat, at, wt * (data * (wt * v[at]).sum(axis=0)))
        return flat

    rhs = np.zeros(nx * ny)
    np.add.at(rhs, at, wt * (data * z))
    v = v0 if v0 is not None else np.full(nx * ny, float(z.mean()))
    r = rhs - normal(v)
    p, rs, stop, n = r.copy(), float(r @ r), tolerance * tolerance * float(rhs @ rhs), 0
    while rs > stop and n < iterations:
        q = normal(p)
        step = rs / float(p @ q)
        v += step * p
        r -= step * q
        rs, old = float(r @ r), rs
        p = r + rs / old * p
        n += 1
    share = float(np.sqrt(rs / max(float(rhs @ rhs), 1e-300)))
    require(rs <= stop, f"minimum curvature stopped after {n} iterations at a residual of {share:.2g}, above {tolerance:.2g}; take a coarser grid, more iterations or a wider tolerance")
    return v.reshape(ny, nx), n


def _stretched(s: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """s on a finer grid with the same corners, by lines between its nodes."""

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        p = np.linspace(0, m - 1, n)
        lo = np.minimum(p.astype(int), m - 2)
        return lo, p - lo

    (r, fr), (c, fc) = at(ny, s.shape[0]), at(nx, s.shape[1])
    rows = s[r] * (1 - fr)[:, None] + s[r + 1] * fr[:, None]
    return rows[:, c] * (1 - fc) + rows[:, c + 1] * fc


def minimum_curvature(spark, grid, control: DataFrame, *, tension: float = 0.0, blocked: DataFrame | None = None, soft: DataFrame | None = None) -> DataFrame:
    """(cell_id, row, col, value): one global system over a capped number of cells, solved in one task. blocked and soft are links
    (row, col, way) that faults and breaklines cross, as blocked_links() gives them; at most two for each cell of the capped grid."""
    xy, z = _control(control)
    links, bends = ({tuple(r) for r in df.select("row", "col", "way").toLocalIterator()} if df is not None else set() for df in (blocked, soft))
    nx, ny, x0, y0, size = grid.nx, grid.ny, grid.x0, grid.y0, grid.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            at = np.stack([(xy[:, 0] - x0) / size - 0.5, (y0 - xy[:, 1]) / size - 0.5], axis=1)
            s, _ = minimum_curvature_array(nx, ny, at, z, tension=tension, blocked=links, soft=bends)
            i = np.arange(nx * ny)
            yield pd.DataFrame({"cell_id": i, "row": (i // nx).astype(np.int32), "col": (i % nx).astype(np.int32), "value": s.ravel()})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "cell_id long, row int, col int, value double")


def regression_kriging(cells: DataFrame, control: DataFrame, covariates: list[str], model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """(cell_id, trend, residual, value): a linear trend in covariates by least squares from one pass of sums, and ordinary
    kriging of what it leaves."""
    names = ["__one", *covariates]
    own = control.withColumn("__one", F.lit(1.0))
    sums = own.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)], *[F.sum(F.col(a) * F.col("value")).alias(f"t{i}") for i, a in enumerate(names)]).first()
    m = np.array([[sums[f"s{i}_{j}"] for j in range(len(names))] for i in range(len(names))])
    beta = np.linalg.lstsq(m, np.array([sums[f"t{i}"] for i in range(len(names))]), rcond=None)[0]
    trend = F.lit(float(beta[0]))
    for c, b in zip(covariates, beta[1:]):
        trend = trend + F.col(c) * float(b)
    rest = kriging(cells, own.withColumn("value", F.col("value") - trend), model, k=k).select("cell_id", F.col("value").alias("residual"))
    return cells.withColumn("trend", trend).select("cell_id", "trend").join(rest, "cell_id").withColumn("value", F.col("trend") + F.coalesce("residual", F.lit(0.0)))


def interpolate(cells: DataFrame, control: DataFrame, method: str, *, model: Model | None = None, **options) -> DataFrame:
    """A surface by the method's name."""
    from . import neighbours

    if method in ("ordinary_kriging", "universal_kriging"):
        require(model is not None, f"{method} needs a variogram model; fit one first")
        return kriging(cells, control, model, **({"order": 1} if method == "universal_kriging" else {}) | options)
    table = {"idw": neighbours.idw, "nearest": neighbours.nearest, "spline": spline}
    require(method in table, f"method {method!r} is not one of ordinary_kriging, universal_kriging, minimum_curvature, {', '.join(table)}")
    return table[method](cells, control, **options)
