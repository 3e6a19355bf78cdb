"""Experimental variograms, their models, and fits."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..scratch import cut

#: Points of a pair sample where one is asked for, lags, least points, least pairs of a lag, and the practical-range factor.
SAMPLE, LAGS, POINTS_MIN, PAIRS_MIN, PRACTICAL = 20_000, 20, 10, 30, 3.0
#: Points of a block, at least and at most; blocks that are aimed at between; pairs of points that are arrays at once.
BLOCK, BLOCK_MAX, BLOCKS, CHUNK = 1024, 16_384, 64, 1 << 17
MODELS = ("spherical", "exponential", "gaussian", "power", "matern", "stable")


def sample(points: DataFrame, most: int = SAMPLE, seed: int = 1) -> DataFrame:
    """About `most` points by a seeded hash of their id; all where there are no more."""
    n = points.count()
    return points if n <= most else points.where(F.xxhash64(F.lit(seed), "id") / 2.0**64 + 0.5 < most / n)


def experimental(points: DataFrame, *, lags: int = LAGS, max_lag: float | None = None, azimuth: float | None = None, tolerance: float = 22.5, pairs_min: int = PAIRS_MIN, weight: str | None = None, most: int | None = None) -> DataFrame:
    """(lag_bin, lag, gamma, n_pairs) over all pairs of points (id, x, y, v) by equal bins from 0 to max_lag, half the greatest
    distance of the bounds' corners by default. azimuth: degrees from north, modulo 180. most: a bounded sample instead of all points.

    Points are dealt to tiles, and those of a full tile to blocks. Blocks that lie near enough meet in pairs, each pair as arrays in
    one group, which sends on the sums of its bins alone: no pair of points is ever a row, and no task holds more than two blocks."""
    p = sample(points, most) if most else points
    w = F.col(weight) if weight else F.lit(1.0)
    rows = p.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")], w.cast("double").alias("w")).where("x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    require(n >= POINTS_MIN, f"a variogram needs {POINTS_MIN} points, not {n}; add control")
    top = float(max_lag or math.hypot(x1 - x0, y1 - y0) / 2)
    require(top > 0, "all points lie at one place; a variogram needs distances")
    size = min(max(n // BLOCKS, BLOCK), BLOCK_MAX)
    side = max(x1 - x0, y1 - y0, 1e-9) / max(1.0, math.sqrt(n / size))
    at = lambda c, lo: F.floor((F.col(c) - lo) / side).cast("int")
    tiled = rows.withColumns({"cx": at("x", x0), "cy": at("y", y0)})
    full = tiled.groupBy("cx", "cy").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = tiled.join(full, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id", "x", "y"), "parts"))
    blocks = full.select("cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    a, b = (blocks.select(*[F.col(c).alias(f"{side_}_{c}") for c in ("cx", "cy", "part")]) for side_ in "ab")
    apart = [F.greatest(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) - 1, F.lit(0)) * side for c in ("cx", "cy")]
    key = lambda s: F.struct(*[f"{s}_{c}" for c in ("cx", "cy", "part")])
    # a point on the border of two tiles may fall on either side of it by rounding
    near = (key("a") <= key("b")) & (apart[0] * apart[0] + apart[1] * apart[1] < (top + 1e-6 * side) ** 2)
    pairs = cut(a.join(b, near).withColumn("pair", F.monotonically_increasing_id()))
    ends = [pairs.select("pair", F.lit(k).alias("end"), *[F.col(f"{s}_{c}").alias(c) for c in ("cx", "cy", "part")]) for k, s in enumerate("ab")]
    met = dealt.join(ends[0].unionAll(ends[1].join(pairs.where(key("a") != key("b")).select("pair"), "pair", "left_semi")), ["cx", "cy", "part"])

    def run(table: pa.Table) -> pa.Table:
        end = table["end"].to_numpy()
        x, y, v, w = ([c[end == k] for k in (0, 1)] for c in (table[name].to_numpy() for name in ("x", "y", "v", "w")))
        same = not len(x[1])
        if same:
            x, y, v, w = ([c[0], c[0]] for c in (x, y, v, w))
        sums = _block_sums(x, y, v, w, same, top, lags, azimuth, tolerance, weight is not None)
        return pa.table([pa.array(np.arange(lags + 1), pa.int32()), *map(pa.array, sums)], names=["lag_bin", "n", "w", "wh", "wd"])

    met = met.select("pair", "end", "x", "y", "v", "w").repartition(4 * points.sparkSession.sparkContext.defaultParallelism, "pair")
    met = met.groupBy("pair").applyInArrow(run, "lag_bin int, n double, w double, wh double, wd double")
    total = F.sum("w")
    bins = met.groupBy("lag_bin").agg((F.sum("wh") / total).alias("lag"), (F.sum("wd") / (2 * total)).alias("gamma"), F.sum("n").cast("long").alias("n_pairs"))
    return bins.where((F.col("n_pairs") >= pairs_min) & (F.col("n_pairs") > 0))


def _block_sums(x, y, v, w, same: bool, top: float, lags: int, azimuth: float | None, tolerance: float, weighed: bool) -> np.ndarray:
    """[pairs, weights, weights x distance, weights x squared difference] by bin over the pairs of two blocks."""
    out = np.zeros((4, lags + 1))
    if not len(x[0]) or math.hypot(*(max(a.min() - b.max(), b.min() - a.max(), 0.0) for a, b in (x, y))) >= top:
        return out
    wide = len(x[1])
    step = max(1, CHUNK // wide)
    for lo in range(0, len(x[0]), step):
        i = slice(lo, lo + step)
        dx, dy = (np.subtract.outer(a[i], b) for a, b in (x, y))
        h = np.sqrt(dx * dx + dy * dy)
        keep = h < top
        if same:
            keep &= np.arange(wide) < np.arange(lo, lo + len(h))[:, None]
        if azimuth is not None:
            keep &= _along(dx, dy, h, azimuth, tolerance)
        h, d = h[keep], np.subtract.outer(v[0][i], v[1])[keep]
        ww = np.multiply.outer(w[0][i], w[1])[keep] if weighed else None
        at = (h / (top / lags)).astype(np.int64)
        pairs = np.bincount(at, minlength=lags + 1)
        d *= d
        out[0] += pairs
        out[1] += np.bincount(at, ww, lags + 1) if weighed else pairs
        out[2] += np.bincount(at, ww * h if weighed else h, lags + 1)
        out[3] += np.bincount(at, ww * d if weighed else d, lags + 1)
    return out


def _along(dx: np.ndarray, dy: np.ndarray, h: np.ndarray, azimuth: float, tolerance: float) -> np.ndarray:
    """Whether pairs point along the azimuth within the tolerance; angles are taken of those alone that a cosine leaves open."""
    a = math.radians(azimuth)
    over = np.abs(dx * math.sin(a) + dy * math.cos(a)) - math.cos(math.radians(min(tolerance, 90.0))) * h
    keep = over > 0
    i, j = np.nonzero(np.abs(over) <= 1e-9 * h)
    turn = np.mod(np.degrees(np.arctan2(dx[i, j], dy[i, j])) - azimuth, 180.0)
    keep[i, j] = np.minimum(turn, 180.0 - turn) <= tolerance
    return keep


@dataclass(frozen=True)
class Model:
    """A fitted variogram: gamma(0) = 0, so the nugget is a jump. Ratio and azimuth are of the minor to the major range."""

    kind: str
    nugget: float
    sill: float
    range: float
    shape: float = 1.0
    ratio: float = 1.0
    azimuth: float = 0.0
    residual: float = 0.0

    def __post_init__(self) -> None:
        require(self.kind in MODELS, f"model {self.kind!r} is not one of {', '.join(MODELS)}")
        require(self.kind != "matern" or self.shape in (0.5, 1.5, 2.5), "a Matern model takes the shapes 0.5, 1.5 and 2.5 only")

    def correlation(self, h: np.ndarray) -> np.ndarray:
        r = np.asarray(h, float) / self.range
        if self.kind == "spherical":
            return np.where(r < 1, 1 - 1.5 * r + 0.5 * r**3, 0.0)
        if self.kind == "exponential":
            return np.exp(-PRACTICAL * r)
        if self.kind == "gaussian":
            return np.exp(-PRACTICAL * r * r)
        if self.kind == "stable":
            return np.exp(-PRACTICAL * r**self.shape)
        if self.kind == "matern":
            s = math.sqrt(2 * self.shape) * r * 2
            return {0.5: np.exp(-s), 1.5: (1 + s) * np.exp(-s), 2.5: (1 + s + s * s / 3) * np.exp(-s)}[self.shape]
        return 1 - r ** min(self.shape, 1.99)

    def gamma(self, h) -> np.ndarray:
        h = np.asarray(h, float)
        return np.where(h <= 0, 0.0, self.nugget + (self.sill - self.nugget) * (1 - self.correlation(h)))

    def covariance(self, h) -> np.ndarray:
        return self.sill - self.gamma(h)

    def gamma_column(self, h: Column) -> Column:
        r = h / self.range
        c = {
            "spherical": lambda: F.when(r < 1, 1 - 1.5 * r + 0.5 * r * r * r).otherwise(0.0), "exponential": lambda: F.exp(-PRACTICAL * r),
            "gaussian": lambda: F.exp(-PRACTICAL * r * r), "stable": lambda: F.exp(-PRACTICAL * F.pow(r, F.lit(self.shape))),
            "power": lambda: 1 - F.pow(r, F.lit(min(self.shape, 1.99))),
            "matern": lambda: (lambda s: {0.5: F.exp(-s), 1.5: (1 + s) * F.exp(-s), 2.5: (1 + s + s * s / 3) * F.exp(-s)}[self.shape])(math.sqrt(2 * self.shape) * 2 * r),
        }[self.kind]()
        return F.when(h <= 0, 0.0).otherwise(self.nugget + (self.sill - self.nugget) * (1 - c))

    def stretched(self, xy: np.ndarray) -> np.ndarray:
        """Coordinates in which the model is isotropic: along the major axis as they are, across it divided by the ratio."""
        a = math.radians(self.azimuth)
        along, across = xy @ np.array([math.sin(a), math.cos(a)]), xy @ np.array([math.cos(a), -math.sin(a)])
        return np.stack([along, across / self.ratio], axis=-1)


def fit_lags(lag: np.ndarray, gamma: np.ndarray, weight: np.ndarray, kind: str, shape: float = 1.0) -> Model:
    """The best of a 16 x 13 grid of ranges and nugget shares, the sill in closed form; residuals weigh by pairs / lag^2."""
    w = weight / np.maximum(lag, 1e-12) ** 2
    w = w / w.sum()
    best = None
    for r in np.geomspace(lag.max() / 10, lag.max() * 1.5, 16):
        for share in np.linspace(0, 0.9, 13):
            unit = Model(kind, share, 1.0, float(r), shape).gamma(lag)
            sill = float((w * unit * gamma).sum() / max((w * unit * unit).sum(), 1e-300))
            res = float((w * (gamma - sill * unit) ** 2).sum())
            if sill > 0 and (best is None or res < best.residual):
                best = Model(kind, float(share * sill), sill, float(r), shape, residual=res)
    require(best is not None, "no model fits these lags; they don't rise from zero")
    return best


def fit(lags: DataFrame, kind: str | None = None) -> Model:
    """A model of the kind, or the kind of least residual, to the few rows of an experimental variogram."""
    rows = lags.orderBy("lag_bin").toPandas()
    require(len(rows) >= 3, f"{len(rows)} lags hold enough pairs; 3 are needed")
    x = [rows[c].to_numpy(float) for c in ("lag", "gamma", "n_pairs")]
    return min((fit_lags(*x, k) for k in ([kind] if kind else ("spherical", "exponential", "gaussian"))), key=lambda m: m.residual)


def fit_auto(points: DataFrame, kind: str | None = None, anisotropy: bool = False, **options) -> Model:
    model = fit(experimental(points, **options), kind)
    return detect_anisotropy(points, model, **options) if anisotropy else model


def detect_anisotropy(points: DataFrame, model: Model, directions: int = 8, **options) -> Model:
    """The model with the ratio and azimuth that cos and sin of twice the azimuth explain in the directional ranges."""
    found = []
    for i in range(directions):
        a = 180.0 * i / directions
        rows = experimental(points, azimuth=a, **options).toPandas()
        if len(rows) >= 3:
            found.append((a, fit_lags(rows["lag"].to_numpy(float), rows["gamma"].to_numpy(float), rows["n_pairs"].to_numpy(float), model.kind).range))
    if len(found) < 4:
        return model
    a, r = np.radians([f[0] for f in found]), np.log([f[1] for f in found])
    m, c, s = np.linalg.lstsq(np.stack([np.ones_like(a), np.cos(2 * a), np.sin(2 * a)], axis=1), r, rcond=None)[0]
    swing = math.hypot(c, s)
    return replace(model, range=float(math.exp(m + swing)), ratio=float(max(0.1, math.exp(-2 * swing))), azimuth=math.degrees(math.atan2(s, c)) / 2 % 180)


#: Points, sectors of half a turn and shuffles of an anisotropy test; the p-value and the ratio from which it is used, and the pairs that a
#: direction needs.
TEST_SAMPLE, SECTORS, SHUFFLES, SIGNIFICANT, MEANINGFUL, DIRECTION_PAIRS = 4_000, 8, 99, 0.05, 1.3, 200


@dataclass(frozen=True)
class Anisotropy:
    """ratio of the longest to the shortest directional range, azimuth of the longest, and the share of shuffles (and the data)
    whose directions differ at least as much; ranges by azimuth."""

    ratio: float
    azimuth: float
    p_value: float
    ranges: dict[float, float]

    @property
    def significant(self) -> bool:
        return self.p_value < SIGNIFICANT

    @property
    def use(self) -> bool:
        """Whether an estimate should take the ellipse: directions of any data differ, so it must be more than chance and worth it."""
        return self.significant and self.ratio >= MEANINGFUL


def directional_sums(points: DataFrame, *, lags: int = LAGS, max_lag: float | None = None, shuffles: int = SHUFFLES, seed: int = 1, most: int = TEST_SAMPLE) -> DataFrame:
    """(shuffle, sector, lag_bin, n, h, d2): pairs, distances and squared differences by sector of direction and lag, of the values as
    they are (shuffle 0) and of seeded shuffles of them over the same places.

    The points are a bounded sample of `most`. Their blocks meet in pairs as in experimental(); each pair of blocks is measured once
    and its places serve all shuffles, so the pass over the pairs is one."""
    p = sample(points, most, seed).where("x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")
    rows = p.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]).toArrow()
    x, y, v = (rows[c].to_numpy() for c in ("x", "y", "v"))
    require(len(x) >= POINTS_MIN, f"a variogram needs {POINTS_MIN} points, not {len(x)}; add control")
    top = float(max_lag or math.hypot(np.ptp(x), np.ptp(y)) / 2)
    require(top > 0, "all points lie at one place; a variogram needs distances")
    order = np.lexsort((v, y, x))
    x, y, v = x[order], y[order], v[order]
    r = np.random.default_rng(seed)
    values = np.stack([v, *(r.permutation(v) for _ in range(shuffles))])
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((x, y, values))
    block = BLOCK // 4
    blocks = -(-len(x) // block)
    cells = SECTORS * lags

    def run(batches):
        x, y, values = shared.value
        for batch in batches:
            n, far, d2 = np.zeros(cells), np.zeros(cells), np.zeros((len(values), cells))
            for pair in batch.column(0).to_numpy().tolist():
                a = (math.isqrt(8 * pair + 1) - 1) // 2
                b = pair - a * (a + 1) // 2
                i, j = (np.arange(k * block, min(len(x), (k + 1) * block)) for k in (a, b))
                dx, dy = np.subtract.outer(x[i], x[j]), np.subtract.outer(y[i], y[j])
                h = np.hypot(dx, dy)
                keep = (h < top) & (h > 0)
                if a == b:
                    keep &= np.tri(*h.shape, -1, dtype=bool)
                p, q = np.nonzero(keep)
                sector = np.floor(np.mod(np.degrees(np.arctan2(dx[keep], dy[keep])), 180.0) / (180.0 / SECTORS)).astype(int) % SECTORS
                at = sector * lags + np.floor(h[keep] / (top / lags)).astype(int)
                n += np.bincount(at, minlength=cells)
                far += np.bincount(at, h[keep], cells)
                for k, row in enumerate(values):
                    d = row[i][p] - row[j][q]
                    d2[k] += np.bincount(at, d * d, cells)
            where = np.tile(np.arange(cells), len(values))
            columns = [np.repeat(np.arange(len(values)), cells).astype(np.int32), (where // lags).astype(np.int32), (where % lags).astype(np.int32), np.tile(n, len(values)), np.tile(far, len(values)), d2.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shuffle", "sector", "lag_bin", "n", "h", "d2"])

    pairs = blocks * (blocks + 1) // 2
    met = spark.range(0, pairs, 1, min(pairs, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "shuffle int, sector int, lag_bin int, n double, h double, d2 double")
    return met.groupBy("shuffle", "sector", "lag_bin").agg(*[F.sum(c).alias(c) for c in ("n", "h", "d2")])


def _contrast(n: np.ndarray, d2: np.ndarray) -> float:
    """How much directions differ: the swing over half a turn of log gamma against that of all directions at the same lag, the
    nearer half of the lags weighed by their pairs. n, d2: [sectors, lags]."""
    near = slice(0, n.shape[1] // 2)
    n, d2 = n[:, near], d2[:, near]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.log((d2 / n) / (d2.sum(axis=0) / n.sum(axis=0)))
    w = np.where(np.isfinite(c), n, 0.0)
    per = (w * np.where(np.isfinite(c), c, 0.0)).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)
    turn = np.exp(2j * np.pi * np.arange(len(per)) / len(per))
    return float(abs((per * turn).sum()) * 2 / len(per))


def range_of(model: Model, lag: np.ndarray, gamma: np.ndarray, weight: np.ndarray) -> float:
    """The range with which a model, its nugget and sill kept, fits lags of one direction best."""
    w = weight / np.maximum(lag, 1e-12) ** 2
    tried = np.geomspace(lag.max() / 50, lag.max() * 50, 400)
    return float(min(tried, key=lambda r: (w * (gamma - replace(model, range=float(r)).gamma(lag)) ** 2).sum()))


def anisotropy_test(points: DataFrame, kind: str = "spherical", **options) -> Anisotropy:
    """Directional ranges, those of one model with the nugget and sill of all pairs, and whether directions differ by more than
    those of shuffled values over the same places do."""
    t = directional_sums(points, **options).orderBy("shuffle", "sector", "lag_bin").toPandas()
    shape = (t["shuffle"].max() + 1, SECTORS, t["lag_bin"].max() + 1)
    n, h, d2 = (t[c].to_numpy().reshape(shape) for c in ("n", "h", "d2"))
    every = n[0].sum(axis=0) >= PAIRS_MIN
    if every.sum() < 3:
        return Anisotropy(1.0, 0.0, 1.0, {})
    whole = [x[0].sum(axis=0)[every] for x in (n, h, d2)]
    model = fit_lags(whole[1] / whole[0], whole[2] / (2 * whole[0]), whole[0], kind)
    ranges: dict[float, float] = {}
    for k in range(SECTORS):
        # a direction's window is the sector on either side of it
        pairs, far, sums = (x[0, k] + x[0, k - 1] for x in (n, h, d2))
        enough = pairs >= PAIRS_MIN
        if pairs.sum() >= DIRECTION_PAIRS and enough.sum() >= 3:
            ranges[180.0 / SECTORS * k] = range_of(model, far[enough] / pairs[enough], sums[enough] / (2 * pairs[enough]), pairs[enough])
    if len(ranges) < 2:
        return Anisotropy(1.0, 0.0, 1.0, ranges)
    seen = [_contrast(n[k], d2[k]) for k in range(shape[0])]
    # the data are one of the arrangements, so the value never is 0
    p = (1 + sum(c >= seen[0] for c in seen[1:])) / len(seen)
    azimuth = max(ranges, key=ranges.get)
    return Anisotropy(ranges[azimuth] / min(ranges.values()), azimuth, p, ranges)
