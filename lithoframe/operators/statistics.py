"""Point statistics: declustering, duplicates, transforms, screens, percentiles, class breaks."""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require

#: Values of a Jenks sample, and of candidate cell sizes.
JENKS_SAMPLE, SIZES = 5000, 24


def decluster_weights(points: DataFrame, size: float) -> DataFrame:
    """points with weight: 1 / (points of its cell), scaled to add up to the number of points. Counts are aggregated by cell
    before they are joined back, so a crowded cell is no single task's."""
    key = {"__kx": F.floor(F.col("x") / size).cast("long"), "__ky": F.floor(F.col("y") / size).cast("long")}
    counts = points.select(*[c.alias(n) for n, c in key.items()]).groupBy("__kx", "__ky").agg(F.count("*").alias("__c"))
    total = F.broadcast(counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__cells")))
    return points.withColumns(key).join(counts, ["__kx", "__ky"]).join(total).withColumn("weight", F.col("__n") / (F.col("__c") * F.col("__cells"))).drop("__kx", "__ky", "__c", "__n", "__cells")


def declustered_mean(points: DataFrame, value: str, sizes: list[float], offsets: int = 4) -> DataFrame:
    """(size, mean) of declustered means over candidate sizes, weights averaged over shifted origins; one pass, the points
    repeated for each size and origin."""
    tried = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("size"), F.lit(o).alias("o")) for s in sizes for o in range(offsets)]))
    shift = F.col("size") * F.col("o") / offsets
    grid = points.select(F.col(value).alias("v"), "x", "y", tried.alias("t")).select("v", "x", "y", "t.*")
    cell = [F.floor((F.col("x") + shift) / F.col("size")).alias("kx"), F.floor((F.col("y") + shift) / F.col("size")).alias("ky")]
    cells = grid.groupBy("size", "o", *cell).agg(F.avg("v").alias("m"))
    return cells.groupBy("size", "o").agg(F.avg("m").alias("m")).groupBy("size").agg(F.avg("m").alias("mean"))


def candidate_sizes(lo: float, hi: float, n: int = SIZES) -> list[float]:
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """One row: interpolated at the middle of each value's weight in the cumulative weights. Equal values are one."""
    one = df.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    up = W.orderBy("v")
    total = F.sum("w").over(W.partitionBy(F.lit(1)))
    at = one.withColumn("p", (F.sum("w").over(up.rowsBetween(W.unboundedPreceding, 0)) - F.col("w") / 2) / total)
    pair = at.select("v", "p", F.lead("v").over(up).alias("v1"), F.lead("p").over(up).alias("p1"))
    between = F.max(F.when((F.col("p") <= q) & (F.col("p1") > q), F.col("v") + (q - F.col("p")) / (F.col("p1") - F.col("p")) * (F.col("v1") - F.col("v"))))
    return pair.agg(F.coalesce(between, F.when(F.min("p") > q, F.min("v")).otherwise(F.max("v"))).alias("value"))


def coincident(points: DataFrame) -> DataFrame:
    """One row: points less distinct places."""
    return points.groupBy("x", "y").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("coincident"))


def dedupe(points: DataFrame, tolerance: float, policy: str = "mean", *, value: str = "v", id_column: str = "id") -> DataFrame:
    """Points of one rounded tolerance cell as one: mean (of place and value), first (smallest id), or error."""
    require(policy in ("mean", "first", "error"), f"policy {policy!r} is not one of mean, first, error")
    keyed = points.withColumns({"kx": F.rint(F.col("x") / tolerance).cast("long"), "ky": F.rint(F.col("y") / tolerance).cast("long")})
    if policy == "mean":
        return keyed.groupBy("kx", "ky").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(value).alias(value), F.count("*").alias("n"))
    if policy == "first":
        return keyed.groupBy("kx", "ky").agg(F.min_by(F.struct("x", "y", value), id_column).alias("s"), F.min(id_column).alias(id_column), F.count("*").alias("n")).select("kx", "ky", "s.*", id_column, "n")
    twice = keyed.groupBy("kx", "ky").count().where("count > 1").limit(1).count()
    require(not twice, f"points lie within {tolerance} of each other; choose mean or first, or a smaller tolerance")
    return points


def log_transform(v: Column, offset: float = 0.0) -> Column:
    return F.log(v + offset)


def boxcox_transform(v: Column, lam: float, offset: float = 0.0) -> Column:
    return F.log(v + offset) if lam == 0 else (F.pow(v + offset, F.lit(float(lam))) - 1) / lam


def probit(p: Column) -> Column:
    """The standard normal quantile, by a rational approximation within 5e-4, for 0 < p < 1."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    # fixed values of the approximation
    num = 2.515517 + t * (0.802853 + t * 0.010328)
    den = 1 + t * (1.432788 + t * (0.189269 + t * 0.001308))
    z = t - num / den
    return F.when(p < 0.5, -z).otherwise(z)


def nscore(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, score): normal scores of distinct values, from the middle of their cumulative weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    one = df.groupBy(F.col(value).alias("value")).agg(F.sum(w).alias("w"))
    before = F.coalesce(F.sum("w").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    p = (before + F.col("w") / 2) / F.sum("w").over(W.partitionBy(F.lit(1)))
    return one.withColumn("p", p).select("value", probit(F.col("p")).alias("score"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: corr_<a>_<b> of every two columns, in one pass."""
    return df.agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]])


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factors, from the inverse of the correlation matrix of a single pass."""
    import numpy as np

    row = correlations(df, columns).first().asDict()
    m = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i + 1 :], i + 1):
            m[i, j] = m[j, i] = row[f"corr_{a}_{b}"]
    return dict(zip(columns, np.diag(np.linalg.pinv(m)).tolist(), strict=True))


def condition_number(df: DataFrame, columns: list[str]) -> float:
    import numpy as np

    row = correlations(df, columns).first().asDict()
    m = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i + 1 :], i + 1):
            m[i, j] = m[j, i] = row[f"corr_{a}_{b}"]
    e = np.linalg.eigvalsh(m)
    return float(math.sqrt(e[-1] / e[0])) if e[0] > 0 else float("inf")


def outside_range(scenario: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each covariate, the share of scenario nodes outside the samples' range."""
    ranges = F.broadcast(samples.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]))
    out = lambda c: F.avg(F.when((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}")), 1.0).otherwise(0.0)).alias(f"outside_{c}")
    return scenario.join(ranges).agg(*[out(c) for c in columns])


def display_range(df: DataFrame, value: str) -> DataFrame:
    """One row (lo, hi): exact 5th and 95th percentiles of finite values; their range where these are equal; null where flat."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    a = df.agg(F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.min(v).alias("a"), F.max(v).alias("b"))
    flat, even = F.col("a") == F.col("b"), F.col("p")[0] == F.col("p")[1]
    pick = lambda i, c: F.when(flat, None).when(even, F.col(c)).otherwise(F.col("p")[i])
    return a.select(pick(0, "a").alias("lo"), pick(1, "b").alias("hi"))


def equal_interval(df: DataFrame, value: str, n: int) -> list[float]:
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    return _rising([r["a"] + (r["b"] - r["a"]) * i / n for i in range(1, n)], n)


def quantile_breaks(df: DataFrame, value: str, n: int) -> list[float]:
    r = df.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("q")).first()
    return _rising(list(r["q"] or []), n)


def stddev_breaks(df: DataFrame, value: str, n: int) -> list[float]:
    r = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    return _rising([r["m"] + (j - n / 2) * r["s"] for j in range(1, n)], n)


def multiples(lo: float, hi: float, m: float, e: int, most: int) -> list[float]:
    """The first multiples of m * 10^e strictly between lo and hi, most at the most, each worked out once from its whole number."""
    step = Decimal(str(m)).scaleb(e)
    k, out = int((Decimal(lo) / step).to_integral_value(ROUND_FLOOR)) + 1, []
    while len(out) < most and (v := float(k * step)) < hi:
        if v > lo and (not out or v > out[-1]):
            out.append(v)
        k += 1
    return out


def pretty_breaks(lo: float, hi: float, n: int) -> list[float]:
    """n - 1 multiples of a round step strictly inside the range, of the steps that give so many the largest. Where none gives just
    so many, those of the largest step that gives more, thinned evenly."""
    from .grids import NICE

    require(n >= 2 and hi > lo, f"{n} classes of the range {lo} to {hi} have no breaks; choose 2 classes or more of a wider range")
    top = math.ceil(math.log10(hi - lo)) + 1
    steps = [(m, e) for e in range(top, top - 8 - math.ceil(math.log10(n)), -1) for m in reversed(NICE[:-1])]
    sets = [multiples(lo, hi, m, e, 8 * n) for m, e in steps]
    more = next((b for b in sets if len(b) >= n - 1), None)
    require(more is not None, f"the range {lo} to {hi} is too narrow for {n} classes")
    return next((b for b in sets if len(b) == n - 1), [more[round(i * (len(more) - 1) / max(1, n - 2))] for i in range(n - 1)])


def jenks_breaks(df: DataFrame, value: str, n: int, sample: int = JENKS_SAMPLE) -> list[float]:
    """Exact Fisher-Jenks breaks of the values, or of a systematic sample of them by rank; each is the first value of its upper
    class. The dynamic programme over at most `sample` values runs on the driver."""
    import numpy as np

    total = df.where(F.col(value).isNotNull()).count()
    require(total > 0, "there are no values to classify")
    every = max(1, -(-total // sample))
    ranked = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    if every > 1:
        q = [i * every / max(1, total - 1) for i in range(-(-total // every))]
        v = np.array(ranked.agg(F.percentile("v", F.array(*[F.lit(min(1.0, x)) for x in q])).alias("q")).first()["q"])
    else:
        v = np.sort(ranked.toPandas()["v"].to_numpy())
    return _rising([float(v[i]) for i in jenks_cuts(v, n)], n)


def jenks_cuts(v, n: int) -> list[int]:
    """Indexes of the first value of the classes 2 to n that minimise the squared deviation from class means."""
    import numpy as np

    s1, s2 = np.concatenate(([0.0], np.cumsum(v))), np.concatenate(([0.0], np.cumsum(v * v)))
    size = len(v)
    require(len(np.unique(v)) >= n, f"{len(np.unique(v))} distinct values make no {n} classes; choose fewer")
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    best = np.array([cost(0, b) if b else 0.0 for b in range(size + 1)])
    froms = []
    for k in range(2, n + 1):
        new, at = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        for b in range(k, size + 1):
            a = np.arange(k - 1, b)
            c = best[a] + cost(a, b)
            i = int(np.argmin(c))
            new[b], at[b] = c[i], a[i]
        best = new
        froms.append(at)
    cuts, b = [], size
    for at in reversed(froms):
        b = int(at[b])
        cuts.append(b)
    return cuts[::-1]


def _rising(breaks: list[float], n: int) -> list[float]:
    require(len(breaks) == n - 1 and all(a < b for a, b in zip(breaks, breaks[1:])), f"the values make no {n} classes with rising breaks; choose fewer")
    return breaks


def classify(df: DataFrame, value: str, method: str, n: int) -> list[float]:
    """The n - 1 breaks of a method by name."""
    methods = {"equal_interval": equal_interval, "quantile": quantile_breaks, "standard_deviation": stddev_breaks, "natural_breaks": jenks_breaks}
    if method == "pretty":
        r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
        return pretty_breaks(r["a"], r["b"], n)
    require(method in methods, f"method {method!r} is not one of {', '.join([*methods, 'pretty'])}; manual breaks need no computing")
    return methods[method](df, value, n)


def class_of(v: Column, breaks: list[float]) -> Column:
    """The number of breaks that v reaches: a value on a break is in the upper class."""
    return F.aggregate(F.array(*[F.lit(float(b)) for b in breaks]), F.lit(0), lambda a, b: a + F.when(v >= b, 1).otherwise(0))
