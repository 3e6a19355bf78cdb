"""Control made fit for estimates: rows that can't be used go, places that are one become one, and what has no shape is refused.

Every change is counted in a flag (name, number, tolerance)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..scratch import cut
from .graph import components

#: Points that an estimate needs, points of which pairs are measured for a tolerance, and the share of their near distance that it is.
SAMPLES_MIN, PAIR_SAMPLE, DEDUP_SHARE = 30, 2_000, 0.5
#: Smaller to larger spread below which points are on one line.
LINE = 1e-10
POLICIES = ("mean", "first", "error")


class Flag(NamedTuple):
    name: str
    number: int
    tolerance: float | None = None


def usable(points: DataFrame, value: str = "v", covariates: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose place, value and those covariates that are used are finite numbers."""
    ok = F.lit(True)
    for c in ("x", "y", value, *covariates):
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return points.where(ok)


def default_dedup_tolerance(points: DataFrame) -> float:
    """Half the first percentile of the distances between different places, over at most PAIR_SAMPLE points taken evenly by a hash
    of their place; 0 where all are one. The percentile, as the least distance is often a repeated point's own."""
    n = points.count()
    some = points if n <= PAIR_SAMPLE else points.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)) < int(PAIR_SAMPLE / n * (1 << 40)))
    xy = some.select("x", "y").toPandas().to_numpy(float)
    if len(xy) < 2:
        return 0.0
    i, j = np.triu_indices(len(xy), 1)
    d = np.hypot(*(xy[i] - xy[j]).T)
    return float(np.percentile(d[d > 0], 1.0) * DEDUP_SHARE) if (d > 0).any() else 0.0


def clusters(points: DataFrame, tolerance: float) -> DataFrame:
    """points with cluster: those that a chain of steps of at most the tolerance joins have the same one, the smallest number
    among their places.

    Places that are equal are one row first, so a place with a third of all points is one. Places of a cell whose diagonal is the
    tolerance are near each other whatever they are, so each is linked to the cell's first; only neighbouring cells are compared."""
    size = tolerance / np.sqrt(2.0) * (1 - 1e-12)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("bigint")
    places = cut(points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct().withColumns({"cx": cell("x"), "cy": cell("y"), "place": F.monotonically_increasing_id()}))
    first = places.groupBy("cx", "cy").agg(F.min("place").alias("a"))
    inner = places.join(first, ["cx", "cy"]).select("a", F.col("place").alias("b")).where("a <> b")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]))
    moved = places.select("place", "x", "y", "cx", "cy", steps.alias("s")).select(F.col("place").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")) <= tolerance * tolerance
    outer = moved.join(places, ["cx", "cy"]).where(near).select("a", F.col("place").alias("b"))
    named = places.join(components(inner.unionAll(outer)), F.col("place") == F.col("node"), "left").select(F.col("x").alias("px"), F.col("y").alias("py"), F.coalesce("component", "place").alias("cluster"))
    return points.join(named, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py"))).drop("px", "py")


def on_a_line(points: DataFrame) -> bool:
    """Whether all points lie on one line or in one place, by the spread along and across their main direction: two sums each over
    all rows, from places near the middle."""
    m = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    if m["x"] is None:
        return True
    dx, dy = F.col("x") - F.lit(m["x"]), F.col("y") - F.lit(m["y"])
    far = points.agg(F.max_by(F.struct(dx.alias("x"), dy.alias("y")), dx * dx + dy * dy).alias("p")).first()["p"]
    length = float(np.hypot(far["x"], far["y"]))
    if length == 0:
        return True
    # the greatest distance from the line through the middle and the farthest point, against that point's own
    off = points.agg(F.max(F.abs(dx * F.lit(far["y"] / length) - dy * F.lit(far["x"] / length))).alias("o")).first()["o"]
    return off / length < max(LINE, 4e-16 * max(abs(m["x"]), abs(m["y"])) / length)


def validate(points: DataFrame, *, value: str = "v", covariates: tuple[str, ...] = (), tolerance: float | None = None, duplicates: str = "mean", id_column: str = "id", least: int = SAMPLES_MIN) -> tuple[DataFrame, list[Flag]]:
    """(points, flags): the control without unusable rows, one row for each cluster of places within the tolerance: the mean of
    place, value and covariates, the row of smallest id, or with error a refusal. Fewer than `least` points, points on one line and a
    value that is the same everywhere are refused. Columns other than id, x, y, value and covariates go where rows are averaged."""
    require(duplicates in POLICIES, f"policy {duplicates!r} is not one of {', '.join(POLICIES)}")
    total = points.count()
    kept = cut(usable(points, value, covariates))
    n = kept.count()
    flags = [Flag("ROWS_DROPPED", total - n)] if n < total else []
    tolerance = default_dedup_tolerance(kept) if tolerance is None else tolerance
    if tolerance > 0 and n > 1:
        grouped = cut(clusters(kept, tolerance))
        left = grouped.select("cluster").distinct().count()
        if left < n:
            require(duplicates != "error", f"{n - left} samples lie within {tolerance} of another; resolve them, or choose mean or first")
            if duplicates == "first":
                kept = cut(grouped.groupBy("cluster").agg(F.min_by(F.struct(*kept.columns), id_column).alias("s")).select("s.*"))
            else:
                means = [F.avg(c).alias(c) for c in dict.fromkeys(("x", "y", value, *covariates))]
                kept = cut(grouped.groupBy("cluster").agg(F.min(id_column).alias(id_column), *means, F.count("*").alias("n")).drop("cluster"))
            flags.append(Flag("DUPLICATES_RESOLVED", n - left, tolerance))
            n = left
    require(n >= least, f"{n} usable samples are fewer than {least}; add control")
    require(not on_a_line(kept), "all samples lie on one line, which spans no surface; add control off it")
    r = kept.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    require(r["a"] < r["b"], f"the value is {r['a']} at every sample; there is nothing to estimate")
    return kept, flags
