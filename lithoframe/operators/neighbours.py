"""Nearest neighbours and what rests on them: spacing, search radius, inverse distance, nearest value, extrapolation.

A k-nearest join sends queries and points to grid cells and looks through rings of cells; a query whose k-th distance lies
within the rings it has seen is done, and only the rest goes on with wider rings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require
from ..scratch import cut

#: Neighbours of inverse distance, its power, and the multiple of the median spacing that reaches.
K_IDW, POWER, REACH = 16, 2.0, 3.0
#: Ring widths tried, in cells; whoever isn't done then meets all points that are left, in blocks.
RINGS = (1, 3, 9)


def _cell_of(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"__cx": F.floor(F.col("x") / size).cast("long"), "__cy": F.floor(F.col("y") / size).cast("long")})


def knn(queries: DataFrame, points: DataFrame, k: int, *, cell: float | None = None, max_radius: float | None = None, exclude_same_id: bool = False) -> DataFrame:
    """(query_id, id, d2, rank): each query's k points by distance, ties to the smaller id. queries (query_id, x, y); points
    (id, x, y). Beyond max_radius no point counts."""
    require(k >= 1, f"k must be 1 or more, not {k}")
    q = queries.select("query_id", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if cell is None:
        b = p.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
        if not b["n"]:
            return q.join(p, F.lit(False)).select("query_id", "id", F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
        area = max((b["b"] - b["a"]) * (b["d"] - b["c"]), 1e-12)
        cell = max(math.sqrt(area * max(k, 4) / b["n"]), 1e-9)
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    fits = F.lit(True)
    if max_radius is not None:
        fits = fits & (F.col("d2") <= float(max_radius) ** 2)
    if exclude_same_id:
        fits = fits & (F.col("id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "id"))
    celled, out, left = _cell_of(p, cell), None, q
    for ring in RINGS:
        span = F.sequence(F.lit(-ring), F.lit(ring))
        asked = left.withColumn("__cx", F.explode(F.transform(span, lambda o: F.floor(F.col("qx") / cell).cast("long") + o)))
        asked = asked.withColumn("__cy", F.explode(F.transform(span, lambda o: F.floor(F.col("qy") / cell).cast("long") + o)))
        got = cut(asked.join(celled, ["__cx", "__cy"]).withColumn("d2", d2).where(fits).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "d2", "rank"))
        reach = ring * cell  # every point nearer than this has been seen
        last = max_radius is not None and max_radius <= reach
        done = left.select("query_id") if last else got.where((F.col("rank") == k) & (F.col("d2") <= reach * reach)).select("query_id")
        found = got if last else got.join(done, "query_id", "left_semi")
        out = found if out is None else out.unionAll(found)
        if last:
            return out
        left = cut(left.join(done, "query_id", "left_anti"))
        if left.isEmpty():
            return out
    # what is left has few points near: it meets all of them in 64 blocks, and each block sends on k of them
    blocked = p.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(64)))
    asked = left.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    part = F.row_number().over(W.partitionBy("query_id", "__b").orderBy("d2", "id"))
    rest = asked.join(blocked, "__b").withColumn("d2", d2).where(fits).withColumn("__r", part).where(F.col("__r") <= k)
    return out.unionAll(rest.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "d2", "rank"))


def spacing(points: DataFrame) -> DataFrame:
    """(id, distance) to each point's nearest other point."""
    own = points.select(F.col("id").alias("query_id"), "x", "y")
    return knn(own, points, 1, exclude_same_id=True).select(F.col("query_id").alias("id"), F.sqrt("d2").alias("distance"))


def search_radius(points: DataFrame, multiple: float = REACH) -> DataFrame:
    """One row: multiple x the median spacing; infinite with fewer than two points."""
    return spacing(points).agg(F.coalesce(F.percentile("distance", F.lit(0.5)) * multiple, F.lit(float("inf"))).alias("radius"))


def idw(cells: DataFrame, control: DataFrame, *, power: float = POWER, k: int = K_IDW, max_radius: float | None = None) -> DataFrame:
    """(cell_id, value): inverse-distance means of the k nearest controls (id, x, y, value). A hit takes the value of that
    control, the one of smallest id; a cell without any in reach has no value."""
    near = knn(cells.select(F.col("cell_id").alias("query_id"), "x", "y"), control, k, max_radius=max_radius)
    valued = near.join(control.select("id", F.col("value").alias("z")), "id")
    w = F.pow(F.sqrt("d2"), F.lit(-float(power)))
    hit = F.min_by("z", F.when(F.col("d2") == 0, F.col("id")))
    mean = F.sum(F.when(F.col("d2") > 0, w * F.col("z"))) / F.sum(F.when(F.col("d2") > 0, w))
    some = valued.groupBy("query_id").agg(F.when(F.min("d2") == 0, hit).otherwise(mean).alias("value"))
    return cells.select("cell_id").join(some, F.col("cell_id") == F.col("query_id"), "left").select("cell_id", "value")


def nearest(cells: DataFrame, control: DataFrame) -> DataFrame:
    """(cell_id, value) of each cell's nearest control, ties to the smaller id."""
    near = knn(cells.select(F.col("cell_id").alias("query_id"), "x", "y"), control, 1)
    return near.join(control.select("id", "value"), "id").select(F.col("query_id").alias("cell_id"), "value")


def extrapolated_fraction(cells: DataFrame, control: DataFrame, radius: float, value: str | None = None) -> DataFrame:
    """One row: the share of cells whose nearest control lies beyond radius, or that have no value."""
    near = knn(cells.select(F.col("cell_id").alias("query_id"), "x", "y"), control, 1).select(F.col("query_id").alias("cell_id"), F.sqrt("d2").alias("d"))
    beyond = F.coalesce(F.col("d") > radius, F.lit(True))
    if value:
        beyond = beyond | F.col(value).isNull() | F.isnan(value)
    return cells.join(near, "cell_id", "left").agg(F.avg(F.when(beyond, 1.0).otherwise(0.0)).alias("fraction"))
