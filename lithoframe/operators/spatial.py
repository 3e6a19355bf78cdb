"""Spatial joins and overlay of boxes and points, as blocked equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.geometry import SIDES, box, box_relation
from ..layers import same_frame

#: The right side is broadcast whole up to this many rows; beyond it, both sides are cut into grid cells.
BROADCAST_ROWS = 10_000


def as_boxes(points: DataFrame) -> DataFrame:
    """Points (x, y) as boxes without extent."""
    return points.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})


def _cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that the box meets; rows without a box meet none."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    out = df.where(" AND ".join(f"{s} IS NOT NULL" for s in SIDES))
    out = out.withColumn("__cx", F.explode(F.sequence(at("xmin"), at("xmax"))))
    return out.withColumn("__cy", F.explode(F.sequence(at("ymin"), at("ymax"))))


def block_size(left: DataFrame, right: DataFrame) -> float:
    """The greater of the right boxes' median side and 1/256 of the extent, by one aggregate over each side."""
    r = right.agg(F.percentile_approx(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), 0.5).alias("m"), F.min("xmin").alias("a"), F.max("xmax").alias("b")).first()
    span = (r["b"] - r["a"]) if r["a"] is not None else 0.0
    return float(max(r["m"] or 0.0, span / 256, 1e-9))


def pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects", *, cell: float | None = None) -> DataFrame:
    """Inner theta-join of boxes: left columns as they are, right ones with the prefix r_ for their box. Each pair comes out
    once, in its reference cell: the cell of the larger of the two lower corners."""
    same_frame(left, right)
    r = right.withColumnsRenamed({s: f"r_{s}" for s in SIDES})
    clash = (set(left.columns) & set(r.columns)) - set(SIDES)
    require(not clash, f"both sides have columns {sorted(clash)}; rename those of one side")
    theta = box_relation(predicate, box(), box("r_"))
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS if cell is None else False
    if few:
        # a bounded broadcast: the loop over it stays in each task, and nothing is shuffled
        return left.join(F.broadcast(r), theta)
    cell = cell or block_size(left, right)
    a = _cells(left, cell)
    b = _cells(right, cell).withColumnsRenamed({s: f"r_{s}" for s in SIDES})
    low = lambda s, axis: F.col(axis) == F.floor(F.greatest(F.col(s), F.col(f"r_{s}")) / cell).cast("long")
    return a.join(b, ["__cx", "__cy"]).where(low("xmin", "__cx") & low("ymin", "__cy")).where(theta).drop("__cx", "__cy")


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", *, how: str = "inner", left_id: str = "id", transfer: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """A row for each match, with the right side's transferred columns; a name that the left has gets the prefix right_.
    how = left keeps left rows without a match."""
    require(how in ("inner", "left"), f"how must be inner or left, not {how!r}")
    names = transfer if transfer is not None else [c for c in right.columns if c not in SIDES]
    right = right.select(*[F.col(c).alias(f"right_{c}" if c in left.columns else c) for c in names], *SIDES)
    new = [c for c in right.columns if c not in SIDES]
    found = pairs(left, right, predicate, cell=cell).select(*left.columns, *new)
    if how == "inner":
        return found
    alone = left.join(found.select(left_id).distinct(), left_id, "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def intersect(left: DataFrame, right: DataFrame, *, cell: float | None = None) -> DataFrame:
    """One row for each pair of boxes whose interiors meet, with their common box and the columns of both."""
    clash = {c: f"right_{c}" for c in right.columns if c in left.columns and c not in SIDES}
    found = pairs(left, right.withColumnsRenamed(clash), "intersects", cell=cell)
    common = {"xmin": F.greatest("xmin", "r_xmin"), "ymin": F.greatest("ymin", "r_ymin"), "xmax": F.least("xmax", "r_xmax"), "ymax": F.least("ymax", "r_ymax")}
    return found.withColumns(common).drop(*[f"r_{s}" for s in SIDES]).where("xmin < xmax AND ymin < ymax")


def clip(source: DataFrame, mask: tuple[float, float, float, float] | None) -> DataFrame:
    """source's boxes cut to a mask box; what lies outside goes. No mask is an error."""
    require(mask is not None, "the mask is empty; draw a boundary to clip to")
    x0, y0, x1, y1 = mask
    cut = {"xmin": F.greatest("xmin", F.lit(x0)), "ymin": F.greatest("ymin", F.lit(y0)), "xmax": F.least("xmax", F.lit(x1)), "ymax": F.least("ymax", F.lit(y1))}
    inside = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    out = source.where(inside).withColumns(cut)
    return out.where((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))


def erase(source: DataFrame, mask: tuple[float, float, float, float] | None) -> DataFrame:
    """source's boxes without the mask box, in up to four pieces each (column piece: below, above, left, right); without a
    mask, source itself."""
    if mask is None:
        return source.withColumn("piece", F.lit("whole"))
    mx0, my0, mx1, my1 = (F.lit(float(v)) for v in mask)
    x0, y0, x1, y1 = box()
    apart = (x0 >= mx1) | (x1 <= mx0) | (y0 >= my1) | (y1 <= my0)
    lo, hi = F.greatest(y0, my0), F.least(y1, my1)
    piece = lambda name, a, b, c, d: F.struct(F.lit(name).alias("piece"), a.alias("xmin"), b.alias("ymin"), c.alias("xmax"), d.alias("ymax"))
    parts = F.when(apart, F.array(piece("whole", x0, y0, x1, y1))).otherwise(
        F.filter(
            F.array(piece("below", x0, y0, x1, F.least(y1, my0)), piece("above", x0, F.greatest(y0, my1), x1, y1), piece("left", x0, lo, F.least(x1, mx0), hi), piece("right", F.greatest(x0, mx1), lo, x1, hi)),
            lambda p: (p["xmin"] < p["xmax"]) & (p["ymin"] < p["ymax"]),
        )
    )
    return source.withColumn("__p", F.explode(parts)).withColumns({c: F.col(f"__p.{c}") for c in ("piece", *SIDES)}).drop("__p")


difference = erase


def erase_points(points: DataFrame, masks: DataFrame, *, cell: float | None = None) -> DataFrame:
    """Points (id, x, y) that lie in none of the mask boxes: an anti-join by id on the blocked pairs."""
    masks = masks.select(*SIDES)
    hit = pairs(as_boxes(points.select("id", "x", "y")), masks, "intersects", cell=cell).select("id").distinct()
    return points.join(hit, "id", "left_anti")


def _without(pieces: Column, mask: Column) -> Column:
    """An array of boxes without the mask box, each in up to four pieces."""

    def cut(p: Column) -> Column:
        piece = lambda *sides: F.struct(*[c.alias(s) for c, s in zip(sides, SIDES)])
        (x0, y0, x1, y1), (mx0, my0, mx1, my1) = ([v[s] for s in SIDES] for v in (p, mask))
        apart = (x0 >= mx1) | (x1 <= mx0) | (y0 >= my1) | (y1 <= my0)
        lo, hi = F.greatest(y0, my0), F.least(y1, my1)
        parts = F.array(piece(x0, y0, x1, my0), piece(x0, my1, x1, y1), piece(x0, lo, mx0, hi), piece(mx1, lo, x1, hi))
        return F.when(apart, F.array(piece(x0, y0, x1, y1))).otherwise(F.filter(parts, lambda q: (q["xmin"] < q["xmax"]) & (q["ymin"] < q["ymax"])))

    return F.flatten(F.transform(pieces, cut))


def erase_layer(source: DataFrame, masks: DataFrame, *, cell: float | None = None) -> DataFrame:
    """source's boxes without all that the boxes of masks cover, in pieces that don't meet; the other columns are kept. Equal
    boxes are cut once, by the distinct masks that meet them."""
    source = source.withColumns({s: F.col(s).cast("double") for s in SIDES}).where(" AND ".join(f"{s} IS NOT NULL" for s in SIDES))
    masks = masks.select(*[F.col(s).cast("double").alias(s) for s in SIDES]).where("xmin < xmax AND ymin < ymax").distinct()
    met = pairs(source.select(*SIDES).distinct(), masks, "intersects", cell=cell).where("xmin < r_xmax AND r_xmin < xmax AND ymin < r_ymax AND r_ymin < ymax")
    by = met.groupBy(*SIDES).agg(F.array_sort(F.collect_set(F.struct(*[F.col(f"r_{s}").alias(s) for s in SIDES]))).alias("__masks"))
    whole = F.array(F.struct(*SIDES))
    cuts = by.select(*SIDES, F.aggregate("__masks", whole, _without).alias("__p"))
    out = source.join(cuts, list(SIDES), "left").withColumn("__p", F.explode(F.coalesce("__p", whole)))
    return out.withColumns({s: F.col(f"__p.{s}") for s in SIDES}).select(*source.columns)


def union_layers(left: DataFrame, right: DataFrame, *, cell: float | None = None) -> DataFrame:
    """Three-way overlay of box layers: what of left no box of right covers, what of right no box of left covers, and the
    intersections; attributes of either side are null where it takes no part. column part: left, right or both."""
    return (
        erase_layer(left, right, cell=cell).withColumn("part", F.lit("left"))
        .unionByName(erase_layer(right, left, cell=cell).withColumn("part", F.lit("right")), allowMissingColumns=True)
        .unionByName(intersect(left, right, cell=cell).withColumn("part", F.lit("both")), allowMissingColumns=True)
    )


def buffer_boxes(source: DataFrame, distance: float) -> DataFrame:
    """Boxes moved out by distance on every side; negative distances erode, and boxes that vanish go. Zero is refused."""
    require(distance != 0, "a buffer of 0 changes nothing; give a distance")
    grown = {"xmin": F.col("xmin") - distance, "ymin": F.col("ymin") - distance, "xmax": F.col("xmax") + distance, "ymax": F.col("ymax") + distance}
    return source.withColumns(grown).where("xmin < xmax AND ymin < ymax")


def bounds(layer: DataFrame) -> DataFrame:
    """One row: the box of all boxes."""
    return layer.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def nearest_of(value: Column, distance: Column, tie: Column) -> Column:
    """Aggregate: the value at the least distance, ties to the least tie."""
    return F.min_by(value, F.struct(distance, tie))
