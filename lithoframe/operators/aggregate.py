"""Spatial aggregation: square and hexagonal bins, zonal statistics, dissolve, centroids, and the catalogue by name."""

from __future__ import annotations

import math
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.geometry import SIDES
from . import spatial

OPS = ("count", "sum", "mean", "min", "max")


@dataclass(frozen=True)
class Stat:
    """An output statistic; every op but count needs a field."""

    op: str
    name: str
    field: str | None = None

    def __post_init__(self) -> None:
        require(self.op in OPS, f"statistic {self.op!r} is not one of {', '.join(OPS)}")
        require(self.op == "count" or bool(self.field), f"statistic {self.name!r} needs a field to take the {self.op} of")

    def column(self, present: Column | None = None) -> Column:
        """Over finite numbers; null where there are none. present: what count counts."""
        if self.op == "count":
            return F.count(present if present is not None else F.lit(1)).alias(self.name)
        v = finite(F.col(self.field))
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[self.op](v).alias(self.name)


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def json_number(key: str, props: str = "props") -> Column:
    """A JSON attribute where it is a number: booleans and numbers in quotes are not."""
    v = F.try_parse_json(F.col(props))
    kind = F.schema_of_variant(F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant"))
    value = F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), value)


def square_keys(size: float) -> dict[str, Column]:
    return {"kx": F.floor(F.col("x") / size).cast("long"), "ky": F.floor(F.col("y") / size).cast("long")}


def aggregate_points(points: DataFrame, size: float, stats: list[Stat]) -> DataFrame:
    """(kx, ky, cx, cy, statistics) of the squares that hold points, whose centres are (k + 1/2) size."""
    require(size > 0, f"the cell size must be above 0, not {size}")
    out = points.withColumns(square_keys(size)).groupBy("kx", "ky").agg(*[s.column() for s in stats])
    return out.withColumns({"cx": (F.col("kx") + 0.5) * size, "cy": (F.col("ky") + 0.5) * size})


def hex_keys(size: float) -> dict[str, Column]:
    """Nearest centre of two lattices, each `size` wide and size * sqrt(3) high, the second moved by half of both; halves
    round to even, and ties go to the first."""
    w, h = float(size), float(size) * math.sqrt(3.0)
    x, y = F.col("x"), F.col("y")
    ec, er = F.rint(x / w), F.rint(y / h)
    oc, orow = F.rint((x - w / 2) / w), F.rint((y - h / 2) / h)
    de = (x - ec * w) * (x - ec * w) + (y - er * h) * (y - er * h)
    do = (x - (oc * w + w / 2)) * (x - (oc * w + w / 2)) + (y - (orow * h + h / 2)) * (y - (orow * h + h / 2))
    even = de <= do
    return {
        "kx": F.when(even, 2 * ec).otherwise(2 * oc + 1).cast("long"), "ky": F.when(even, er).otherwise(orow).cast("long"),
        "cx": F.when(even, ec * w).otherwise(oc * w + w / 2), "cy": F.when(even, er * h).otherwise(orow * h + h / 2),
    }


def hexbin(points: DataFrame, size: float, stats: list[Stat]) -> DataFrame:
    """(kx, ky, cx, cy, statistics) of the pointy-top hexagons that hold points; their circumradius is size / sqrt(3)."""
    require(size > 0, f"the cell size must be above 0, not {size}")
    keyed = points.withColumns(hex_keys(size))
    return keyed.groupBy("kx", "ky").agg(*[s.column() for s in stats], F.min("cx").alias("cx"), F.min("cy").alias("cy"))


def hexagon(cx: Column, cy: Column, size: float) -> Column:
    """The corners of a hexagon as an array of structs, closed."""
    r = size / math.sqrt(3.0)
    corners = [(math.cos(math.radians(60 * k + 30)) * r, math.sin(math.radians(60 * k + 30)) * r) for k in [*range(6), 0]]
    return F.array(*[F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in corners])


def summarize_within(zones: DataFrame, points: DataFrame, stats: list[Stat], *, zone_id: str = "zid") -> DataFrame:
    """Statistics of the features that meet each zone; a feature on a shared edge counts in both; a zone without features
    has count 0 and no other values. Zones are few boxes, or the join goes by grid cells; rows are aggregated by zone before
    they leave their tasks."""
    zone_columns = [c for c in zones.columns if c not in SIDES]
    inner = spatial.pairs(spatial.as_boxes(points.drop(*[c for c in points.columns if c in zone_columns])), zones)
    sums = inner.groupBy(zone_id).agg(*[s.column() for s in stats])
    out = zones.join(sums, zone_id, "left")
    zero = {s.name: F.coalesce(s.name, F.lit(0).cast("long")) for s in stats if s.op == "count"}
    return out.withColumns(zero) if zero else out


def dissolve_boxes(source: DataFrame, by: str | None = None) -> DataFrame:
    """The bounding box of each group, of all without `by`, with source_features; missing values are a group, last."""
    box = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("source_features")]
    if by is None:
        return source.agg(*box)
    return source.groupBy(by).agg(*box).orderBy(F.col(by).cast("string").asc_nulls_last())


def dissolved_area(source: DataFrame, by: str) -> DataFrame:
    """(by, area) of the union of boxes on a common grid of edges: unit cells counted once, however many boxes hold them."""
    xs = source.select(F.explode(F.array("xmin", "xmax")).alias("x")).distinct()
    edges = source.select(F.explode(F.array("ymin", "ymax")).alias("y")).distinct()
    from pyspark.sql import Window as W

    strips = xs.select(F.col("x").alias("x0"), F.lead("x").over(W.orderBy("x")).alias("x1")).where("x1 IS NOT NULL")
    rows = edges.select(F.col("y").alias("y0"), F.lead("y").over(W.orderBy("y")).alias("y1")).where("y1 IS NOT NULL")
    cut = source.join(F.broadcast(strips), (F.col("x0") >= F.col("xmin")) & (F.col("x1") <= F.col("xmax"))).join(F.broadcast(rows), (F.col("y0") >= F.col("ymin")) & (F.col("y1") <= F.col("ymax")))
    return cut.select(by, "x0", "x1", "y0", "y1").distinct().groupBy(by).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def centroids(source: DataFrame) -> DataFrame:
    return source.withColumns({"x": (F.col("xmin") + F.col("xmax")) / 2, "y": (F.col("ymin") + F.col("ymax")) / 2})


def resolve_attributes(source: DataFrame, by: str, fields: list[str], area: Column, policy: str) -> DataFrame:
    """One row for each group: the value of the largest feature, the value where all agree, or the sum."""
    require(policy in ("largest", "common", "sum_numeric"), f"policy {policy!r} is not one of largest, common, sum_numeric")
    take = {
        "largest": lambda f: F.max_by(f, F.struct(area, F.col(f))),
        "common": lambda f: F.when((F.min(f) == F.max(f)) & (F.count(f) == F.count("*")), F.min(f)),
        "sum_numeric": lambda f: F.sum(f),
    }[policy]
    return source.groupBy(by).agg(*[take(f).alias(f) for f in fields])


def attribute_preview(source: DataFrame, by: str, field: str, area: Column) -> DataFrame:
    """All three policies of one field side by side."""
    return source.groupBy(by).agg(
        F.max_by(field, F.struct(area, F.col(field))).alias("largest"),
        F.when((F.min(field) == F.max(field)) & (F.count(field) == F.count("*")), F.min(field)).alias("common"),
        F.sum(field).alias("sum_numeric"),
    )


def _of(module: str, name: str):
    def run(*layers, **params) -> DataFrame:
        return getattr(import_module(f"lithoframe.operators.{module}"), name)(*layers, **params)

    return run


def _by_shape(boxes, shapes):
    """The operation for polygons where a layer has a geometry, else the one for boxes."""

    def run(*layers, **params) -> DataFrame:
        return (shapes if any("geometry" in layer.columns for layer in layers if isinstance(layer, DataFrame)) else boxes)(*layers, **params)

    return run


#: name: (function, numbers of layers it takes). Layers of boxes (xmin to ymax) and of polygons (geometry) have the same operations;
#: for boxes, the mask of a clip or an erase is a box given as an argument.
CATALOGUE = {
    "buffer": (_of("polygons", "buffer"), (1,)), "centroid": (centroids, (1,)), "convex_hull": (_of("polygons", "convex_hull"), (1,)), "concave_hull": (_of("polygons", "concave_hull"), (1,)),
    "clip": (_by_shape(spatial.clip, _of("overlay", "clip_layer")), (1, 2)), "erase": (_by_shape(spatial.erase, _of("overlay", "erase_polygons")), (1, 2)),
    "difference": (_by_shape(spatial.erase, _of("overlay", "erase_polygons")), (1, 2)), "intersect": (_by_shape(spatial.intersect, _of("overlay", "intersect_polygons")), (2,)),
    "union": (_by_shape(spatial.union_layers, _of("overlay", "union_polygons")), (2,)), "dissolve": (_by_shape(dissolve_boxes, _of("overlay", "dissolve_polygons")), (1,)),
    "spatial_join": (_by_shape(spatial.spatial_join, _of("relations", "spatial_join_shapes")), (2,)), "summarize_within": (_by_shape(summarize_within, _of("relations", "summarize_within_shapes")), (2,)),
    "aggregate_points": (aggregate_points, (1,)), "hexbin": (hexbin, (1,)), "voronoi": (_of("polygons", "voronoi"), (1,)),
}


def operations() -> list[str]:
    return sorted(CATALOGUE)


def aggregate(op: str, layers: list[DataFrame], *args, **params) -> DataFrame:
    """An operation of the catalogue by its name."""
    require(op in CATALOGUE, f"operation {op!r} is not one of {', '.join(operations())}")
    f, n = CATALOGUE[op]
    require(len(layers) in n, f"{op} takes {' or '.join(map(str, n))} layer{'s' * (n != (1,))}, not {len(layers)}")
    return f(*layers, *args, **params)
