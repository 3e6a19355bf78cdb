"""Surfaces cut to boundaries: any polygons, or the ground that the control supports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from ..scratch import cut
from . import neighbours, overlay, polygons
from .relations import _numbered, points_in
from .statistics import display_range

METHODS = ("convex_hull", "concave_hull", "radius")
#: Radii along the tiles in which discs are united, and the concavity of a concave hull.
TILE_RADII, CONCAVITY = 8, 0.4


def boundary_of(layer: DataFrame, ids: list | None = None, key: str = "id") -> DataFrame:
    """(geometry): the polygons of a layer, or those picked by id, to clip to. None at all is refused, as clipping to nothing would
    blank a grid."""
    picked = layer if ids is None else layer.where(F.col(key).isin(list(ids)))
    kind = wkb.kind_column(F.col("geometry"))
    out = picked.where("geometry IS NOT NULL").where(kind.isin("polygon", "multipolygon")).select("geometry")
    require(not out.isEmpty(), "the boundary has no polygon; check that the layer has some and that a selection was made")
    return out


def clip_to_polygons(surface: DataFrame, boundary: DataFrame, invert: bool = False) -> DataFrame:
    """The surface (row, col, x, y, value) without the values of cells whose centre lies in no polygon of the boundary, or with
    invert of those that do. A centre on an outline is inside. Columns and rows stay; cells without a value keep none.

    Centres meet the boundary by cells of a grid, so no task holds the whole of a polygon. A clip that leaves no value is refused."""
    rows = _numbered(surface, "__cell")
    b = _numbered(boundary_of(boundary), "__part")
    inside = points_in(rows.select("__cell", "x", "y"), b, "__part").select("__cell").distinct().withColumn("__in", F.lit(True))
    keep = F.coalesce("__in", F.lit(False))
    out = cut(rows.join(inside, "__cell", "left").withColumn("value", F.when(~keep if invert else keep, F.col("value"))))
    left = out.where("value IS NOT NULL AND NOT isnan(value)").limit(1).count()
    require(left, "the clip removes every value; the boundary may be in another frame, or invert the wrong way round")
    return out.select(*surface.columns)


def clip_report(clipped: DataFrame, control: DataFrame | None = None, radius: float | None = None) -> dict:
    """clipped_fraction, the display range of what is left, and with control the part of it farther than the radius (by default that
    of the control's spacing) from all control."""
    n = clipped.agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("value"), F.col("value"))).alias("left")).first()
    seen = display_range(clipped.where("value IS NOT NULL AND NOT isnan(value)"), "value").first()
    out = {"clipped_fraction": 1 - n["left"] / n["n"], "display_range": (seen["lo"], seen["hi"]), "extrapolated_fraction": None}
    if control is not None:
        cells = _numbered(clipped.where("value IS NOT NULL AND NOT isnan(value)").select("x", "y"), "cell_id")
        reach = radius if radius is not None else neighbours.search_radius(control).first()["radius"]
        out["extrapolated_fraction"] = neighbours.extrapolated_fraction(cells, control, reach).first()["fraction"]
    return out


def supported(cells: DataFrame, control: DataFrame, radius: float) -> DataFrame:
    """cells (x, y) with supported: whether control lies within the radius. Cells meet the control of their own and the next squares
    of that side; control of one place counts once."""
    at = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")
    rows = _numbered(cells, "__cell")
    wide = rows.select("__cell", "x", "y", F.explode(F.sequence(at("x") - 1, at("x") + 1)).alias("cx"), at("y").alias("__y")).withColumn("cy", F.explode(F.sequence(F.col("__y") - 1, F.col("__y") + 1)))
    near = control.select("x", "y").distinct().select(F.col("x").alias("px"), F.col("y").alias("py"), at("x").alias("cx"), at("y").alias("cy"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    met = wide.join(near, ["cx", "cy"]).where(d2 <= radius * radius).select("__cell").distinct().withColumn("supported", F.lit(True))
    return rows.join(met, "__cell", "left").withColumn("supported", F.coalesce("supported", F.lit(False))).drop("__cell")


def control_boundary(control: DataFrame, method: str = "convex_hull", *, radius: float | None = None, concavity: float = CONCAVITY, resolution: int = polygons.QUARTER) -> DataFrame:
    """(geometry) of the ground that control (x, y) supports: its convex hull, its concave hull, or the discs of a radius around it.

    Discs are united tile by tile and each union is cut to its tile, so the boundary comes as pieces that do not overlap and none is
    larger than a tile; holes are where control is sparse. The default radius is that of the control's spacing."""
    require(method in METHODS, f"method {method!r} is not one of {', '.join(METHODS)}")
    places = cut(control.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct())
    n = places.count()
    require(n >= 3, f"{n} places of control have no interior to clip to; 3 are needed")
    if method != "radius":
        layer = places.select(F.lit(1).alias("id"), wkb.points_to_wkb(F.col("x"), F.col("y")).alias("geometry"))
        hull = polygons.convex_hull(layer) if method == "convex_hull" else polygons.concave_hull(layer, concavity)
        return hull.select("geometry")
    if radius is None:
        radius = neighbours.search_radius(places.withColumn("id", F.monotonically_increasing_id())).first()["radius"]
    require(radius is not None and radius > 0, f"a boundary of discs needs a radius above 0, not {radius}")
    side = float(TILE_RADII * radius)

    def discs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["x"], b["y"]):
                shape = wkb.encode("Polygon", [polygons.circle(x, y, radius, resolution)])
                for i in range(int(np.floor((x - radius) / side)), int(np.floor((x + radius) / side)) + 1):
                    for j in range(int(np.floor((y - radius) / side)), int(np.floor((y + radius) / side)) + 1):
                        out.append((f"{i},{j}", shape))
            yield pd.DataFrame(out, columns=["tile", "geometry"])

    def in_tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = []
            for tile, g in zip(b["tile"], b["geometry"]):
                i, j = map(int, tile.split(","))
                x, y = i * side, j * side
                box = np.array([[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]])
                cuts.append(overlay._common(bytes(g), wkb.encode("Polygon", [box])))
            yield pd.DataFrame({"geometry": [c for c in cuts if c is not None]})

    united = overlay.dissolve_polygons(places.mapInPandas(discs, "tile string, geometry binary"), "tile")
    return united.mapInPandas(in_tile, "geometry binary")
