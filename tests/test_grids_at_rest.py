"""Grids written and read back, and surfaces cut to polygons and to the ground of the control."""

import numpy as np
import pandas as pd
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.operators import clipping as K
from lithoframe.operators.grids import Grid
from lithoframe.operators.overlay import rings_of
from lithoframe.operators.polygons import area
from lithoframe.sources import grids as G


def surface_of(spark, v, grid):
    r, c = np.indices(v.shape)
    pdf = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "x": grid.x0 + (c.ravel() + 0.5) * grid.size, "y": grid.y0 - (r.ravel() + 0.5) * grid.size, "value": v.ravel()})
    return spark.createDataFrame(pdf)


def test_round_trip_windows_and_overviews(spark, tmp_path, capsys):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 530))
    v[r.random(v.shape) < 0.1] = np.nan
    v[40, 50] = -999.0
    grid = Grid(1000.0, 9000.0, 10.0, 530, 300, 3857)
    path = f"file://{tmp_path}/g"
    note = G.write_grid(surface_of(spark, v, grid), grid, path, name="top")
    assert (note["levels"], note["tiles"]) == (3, 6) and G.grid_note(spark, path) == note
    got, back = G.read_grid(spark, path)
    assert back == grid
    cells = {(x.row, x.col): (x.x, x.y, x.value) for x in got.collect()}
    assert len(cells) == np.isfinite(v).sum() and all(c == (1000 + (k + 0.5) * 10, 9000 - (j + 0.5) * 10, v[j, k]) for (j, k), c in cells.items())
    # a window reads its tiles alone
    part, _ = G.read_grid(spark, path, window=(1000, 8000, 1500, 9000))
    assert {(x.row, x.col) for x in part.collect()} == {(j, k) for j, k in cells if j < 100 and k < 50}
    part.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert all(f in pushed for f in ("EqualTo(level,0)", "LessThanOrEqual(tile_col,0)", "LessThanOrEqual(tile_row,0)"))
    assert G.read_grid(spark, path, blank=-999.0)[0].count() == len(cells) - 1
    # an overview is the mean of what is known
    rough, half = G.read_grid(spark, path, level=1)
    assert (half.nx, half.ny, half.size, half.x0) == (265, 150, 20.0, 1000.0)
    means = {(x.row, x.col): x.value for x in rough.collect()}
    four = v.reshape(150, 2, 265, 2).swapaxes(1, 2).reshape(150, 265, 4)
    for (j, k), m in list(means.items())[::97]:
        assert m == pytest.approx(np.nanmean(four[j, k]))
    assert len(means) == np.isfinite(four).any(axis=2).sum()
    with pytest.raises(LayerError):
        G.read_grid(spark, path, level=3)


def test_a_grid_is_written_once(spark, tmp_path):
    grid = Grid(0.0, 2.0, 1.0, 2, 2)
    s = surface_of(spark, np.ones((2, 2)), grid)
    G.write_grid(s, grid, f"file://{tmp_path}/g")
    with pytest.raises(Exception):
        G.write_grid(s, grid, f"file://{tmp_path}/g")
    empty = G.write_grid(s.where("value > 5"), grid, f"file://{tmp_path}/e")
    assert empty["tiles"] == 0 and G.read_grid(spark, f"file://{tmp_path}/e")[0].count() == 0


def as_layer(spark, rings):
    return spark.createDataFrame([(i, bytearray(wkb.encode("Polygon", r))) for i, r in enumerate(rings)], "id long, geometry binary")


def test_clip_to_polygons_with_holes(spark):
    grid = Grid(0.0, 20.0, 1.0, 20, 20)
    s = surface_of(spark, np.arange(400.0).reshape(20, 20), grid)
    square = np.array([[2, 2], [12, 2], [12, 12], [2, 12], [2, 2]], float)
    mask = as_layer(spark, [[square, (square / 5 + 5)[::-1]], [square + 6]])
    inside = lambda x, y: (2 <= x <= 12 and 2 <= y <= 12 and not (5.4 < x < 7.4 and 5.4 < y < 7.4)) or (8 <= x <= 18 and 8 <= y <= 18)
    for invert in (False, True):
        out = K.clip_to_polygons(s, mask, invert).collect()
        assert len(out) == 400 and all((r.value is not None) == (inside(r.x, r.y) != invert) for r in out)
    picked = K.clip_to_polygons(s, K.boundary_of(mask, [1]))
    assert picked.where("value IS NOT NULL").count() == 100
    report = K.clip_report(picked, s.where("row = 8 AND col = 8").select(F_id(), "x", "y", "value"), 3.0)
    assert report["clipped_fraction"] == 0.75 and 0 < report["extrapolated_fraction"] < 1 and report["display_range"][0] < report["display_range"][1]
    for bad in (lambda: K.boundary_of(mask, [9]), lambda: K.clip_to_polygons(s, as_layer(spark, [[square + 900]])), lambda: K.clip_to_polygons(s, mask.where("id < 0"))):
        with pytest.raises(LayerError):
            bad()


def F_id():
    from pyspark.sql import functions as F

    return F.lit(1).alias("id")


def test_control_boundaries(spark):
    r = np.random.default_rng(2)
    xy = np.concatenate((r.uniform(0, 100, (60, 2)), r.uniform(300, 340, (10, 2))))
    control = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)], "id long, x double, y double, value double")
    pieces = [rings_of(*wkb.decode(bytes(p.geometry))) for p in K.control_boundary(control, "radius", radius=12.0).collect()]
    size = sum(area(ring) for rings in pieces for ring in rings)
    gx, gy = np.meshgrid(np.arange(-20, 380, 0.5), np.arange(-20, 380, 0.5))
    near = np.zeros(gx.shape, bool)
    for x, y in xy:
        near |= (gx - x) ** 2 + (gy - y) ** 2 <= 144
    assert len(pieces) > 3 and size == pytest.approx(near.sum() * 0.25, rel=0.02)
    cells = spark.createDataFrame([(float(x), float(y)) for x, y in r.uniform(-20, 360, (400, 2))], "x double, y double")
    for c in K.supported(cells, control, 12.0).collect():
        assert c.supported == bool((np.hypot(*(xy - [c.x, c.y]).T) <= 12).any())
    hull, concave = (area(rings_of(*wkb.decode(bytes(K.control_boundary(control, m).first().geometry)))[0]) for m in ("convex_hull", "concave_hull"))
    assert 0 < concave < hull
    for bad in (dict(method="box"), dict(method="radius", radius=0.0)):
        with pytest.raises(LayerError):
            K.control_boundary(control, **bad)
    with pytest.raises(LayerError):
        K.control_boundary(control.where("id < 2"))
