"""Reprojection against published worked examples, round trips, and Columns against arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.errors import LayerError
from lithoframe.functions import projections as P
from lithoframe.functions import wkb
from lithoframe.layers import frame_of, in_frame


def test_worked_examples_of_the_guidance_note():
    # transverse Mercator: Airy 1830, British grid; Lambert: Clarke 1866, Texas South Central in feet
    grid = P.TransverseMercator(6377563.396, 299.32496, -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0)
    e, n = grid.forward(math.radians(0.5), np.float64(math.radians(50.5)), P.ARRAYS)
    assert abs(e - 577274.99) < 0.01 and abs(n - 69740.50) < 0.01
    texas = P.LambertConic(20925832.16, 294.978698, 28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99.0, 2_000_000.0, 0.0)
    e, n = texas.forward(math.radians(-96.0), np.float64(math.radians(28.5)), P.ARRAYS)
    assert abs(e - 2963503.91) < 0.02 and abs(n - 254759.80) < 0.02


@pytest.mark.parametrize("srid", [3857, 32614, 32733, 26913, *P.STATE_PLANE])
def test_round_trips_and_columns_equal_arrays(spark, srid):
    r = np.random.default_rng(srid)
    mid = {32733: (15.0, -20.0), 32614: (-99.0, 32.0), 26913: (-105.0, 35.0)}.get(srid, (-100.0, 31.0))
    lon, lat = mid[0] + r.uniform(-3, 3, 50), mid[1] + r.uniform(-3, 3, 50)
    x, y = P.transform_points(lon, lat, 4326, srid)
    back = P.transform_points(x, y, srid, 4326)
    assert np.abs(back[0] - lon).max() < 1e-11 and np.abs(back[1] - lat).max() < 1e-11
    layer = in_frame(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))] + [(50, None, 1.0)], "id long, x double, y double"), 4326)
    moved = P.reproject(layer, srid)
    got = sorted(map(tuple, moved.collect()))
    assert frame_of(moved) == srid and got[50][1] is None
    assert np.abs(np.array([(g[1], g[2]) for g in got[:50]]) - np.stack([x, y], 1)).max() < 1e-6


def test_known_places_and_units():
    x, y = P.transform_points(np.array([-102.0]), np.array([32.0]), 4326, 3857)
    assert abs(x[0] + 11_354_588.06) < 0.01 and abs(y[0] - 3_763_310.63) < 0.01
    # the origin of a zone is its false easting and northing; a central meridian has the UTM scale
    x, y = P.transform_points(np.array([-(100 + 20 / 60)]), np.array([29 + 40 / 60]), 4269, 2277)
    assert abs(x[0] - 700_000 / P.FOOT) < 1e-6 and abs(y[0] - 3_000_000 / P.FOOT) < 1e-6
    x, y = P.transform_points(np.array([-99.0, -99.0]), np.array([0.0, 1.0]), 4326, 32614)
    assert abs(x[0] - 500_000) < 1e-9 and abs(y[0]) < 1e-9 and abs(y[1] - 0.9996 * 110_574.389) < 0.01
    assert (P.axis_units(2277), P.axis_units(32614), P.axis_units(3857)) == ("usft", "m", "m")
    with pytest.raises(LayerError, match="geographic.*State Plane"):
        P.axis_units(4326)
    with pytest.raises(LayerError, match="31999"):
        P.projection(31999)


def test_same_frame_is_untouched_and_boxes_cover():
    x = np.array([1_500_000.123456])
    assert P.transform_points(x, x, 2277, 2277)[0] is x
    box = (-102.9, 31.6, -101.4, 32.5)
    assert P.transform_bbox(box, 4326, 4326) == box
    r = np.random.default_rng(4)
    for dst in (2277, 32614, 32613, 3857):
        bound = P.transform_bbox(box, 4326, dst)
        x, y = P.transform_points(r.uniform(box[0], box[2], 5000), r.uniform(box[1], box[3], 5000), 4326, dst)
        assert bound[0] <= x.min() and x.max() <= bound[2] and bound[1] <= y.min() and y.max() <= bound[3]
        assert bound[2] - bound[0] < 1.01 * (x.max() - x.min()) and bound[3] - bound[1] < 1.01 * (y.max() - y.min())


def test_geometries_move_vertex_for_vertex(spark):
    ring = np.array([[-102, 31], [-101, 31], [-101, 32], [-102, 31]], float)
    shapes = [("Point", (-102.0, 31.0)), ("LineString", ring), ("Polygon", [ring, ring[::-1]]), ("MultiPoint", [(-102.0, 31.0)]), ("MultiPolygon", [[ring], [ring]])]
    layer = in_frame(spark.createDataFrame([(i, bytearray(wkb.encode(*s))) for i, s in enumerate(shapes)] + [(9, None)], "id long, geometry binary"), 4326)
    got = {r.id: r.geometry for r in P.transform_geometries(layer, 2277).collect()}
    x, y = P.transform_points(ring[:, 0], ring[:, 1], 4326, 2277)
    want = np.stack([x, y], 1)
    assert got[9] is None
    assert np.allclose(wkb.decode(bytes(got[1]))[1], want, atol=1e-6, rtol=0) and np.allclose(wkb.decode(bytes(got[0]))[1], want[0], atol=1e-6, rtol=0)
    assert np.allclose(wkb.decode(bytes(got[2]))[1][1], want[::-1], atol=1e-6, rtol=0) and np.allclose(wkb.decode(bytes(got[4]))[1][1][0], want, atol=1e-6, rtol=0)


def test_definitions_name_their_frame():
    for srid in (4326, 4269, 3857, 32614, 32733, 26913, 2276, 2277, 2278):
        text = P.crs_definition(srid)
        assert P.epsg_from_user_input(text) == srid == P.epsg_from_user_input(f"epsg:{srid}")
        title = text.split('"')[1]
        assert P.epsg_from_user_input(title) == srid and P.epsg_from_user_input(f'PROJCS["{title}"]') == srid
    assert P.epsg_from_user_input("no such frame") is None and P.epsg_from_user_input("EPSG:99999") is None
