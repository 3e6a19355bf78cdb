"""Concave hulls over many points equal those of a plain search over all points at hand."""

import math

import numpy as np
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.operators import polygons


def plain(points, ratio):
    """The longest edge above the ratio's length is dug to the nearest free point, by looking at every point and every edge."""
    p = np.unique(points, axis=0)
    ring = polygons.hull(p)
    if len(p) < 4 or ratio >= 1:
        return ring
    free = np.array([v for v in p if not (ring == v).all(axis=1).any()]).reshape(-1, 2)
    after = dict(zip(map(tuple, ring[:-1]), map(tuple, ring[1:])))
    long = lambda a, b: math.hypot(b[0] - a[0], b[1] - a[1])
    todo, limit = list(after.items()), ratio * max(long(*e) for e in after.items())
    while todo and len(free):
        todo.sort(key=lambda e: (-long(*e), e))
        a, b = todo.pop(0)
        if long(a, b) <= limit:
            break
        n = int(np.argmin(np.hypot(*(free - a).T) + np.hypot(*(free - b).T)))
        k = tuple(free[n])
        edges = np.array(list(after.items()))
        if max(long(a, k), long(k, b)) >= long(a, b) or any(polygons._cross(np.array(s), free[n], edges).any() for s in (a, b)):
            continue
        after |= {a: k, k: b}
        todo += [(a, k), (k, b)]
        free = np.delete(free, n, axis=0)
    walk = [tuple(ring[0])]
    while (at := after[walk[-1]]) != walk[0]:
        walk.append(at)
    return np.array([*walk, walk[0]])


def clouds():
    r = np.random.default_rng(7)
    t = r.uniform(0, 2 * math.pi, 150)
    yield r.random((150, 2))
    yield r.integers(0, 12, (150, 2)).astype(float)
    yield np.concatenate((r.normal((0, 0), 8, (80, 2)), r.normal((200, 0), 8, (80, 2))))
    yield np.column_stack((np.cos(t), np.sin(t))) * r.choice((1, 0.8), 150)[:, None] + 5e6
    yield np.column_stack((np.arange(9), np.arange(9))).astype(float)
    yield np.array([[0, 0], [4, 0], [1, 1], [0, 4]], float)
    yield np.array([[0, 0], [4, 0], [1, 1]], float)


@pytest.mark.parametrize("sizes", [{}, dict(LOOKED_UP=8, EDGES=4, FEWEST=1, MOST=3, BLOCK=4), dict(LOOKED_UP=1, EDGES=1, FEWEST=1, MOST=1, BLOCK=2)])
def test_digging_by_rounds_is_plain_digging(monkeypatch, sizes):
    for name, v in sizes.items():
        monkeypatch.setattr(polygons, name, v)
    for p in clouds():
        for ratio in (0.0, 0.1, 0.3, 1.0):
            assert np.array_equal(polygons.concave(p, ratio), plain(p, ratio))


def rings(df):
    return [np.asarray(wkb.decode(bytes(r.geometry))[1][0]) for r in df.collect()]


def test_concave_hull_takes_more_points_than_one_task_did(spark):
    r = np.random.default_rng(3)
    xy = np.concatenate((r.normal((0, 0), 8, (120_000, 2)), r.normal((200, 0), 8, (120_000, 2)))).round(6)
    layer = spark.createDataFrame([(bytearray(wkb.encode("Point", v)),) for v in xy], "geometry binary")
    (got,) = rings(polygons.concave_hull(layer, 0.1))
    assert np.array_equal(got, plain(xy, 0.1))
    assert polygons.area(got) < 0.9 * polygons.area(polygons.hull(xy))


def test_concave_hull_looks_up_in_rounds(spark, monkeypatch):
    for name, v in dict(LOOKED_UP=64, EDGES=16, FEWEST=4, MOST=8).items():
        monkeypatch.setattr(polygons, name, v)
    xy = np.random.default_rng(5).integers(-40, 40, (300, 2)).astype(float)
    layer = spark.createDataFrame([(bytearray(wkb.encode("Point", v)),) for v in [*xy, (math.nan, math.nan)]] + [(None,)], "geometry binary")
    (got,) = rings(polygons.concave_hull(layer, 0.2))
    assert np.array_equal(got, plain(xy, 0.2))
    assert rings(polygons.concave_hull(layer.where("geometry IS NULL"))) == []
    with pytest.raises(LayerError):
        polygons.concave_hull(spark.createDataFrame([(bytearray(wkb.encode("Point", (0.0, math.inf))),)], "geometry binary"))
