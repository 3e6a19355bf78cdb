"""Joins of points and polygons against what their kernels say of every pair, and the kernels against random places."""

import numpy as np
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.operators import aggregate, relations as R
from lithoframe.operators.aggregate import Stat

SQUARE = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
FRAME = [SQUARE, SQUARE[::-1] / 2 + 1]


def star(r, n, at, big, whole):
    t = np.sort(r.uniform(0, 2 * np.pi, n))
    d = r.uniform(0.3, 1, n) * big
    p = np.stack([at[0] + d * np.cos(t), at[1] + d * np.sin(t)], 1)
    p = np.round(p) if whole else p
    return np.concatenate((p, p[:1]))


def shapes(seed, n, whole=True):
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        ring = star(r, int(r.integers(3, 9)), r.uniform(-12, 12, 2), r.uniform(2, 9), whole)
        e = np.concatenate((ring[:-1], ring[1:]), axis=1)
        simple = all(not crossing(e[i], e[j]) for i in range(len(e)) for j in range(i) if (i - j) % len(e) not in (1, len(e) - 1))
        if simple and (np.unique(ring[:-1], axis=0).shape[0] == len(ring) - 1) and abs(R.area(ring)) > 1 and straight_free(ring):
            out.append([ring])
    return out


def straight_free(ring):
    a, b = np.diff(ring, axis=0), np.roll(np.diff(ring, axis=0), -1, axis=0)
    return (np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9).all()


def crossing(a, b):
    s = lambda e, x, y: (e[2] - e[0]) * (y - e[1]) - (x - e[0]) * (e[3] - e[1])
    return s(a, b[0], b[1]) * s(a, b[2], b[3]) <= 0 and s(b, a[0], a[1]) * s(b, a[2], a[3]) <= 0


def as_wkb(rings):
    return bytearray(wkb.encode("Polygon", rings))


def layer(spark, rings, **columns):
    return spark.createDataFrame([(i, as_wkb(r)) for i, r in enumerate(rings)] + [(999, None)], "id long, geometry binary")


def test_relations_of_squares():
    rel = lambda a, b: {k for k, v in R.relation(R.outline(as_wkb(a)), R.outline(as_wkb(b))).items() if v}
    assert rel([SQUARE], [SQUARE]) == {"intersects", "contains", "within"}
    assert rel([SQUARE], [SQUARE + [4, 0]]) == rel([SQUARE], [SQUARE + 4]) == rel([SQUARE], [SQUARE + [4, 1]]) == {"intersects", "touches"}
    assert rel([SQUARE], [SQUARE + 2]) == rel([SQUARE], [SQUARE + [2, 0]]) == {"intersects", "overlaps"}
    assert rel([SQUARE], [SQUARE / 2 + 1]) == rel([SQUARE], [SQUARE / 2]) == {"intersects", "contains"}
    assert rel([SQUARE / 2], [SQUARE]) == {"intersects", "within"} and rel([SQUARE], [SQUARE + 9]) == set()
    assert rel(FRAME, [SQUARE / 2 + 1]) == {"intersects", "touches"} and rel(FRAME, [SQUARE / 4 + 1.5]) == set()
    assert rel([SQUARE], FRAME) == {"intersects", "contains"} and rel(FRAME, [SQUARE * 0.75 + 0.5]) == {"intersects", "overlaps"}
    assert rel([SQUARE[::-1]], [SQUARE]) == rel([SQUARE], [SQUARE])


@pytest.mark.parametrize("seed", range(12))
def test_relations_agree_with_places(seed):
    a, b = shapes(seed, 2, whole=seed % 2 == 0)
    x, y = np.random.default_rng(seed).uniform(-22, 22, (2, 6000))
    p, q = R.where_is(R.outline(as_wkb(a)), x, y) > 0, R.where_is(R.outline(as_wkb(b)), x, y) > 0
    got = R.relation(R.outline(as_wkb(a)), R.outline(as_wkb(b)))
    if (p & q).any():
        assert got["intersects"] and not got["touches"]
        assert not (got["within"] and (p & ~q).any()) and not (got["contains"] and (q & ~p).any())
        assert got["overlaps"] or got["within"] or got["contains"]
    if got["overlaps"] and min((p & q).sum(), (p & ~q).sum(), (q & ~p).sum()) == 0:
        assert (p & q).sum() < 60 or (p & ~q).sum() < 60  # too small to be hit


@pytest.mark.parametrize("seed,whole,size", [(1, True, 1.0), (2, True, 2.0), (3, True, 3.7), (4, False, 1.3), (5, True, 50.0)])
def test_points_by_cells(spark, seed, whole, size):
    rings = [*shapes(seed, 12, whole), [SQUARE * 3, SQUARE[::-1] + 2]]
    r = np.random.default_rng(seed)
    xy = np.concatenate((r.integers(-20, 20, (1500, 2)).astype(float), r.uniform(-20, 20, (500, 2)), r.integers(-40, 40, (500, 2)) / 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9999, None, 1.0)], "pid long, x double, y double")
    got = {(p.pid, p.id): p.place for p in R.points_in(pts, layer(spark, rings), "id", size).collect()}
    want = {(i, j): int(k) for j, g in enumerate(rings) for i, k in enumerate(R.where_is(R.outline(as_wkb(g)), *xy.T)) if k >= 0}
    assert got == want and len(want) > 500


def test_joins_of_layers(spark):
    a, b = shapes(21, 25), [*shapes(22, 25), *shapes(21, 3)]
    want = {k: {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if R.relation(R.outline(as_wkb(p)), R.outline(as_wkb(q)))[k]} for k in R.PREDICATES}
    for k in R.PREDICATES:
        got = R.spatial_join_shapes(layer(spark, a), layer(spark, b), k).select("id", "right_id").collect()
        assert sorted(tuple(x) for x in got) == sorted(want[k]), k
    assert want["overlaps"] and {(0, 25), (1, 26)} <= want["contains"]
    kept = R.spatial_join_shapes(layer(spark, a), layer(spark, b), "contains", how="left").collect()
    assert len(kept) == len(want["contains"]) + len(set(range(25)) - {i for i, _ in want["contains"]}) + 1
    with pytest.raises(LayerError):
        R.spatial_join_shapes(layer(spark, a), layer(spark, b), "near")


def test_summaries_of_zones(spark):
    zones = spark.createDataFrame([(1, as_wkb([SQUARE])), (2, as_wkb([SQUARE + [4, 0]])), (3, as_wkb([SQUARE + 90])), (3, as_wkb([SQUARE * 2])), (5, None)], "zid long, geometry binary")
    pts = spark.createDataFrame([(4.0, 1.0, 10.0), (1.0, 1.0, 5.0), (7.0, 7.0, None), (70.0, 7.0, 9.0)], "x double, y double, v double")
    stats = [Stat("count", "n"), Stat("sum", "total", "v")]
    got = sorted((r.zid, r.n, r.total or 0) for r in aggregate.aggregate("summarize_within", [zones, pts], stats).collect())
    assert got == [(1, 2, 15.0), (2, 1, 10.0), (3, 0, 0), (3, 3, 15.0), (5, 0, 0)]
    boxes = spark.createDataFrame([(1, as_wkb([SQUARE / 8 + 1])), (2, as_wkb([SQUARE + 8]))], "fid long, geometry binary")
    got = sorted((r.zid, r.n) for r in aggregate.aggregate("summarize_within", [zones, boxes], [Stat("count", "n")]).collect())
    assert got == [(1, 1), (2, 0), (3, 0), (3, 2), (5, 0)]
