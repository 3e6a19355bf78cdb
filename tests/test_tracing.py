"""Lines and bands traced by tiles: against the areas of single squares, points thrown at them, and one tile for all."""

import math

import numpy as np
import pandas as pd
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.operators import contours, tracing
from lithoframe.operators.polygons import area, inside


def made(seed, ny=23, nx=19, holes=0.06, steps=None):
    r = np.random.default_rng(seed)
    v = r.normal(size=(ny, nx))
    for _ in range(2):
        v = (v + np.roll(v, 1, 0) + np.roll(v, 1, 1) + np.roll(v, -1, 0)) / 2
    if steps:
        v = np.round(v * steps) / steps
    v[r.random((ny, nx)) < holes] = np.nan
    return v


def surface_of(spark, v, down=True):
    row, col = np.indices(v.shape)
    y = (-10.0 if down else 10.0) * row + 500
    pdf = pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "x": col.ravel() * 20.0 + 1000, "y": y.ravel(), "value": v.ravel()})
    return spark.createDataFrame(pdf).repartition(3)


def share_above(a, b, c, d, t):
    """The share of a square, corners clockwise from the upper left, on the high side of the level's pieces."""
    v, up = [a, b, c, d], [x >= t for x in (a, b, c, d)]
    cut = lambda i, j: abs((t - v[i]) / (v[j] - v[i]))  # noqa: E731  from corner i towards j
    tri = lambda i: cut(i, (i + 1) % 4) * cut(i, (i - 1) % 4) / 2
    n = sum(up)
    if n in (0, 4):
        return n / 4
    if n == 1:
        return tri(up.index(True))
    if n == 3:
        return 1 - tri(up.index(False))
    ups = [i for i in range(4) if up[i]]
    if ups in ([0, 2], [1, 3]):
        return 1 - sum(tri(i) for i in range(4) if not up[i]) if sum(v) / 4 >= t else sum(tri(i) for i in ups)
    i, j = (3, 0) if ups == [0, 3] else ups
    return (cut(i, (i - 1) % 4) + cut(j, (j + 1) % 4)) / 2


def areas(v, edges):
    out = np.zeros(len(edges) - 1)
    for r in range(v.shape[0] - 1):
        for c in range(v.shape[1] - 1):
            q = (v[r, c], v[r, c + 1], v[r + 1, c + 1], v[r + 1, c])
            if np.isfinite(q).all():
                s = [1.0, *(share_above(*q, t) for t in edges[1:-1]), 0.0]
                out += 200.0 * -np.diff(s)
    return out


def polygons_of(df):
    return [(r.band, wkb.decode(r.geometry)[1], r.area) for r in df.collect()]


@pytest.mark.parametrize("seed,steps,down", [(1, None, True), (2, 2, True), (3, None, False), (4, 1, True)])
def test_bands_cover_what_single_squares_say(spark, seed, steps, down):
    v, levels = made(seed, steps=steps), [-1.0, 0.0, 0.5, 2.0]
    edges = [-math.inf, *levels, math.inf]
    got = polygons_of(contours.bands(surface_of(spark, v, down), levels, min_area=0.0, side=5, wider=2))
    want = areas(v, edges)
    for g, total in enumerate(want):
        assert sum(a for k, _, a in got if k == g) == pytest.approx(total, abs=1e-6)
    # outer rings turn left, holes right, and a hole lies in its outer ring
    for _, (shell, *holes), a in got:
        assert area(shell) * (1 if down else -1) > 0 and all(area(h) * area(shell) < 0 for h in holes)
        for h in holes:
            m = (h[:-1] + h[1:]) / 2
            assert inside(m[:, 0], m[:, 1], shell).mean() > 0.5
    # points are in one polygon, of the band that their square says
    r = np.random.default_rng(seed)
    px, py = r.uniform(1000, 1000 + 20 * (v.shape[1] - 1), 1500), r.uniform(0, v.shape[0] - 1, 1500)
    hit = np.zeros((len(edges) - 1, len(px)), int)
    y = 500 + (-10 if down else 10) * py
    for g, rings, _ in got:
        hit[g] += np.logical_xor.reduce([inside(px, y, k) for k in rings])
    rows, cols = py.astype(int), ((px - 1000) / 20).astype(int)
    corners = np.array([v[rows, cols], v[rows, cols + 1], v[rows + 1, cols + 1], v[rows + 1, cols]])
    whole = np.isfinite(corners).all(axis=0)
    assert (hit.sum(axis=0) == whole).all()
    low, high = np.digitize(corners.min(axis=0), levels), np.digitize(corners.max(axis=0), levels)
    sure = whole & (low == high)
    assert (hit[low[sure], np.flatnonzero(sure)] == 1).all()


def test_tiles_change_nothing(spark):
    v = made(7, 40, 33)
    plain = lambda df: sorted((b, round(a, 6), len(rings)) for b, rings, a in polygons_of(df))
    s = surface_of(spark, v)
    want = plain(contours.bands(s, [-0.5, 0.5], min_area=0.0))
    assert plain(contours.bands(s, [-0.5, 0.5], min_area=0.0, side=4, wider=2)) == want == plain(contours.bands(s, [-0.5, 0.5], min_area=0.0, side=7, wider=8))
    lines = lambda df: sorted((r.value, round(r.length, 6), r.is_index) for r in df.collect())
    assert lines(contours.lines(s, [-0.5, 0.5])) == lines(contours.lines(s, [-0.5, 0.5], side=4, wider=2))


def test_nested_rings_and_extremes(spark):
    row, col = np.indices((41, 41))
    v = np.cos(np.hypot(row - 20, col - 20) / 2.5)
    got = contours.bands(surface_of(spark, v), [-5.0, 0.0, 0.5, 9.0], side=8).collect()
    assert {(r.band, r.lower, r.upper, r.is_open_ended) for r in got} == {(0, v.min(), 0.0, True), (1, 0.0, 0.5, False), (2, 0.5, v.max(), True)}
    rings = {(r.band, len(wkb.decode(r.geometry)[1])) for r in got}
    assert (2, 2) in rings and (0, 2) in rings and (2, 1) in rings


def test_small_parts_go_and_flat_or_empty_surfaces(spark):
    v = np.zeros((9, 9))
    v[4, 4] = 1.0
    s = surface_of(spark, v)
    assert [(r.band, r.area) for r in contours.bands(s, [0.9]).collect()] == [(0, 8 * 8 * 200.0)]
    assert sorted((r.band, len(wkb.decode(r.geometry)[1])) for r in contours.bands(s, [0.9], min_area=0.0).collect()) == [(0, 2), (1, 1)]
    (flat,) = contours.bands(surface_of(spark, np.ones((3, 3))), [1.0, 2.0]).collect()
    assert (flat.band, flat.area, flat.is_open_ended) == (0, 800.0, True)
    with pytest.raises(LayerError):
        contours.bands(surface_of(spark, np.full((3, 3), np.nan)), [0.0])
    with pytest.raises(LayerError):
        contours.bands(s, [0.5], smoothing=0.9)


def test_lines_end_at_the_border_or_close(spark):
    v = np.add.outer(np.zeros(30), np.arange(30.0))
    v[10, 10] = np.nan
    (line, *rest) = sorted(contours.lines(surface_of(spark, v), [9.5, 14.5], side=6, wider=2).collect(), key=lambda r: r.length)
    assert [round(r.length) for r in (line, *rest)] == [90, 180, 290]  # the gap of the missing cell parts the first level


def test_chains_of_paths():
    s, e = np.array([5, 1, 9, 2, 7]), np.array([6, 2, 7, 1, 9])
    assert sorted(map(sorted, tracing.chains(s, e))) == [[0], [1, 3], [2, 4]]
    assert tracing.chains(np.array([3, 2, 1]), np.array([4, 3, 2])) == [[2, 1, 0]]
    assert tracing.chains(np.zeros(0, int), np.zeros(0, int)) == []
