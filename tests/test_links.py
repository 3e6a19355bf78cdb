"""Links of a grid that faults shut and breaklines soften."""

import numpy as np

from lithoframe.operators import faults, solvers


def test_a_soft_link_lets_the_surface_bend_but_not_break():
    n = 31
    r = np.random.default_rng(2)
    cells = r.uniform(0, n - 1, (160, 2))
    cells = cells[np.abs(cells[:, 0] - 15) > 3]  # nothing is known about the ridge itself
    z = np.abs(cells[:, 0] - 15.0)
    want = np.abs(np.arange(n) - 15.0)
    soft = {(row, 15, "e") for row in range(n)}
    bent, _ = solvers.minimum_curvature_array(n, n, cells, z, soft=soft, tolerance=1e-9)
    plain, _ = solvers.minimum_curvature_array(n, n, cells, z, tolerance=1e-9)
    torn, _ = solvers.minimum_curvature_array(n, n, cells, z, blocked={(row, 15, "e") for row in range(n)}, tolerance=1e-9)
    miss = lambda s: np.abs(s - want).max()
    assert miss(bent) < 0.05 < 0.5 < miss(plain)
    step = lambda s: np.abs(s[:, 16] - s[:, 15]).max()
    assert abs(step(bent) - 1) < 0.05 and abs(step(torn) - 1) < 0.5


def test_soft_links_are_those_that_the_line_crosses(spark):
    cells = spark.createDataFrame([(r, c, c * 10.0, -r * 10.0) for r in range(4) for c in range(4)], "row int, col int, x double, y double")
    line = spark.createDataFrame([(1, 14.0, 5.0, 16.0, -35.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(x) for x in faults.soft_links(cells, line, 10.0).select("row", "col", "way").collect()}
    assert got == {(r, 1, "e") for r in range(4)}


def flood(ny, nx, shut):
    label = {}
    for start in range(ny * nx):
        if start not in label:
            label[start], todo = start, [start]
            while todo:
                c = todo.pop()
                r, k = divmod(c, nx)
                near = [(c + 1, (r, k, "e"), k + 1 < nx), (c + nx, (r, k, "s"), r + 1 < ny), (c - 1, (r, k - 1, "e"), k > 0), (c - nx, (r - 1, k, "s"), r > 0)]
                for other, link, ok in near:
                    if ok and link not in shut and other not in label:
                        label[other] = start
                        todo.append(other)
    return label


def test_compartments_by_tiles_equal_a_flood(spark):
    r = np.random.default_rng(3)
    for share, side in ((0.35, 4), (0.55, 7), (0.5, 64)):
        ny, nx = 19, 23
        shut = {(i, j, w) for i in range(ny) for j in range(nx) for w in "es" if r.random() < share}
        cells = spark.createDataFrame([(i, j) for i in range(ny) for j in range(nx)], "row int, col int")
        got = faults.compartments(cells, spark.createDataFrame([(*k,) for k in shut], "row int, col int, way string"), nx, side).collect()
        assert {x.row * nx + x.col: x.compartment for x in got} == flood(ny, nx, shut)
