"""Surfaces, contours, polygon work, and windows over events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import wkb
from ..layers import points, table
from ..operators import contours as C
from ..operators import faults
from ..operators import polygons as P
from ..operators import solvers as S
from ..operators.grids import Grid
from ..operators.variogram import Model, fit_auto
from ..streaming import windows
from .point_queries import CELLS, PAIRS, cells, control
from .spatial_queries import PTS

MODEL = Model("spherical", 0.0, 9e6, 12000.0)
GRID = Grid(0.0, 100000.0, 4000.0, 25, 25)


def _surface(s, d):
    """The plane x + 2 y on 25 x 25 nodes."""
    return cells(s, d).select(F.floor(F.col("cell_id") / 25).cast("int").alias("col"), (24 - F.pmod("cell_id", F.lit(25))).cast("int").alias("row"), "x", "y", (F.col("x") + 2 * F.col("y")).alias("value"))


def _cone(s, d):
    i = F.col("id")
    x, y = (F.pmod(i, F.lit(101)) - 50) * 10.0, (F.floor(i / 101) - 50) * -10.0
    return s.range(101 * 101).select(F.pmod(i, F.lit(101)).cast("int").alias("col"), F.floor(i / 101).cast("int").alias("row"), x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("value"))


def _squares(s, d):
    def run(batches):
        for b in batches:
            b["geometry"] = [wkb.encode("Polygon", [np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]])]) for x, y, w in zip(b["x"], b["y"], b["w"])]
            yield b[["id", "geometry"]]

    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("id"), F.pmod(k * 7919, F.lit(97)).cast("double").alias("x"), F.pmod(k * 104729, F.lit(89)).cast("double").alias("y"), (3.0 + k % 7).alias("w")).mapInPandas(run, "id long, geometry binary")


SQ = "sq AS (SELECT s_suppkey AS id, ((s_suppkey*7919)%97)::DOUBLE AS x, ((s_suppkey*104729)%89)::DOUBLE AS y, 3.0::DOUBLE + s_suppkey%7 AS w FROM supplier)"


def _pts(s, d):
    return points(s, d).select("id", wkb.points_to_wkb(F.col("x"), F.col("y")).alias("geometry"))


def _area(df, *names):
    return P.measures(df).select(*names, F.round("area", 4).alias("area"))


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _walls(s, d):
    """A wall between the columns of the grid south of each region's middle: region r's goes down beside column 5 r + 4."""
    r = F.col("r_regionkey")
    x = (r * 5 + 4) * 4000.0 + 4000.0
    return table(s, d, "region").where("r_regionkey < 4").select(r.alias("id"), x.alias("x1"), F.lit(-5000.0).alias("y1"), x.alias("x2"), F.lit(105000.0).alias("y2"))


def _faults(s, d):
    grid = GRID.cells(s).select("row", "col", "x", "y")
    return faults.compartments(grid, faults.blocked_links(grid, _walls(s, d), 4000.0), 25, side=8)


def _bent(s, d):
    """A surface over a roof: control of |x - 52000| with a breakline along its ridge, and the worst miss of it."""
    grid = GRID.cells(s).select("row", "col", "x", "y")
    ridge = table(s, d, "region").where("r_regionkey = 0").select(F.lit(1).alias("id"), F.lit(50000.0).alias("x1"), F.lit(-5000.0).alias("y1"), F.lit(50000.0).alias("x2"), F.lit(105000.0).alias("y2"))
    roof = lambda x: F.abs(x - 50000.0)
    near = control(s, d).where("x < 96000 AND y < 96000 AND x > 4000 AND y > 4000").withColumn("value", roof(F.col("x")))
    top = S.minimum_curvature(s, GRID, near, soft=faults.soft_links(grid, ridge, 4000.0)).join(grid, ["row", "col"])
    return top.agg((F.max(F.abs(F.col("value") - roof(F.col("x")))) < 1100).alias("close"))


QUERIES = {
    "kriging_ordinary": (lambda s, d: S.kriging(cells(s, d), control(s, d), MODEL, k=16), None),
    "kriging_local": (lambda s, d: S.local_kriging(cells(s, d), control(s, d), MODEL, 12), None),
    "kriging_simple": (lambda s, d: S.kriging(cells(s, d), control(s, d), MODEL, k=24, mean=4500.0, least=8), None),
    "kriging_universal": (lambda s, d: S.kriging(cells(s, d), control(s, d), MODEL, k=16, order=1), None),
    "kriging_block": (lambda s, d: S.kriging(cells(s, d), control(s, d), MODEL, k=16, block=4000.0), None),
    "cross_validation": (lambda s, d: S.cross_validate(control(s, d), MODEL, k=12), None),
    "regression_kriging": (lambda s, d: S.regression_kriging(cells(s, d), control(s, d), ["x", "y"], MODEL, k=12), None),
    "spline_tps": (lambda s, d: S.spline(cells(s, d), control(s, d), k=16), None),
    "spline_plane": (
        lambda s, d: S.spline(cells(s, d), control(s, d).withColumn("value", F.col("x") + 2 * F.col("y")), k=16).select("cell_id", F.round("value", 3).alias("value")),
        f"WITH {CELLS} SELECT cell_id, round(x + 2 * y, 3) AS value FROM cells",
    ),
    "min_curvature_breakline": (_bent, "SELECT count(*) > 0 AS close FROM region"),
    "min_curvature": (lambda s, d: S.minimum_curvature(s, GRID, control(s, d)), None),
    "variogram_fit": (
        lambda s, d: s.createDataFrame([(m.kind, m.nugget, m.sill, m.range) for m in [fit_auto(points(s, d), max_lag=20000.0)]], "kind string, nugget double, sill double, range double").select("kind", *[F.round(c, 2).alias(c) for c in ("nugget", "sill", "range")]),
        # every kind, range and nugget share that is tried, with the sill that fits best
        f"""{PAIRS}, g AS (SELECT avg(h) AS h, sum(dv)/(2*count(*)) AS gamma, count(*) / avg(h)^2 AS w FROM p GROUP BY floor(h/1000) HAVING count(*) >= 30), m AS (SELECT max(h) AS top FROM g),
        t AS (SELECT kind, share, top / 10 * 15.0::DOUBLE ^ (k / 15.0::DOUBLE) AS r FROM m, (SELECT unnest(['spherical', 'exponential', 'gaussian']) AS kind), (SELECT unnest(range(13)) * 0.075::DOUBLE AS share), (SELECT unnest(range(16)) AS k)),
        u AS (SELECT kind, share, r, w, gamma, share + (1 - share) * CASE kind WHEN 'exponential' THEN 1 - exp(-3 * h / r) WHEN 'gaussian' THEN 1 - exp(-3 * (h / r)^2) ELSE CASE WHEN h < r THEN 1.5 * h / r - 0.5 * (h / r)^3 ELSE 1 END END AS unit FROM g, t),
        f AS (SELECT kind, share, r, sum(w * unit * gamma) / sum(w * unit * unit) AS sill FROM u GROUP BY 1, 2, 3),
        e AS (SELECT f.kind, f.share, f.r, sill, sum(w * (gamma - sill * unit)^2) AS miss FROM f JOIN u ON u.kind = f.kind AND u.share = f.share AND u.r = f.r GROUP BY 1, 2, 3, 4)
        SELECT kind, round(share * sill, 2) AS nugget, round(sill, 2) AS sill, round(r, 2) AS range FROM e WHERE sill > 0 ORDER BY miss LIMIT 1""",
    ),
    "compartments": (
        _faults,
        "WITH w AS (SELECT r_regionkey * 5 + 5 AS c FROM region WHERE r_regionkey < 4), g AS (SELECT (range // 25)::INTEGER AS row, (range % 25)::INTEGER AS col FROM range(625)) SELECT row, col, coalesce((SELECT max(c) FROM w WHERE c <= col), 0)::BIGINT AS compartment FROM g",
    ),
    "compartment_control": (
        lambda s, d: faults.assign_compartments(_faults(s, d), control(s, d), GRID).groupBy("compartment").agg(F.count("*").alias("n")),
        f"WITH {PTS}, w AS (SELECT r_regionkey * 5 + 5 AS c FROM region WHERE r_regionkey < 4), p AS (SELECT floor(x / 4000)::INTEGER AS col, floor((100000 - y) / 4000)::INTEGER AS row FROM pts) SELECT CASE WHEN col < 25 AND row BETWEEN 0 AND 24 THEN coalesce((SELECT max(c) FROM w WHERE c <= col), 0) END::BIGINT AS compartment, count(*) AS n FROM p GROUP BY 1",
    ),
    "convex_hull": (
        lambda s, d: _area(P.convex_hull(_pts(s, d))),
        # the farthest points of 64 directions make a polygon of hull corners; what isn't strictly inside it may be one too, and of those
        # pairs that leave no other point on their right, and none of their line beyond them, are the hull's sides
        f"""WITH {PTS}, far AS (SELECT k, max_by(struct_pack(x := x, y := y), x * cos(2 * pi() * k / 64) + y * sin(2 * pi() * k / 64)) AS p FROM pts, (SELECT unnest(range(64)) AS k) GROUP BY k),
        ring AS (SELECT a.p.x AS x1, a.p.y AS y1, b.p.x AS x2, b.p.y AS y2 FROM far a JOIN far b ON b.k = (a.k + 1) % 64 WHERE a.p <> b.p),
        c AS (SELECT DISTINCT x, y FROM pts, ring WHERE (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) <= 0),
        sides AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a, c b, c o WHERE (a.x, a.y) <> (b.x, b.y) GROUP BY ALL
          HAVING min((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x)) >= 0
          AND max(CASE WHEN (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) = 0 THEN (o.x - a.x) * (o.x - b.x) + (o.y - a.y) * (o.y - b.y) END) <= 0)
        SELECT round(sum(x1 * y2 - x2 * y1) / 2, 4) AS area FROM sides""",
    ),
    "concave_hull": (lambda s, d: _area(P.concave_hull(_pts(s, d), 0.3)), None),
    "voronoi": (
        lambda s, d: _area(P.voronoi(points(s, d), np.array([[0.0, 0.0], [100080.0, 0.0], [100080.0, 100080.0], [0.0, 100080.0], [0.0, 0.0]]))).agg(F.count("*").alias("n"), F.round(F.sum("area") / 1e6, 3).alias("area")),
        "SELECT count(*) AS n, round(100080.0::DOUBLE * 100080 / 1e6, 3) AS area FROM customer",
    ),
    "point_buffer": (lambda s, d: _area(P.buffer(_pts(s, d), 100.0), "id"), "SELECT c_custkey AS id, round(16 * 10000 * sin(2 * pi() / 32), 4) AS area FROM customer"),
    "polygon_buffer": (lambda s, d: _area(P.buffer(_squares(s, d), 1.0), "id"), f"WITH {SQ} SELECT id, round(w*w + 4*w + 16 * sin(2 * pi() / 32), 4) AS area FROM sq"),
    "polygon_erode": (lambda s, d: _area(P.buffer(_squares(s, d), -2.0), "id"), f"WITH {SQ} SELECT id, round((w-4)*(w-4), 4) AS area FROM sq WHERE w > 4"),
    "polygon_clip": (
        lambda s, d: _area(P.clip_to_convex(_squares(s, d), np.array([[20.0, 10.0], [70.0, 10.0], [70.0, 60.0], [20.0, 60.0], [20.0, 10.0]])), "id").where("area > 0"),
        f"WITH {SQ} SELECT id, round((least(x+w, 70)-greatest(x, 20))*(least(y+w, 60)-greatest(y, 10)), 4) AS area FROM sq WHERE x < 70 AND x+w > 20 AND y < 60 AND y+w > 10",
    ),
    # two rounds of corners cut at a quarter leave 27/32 of a square
    "smooth": (lambda s, d: _area(P.smooth(_squares(s, d), 0.5), "id"), f"WITH {SQ} SELECT id, round(w * w * 27 / 32, 4) AS area FROM sq"),
    "simplify": (lambda s, d: _area(P.simplify(P.smooth(_squares(s, d), 0.5), 0.01), "id"), f"WITH {SQ} SELECT id, round(w * w * 27 / 32, 4) AS area FROM sq"),
    "split": (
        lambda s, d: P.measures(P.split(_squares(s, d), (0.0, 40.5), (100.0, 40.5))).groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum("area"), 4).alias("area")),
        f"WITH {SQ} SELECT id, CASE WHEN y < 40.5 AND y + w > 40.5 THEN 2 ELSE 1 END AS parts, round(w*w, 4) AS area FROM sq",
    ),
    "label_anchors": (
        lambda s, d: P.label_anchors(_squares(s, d)).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("clearance", 1).alias("clearance")),
        f"WITH {SQ} SELECT id, x + w/2 AS x, y + w/2 AS y, round(w/2, 1) AS clearance FROM sq",
    ),
    "combine_explode": (
        lambda s, d: P.explode(P.combine(_squares(s, d).withColumn("g", F.col("id") % 5), "g")).groupBy("g").agg(F.count("*").alias("n")),
        "SELECT s_suppkey % 5 AS g, count(*) AS n FROM supplier GROUP BY 1",
    ),
    "tumbling_windows": (lambda s, d: windows.tumbling(_events(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total")), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"),
    "sliding_windows": (
        lambda s, d: windows.sliding(_events(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n"),
        "SELECT day, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events UNION ALL SELECT strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') FROM events) GROUP BY 1",
    ),
    "session_windows": (
        lambda s, d: windows.sessions(_events(s, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n")),
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY 1",
    ),
}
