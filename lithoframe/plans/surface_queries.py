"""Surfaces gridded from customers: levels, lines, bands and labels, round numbers and scales of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import style
from ..layers import points, table, zones
from ..operators import clipping
from ..operators import contours as C
from ..operators import grids
from ..operators import statistics as ST
from ..scratch import fresh
from ..sources.grids import read_grid, write_grid
from .point_queries import MODEL, _breaks
from .spatial_queries import PTS, Z, _diamonds, _turned

#: Cells along the ground surface and their size; the bounds of the points lie inside.
SIDE, CELL = 8, 12515.0
LEVELS = [4200.0, 4500.0, 4800.0]
STOPS = [(0.0, "#0000ff"), (0.5, "#ffffff"), (1.0, "#ff0000")]


def ground(s, d):
    """(row, col, x, y, value): the mean account balance of each cell's customers, summed in cents so that it is the same in any
    order; cells without customers are missing."""
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    p = points(s, d).select(cell("x").alias("col"), (SIDE - 1 - cell("y")).alias("row"), F.round(F.col("v") * 100).cast("long").alias("cents"))
    mean = p.groupBy("row", "col").agg((F.sum("cents").cast("double") / F.count("*") / 100.0).alias("value"))
    return mean.select("row", "col", ((F.col("col") + 0.5) * CELL).alias("x"), ((SIDE - 0.5 - F.col("row")) * CELL).alias("y"), "value")


GROUND = f"""{PTS}, g AS (
  SELECT {SIDE - 1} - floor(y / {CELL})::INTEGER AS r, floor(x / {CELL})::INTEGER AS c, sum(round(v * 100)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS v FROM pts GROUP BY 1, 2
)"""
#: Squares of the surface with the parts of their sides at which each level crosses them.
SQUARES = f"""{GROUND}, lv AS (
  SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT unnest({LEVELS})::DOUBLE AS t) WHERE t > (SELECT min(v) FROM g) AND t < (SELECT max(v) FROM g)
), q AS (
  SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g c ON c.r = a.r + 1 AND c.c = a.c + 1 JOIN g d ON d.r = a.r + 1 AND d.c = a.c
), f AS (
  SELECT *, (a >= t)::INTEGER * 8 + (b >= t)::INTEGER * 4 + (c >= t)::INTEGER * 2 + (d >= t)::INTEGER AS k, (a + b + c + d) / 4 >= t AS high,
    (t - a) / (b - a) AS n, (t - b) / (c - b) AS e, (t - d) / (c - d) AS s, (t - a) / (d - a) AS w FROM q, lv
)"""
#: The share of a square above a level, and the length of the level's pieces in it.
ABOVE = """CASE k WHEN 15 THEN 1.0 WHEN 0 THEN 0.0 WHEN 8 THEN n*w/2 WHEN 4 THEN (1-n)*e/2 WHEN 2 THEN (1-s)*(1-e)/2 WHEN 1 THEN s*(1-w)/2
  WHEN 7 THEN 1 - n*w/2 WHEN 11 THEN 1 - (1-n)*e/2 WHEN 13 THEN 1 - (1-s)*(1-e)/2 WHEN 14 THEN 1 - s*(1-w)/2
  WHEN 12 THEN (w+e)/2 WHEN 3 THEN 1 - (w+e)/2 WHEN 9 THEN (n+s)/2 WHEN 6 THEN 1 - (n+s)/2
  WHEN 10 THEN CASE WHEN high THEN 1 - (1-n)*e/2 - s*(1-w)/2 ELSE n*w/2 + (1-s)*(1-e)/2 END
  ELSE CASE WHEN high THEN 1 - n*w/2 - (1-s)*(1-e)/2 ELSE (1-n)*e/2 + s*(1-w)/2 END END"""
PIECE = """CASE WHEN k IN (1, 14) THEN sqrt(s^2 + (1-w)^2) WHEN k IN (2, 13) THEN sqrt((1-s)^2 + (1-e)^2) WHEN k IN (4, 11) THEN sqrt((1-n)^2 + e^2) WHEN k IN (7, 8) THEN sqrt(n^2 + w^2)
  WHEN k IN (3, 12) THEN sqrt(1 + (w-e)^2) WHEN k IN (6, 9) THEN sqrt(1 + (n-s)^2)
  WHEN (k = 10) = high THEN sqrt((1-n)^2 + e^2) + sqrt(s^2 + (1-w)^2) ELSE sqrt(n^2 + w^2) + sqrt((1-s)^2 + (1-e)^2) END"""


def _cells(s, d):
    """The cells of a grid over the customers, 20,000 across, with the sum of their centres as value."""
    b = points(s, d).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    return grids.Grid.covering((b["a"], b["b"], b["c"], b["d"]), 20000.0).cells(s)


def _fine(s, d):
    """Two columns of 25 cells for each nation, side by side."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    cells = table(s, d, "nation").select(F.col("n_nationkey").alias("i"), upto(24).alias("j")).withColumn("k", upto(1))
    x = (F.col("i") * 2 + F.col("k")) * 2003.0 + 501.0
    return cells.select((F.col("i") * 1000 + F.col("j") * 10 + F.col("k")).alias("cell_id"), F.col("j").alias("row"), (F.col("i") * 2 + F.col("k")).alias("col"), x.alias("x"), (F.col("j") * 4001.0 + 7.0).alias("y"), (F.col("i") * 1.0 + F.col("j")).alias("value"))


FINE = "fine AS (SELECT a.n_nationkey * 1000 + b.n_nationkey * 10 + r_regionkey AS cell_id, (a.n_nationkey * 2 + r_regionkey) * 2003.0::DOUBLE + 501 AS x, b.n_nationkey * 4001.0::DOUBLE + 7 AS y, a.n_nationkey * 1.0::DOUBLE + b.n_nationkey AS value FROM nation a, nation b, region WHERE r_regionkey < 2)"


def _stored(s, d) -> str:
    """The ground surface at rest, in a fresh shared folder."""
    path = fresh(s, "grid")
    write_grid(ground(s, d), grids.Grid(0.0, SIDE * CELL, CELL, SIDE, SIDE), path, name="ground")
    return path


def _window(s, d):
    return read_grid(s, _stored(s, d), window=(20000.0, 10000.0, 70000.0, 90000.0))[0].select("row", "col", F.round("value", 6).alias("value"))


COVER = f"""{PTS}, m AS (SELECT min(x) AS a, min(y) AS b, ceil((max(x) - min(x)) / 20000)::BIGINT + 1 AS nx, ceil((max(y) - min(y)) / 20000)::BIGINT + 1 AS ny FROM pts), cell AS (
  SELECT i AS cell_id, (i // nx)::INTEGER AS row, (i % nx)::INTEGER AS col, a - 10000 + (i % nx + 0.5) * 20000.0::DOUBLE AS x, b + (ny - 0.5) * 20000.0::DOUBLE - (i // nx + 0.5) * 20000.0::DOUBLE AS y FROM (SELECT *, unnest(range(nx * ny)) AS i FROM m)
)"""
NICE_SQL = "p * CASE WHEN round(z / p, 12) <= 1 THEN 1 WHEN round(z / p, 12) <= 2 THEN 2 WHEN round(z / p, 12) <= 2.5 THEN 2.5 WHEN round(z / p, 12) <= 5 THEN 5 ELSE 10 END"

QUERIES = {
    "contour_lines": (
        lambda s, d: C.lines(ground(s, d), [t for t in LEVELS if t in _inside(s, d)]).groupBy("value", "is_index").agg(F.round(F.sum("length") / 1000, 3).alias("km")),
        f"WITH {SQUARES} SELECT t AS value, i % 5 = 0 AS is_index, round(sum({PIECE}) * {CELL} / 1000, 3) AS km FROM f WHERE k NOT IN (0, 15) GROUP BY 1, 2",
    ),
    "contour_bands": (
        lambda s, d: C.bands(ground(s, d), LEVELS, min_area=0.0).groupBy("band", "is_open_ended").agg(F.round(F.min("lower"), 4).alias("lower"), F.round(F.min("upper"), 4).alias("upper"), F.round(F.sum("area") / 1e6, 3).alias("km2")),
        f"""WITH {SQUARES}, over AS (SELECT t, i, sum({ABOVE}) AS share FROM f GROUP BY 1, 2),
        steps AS (SELECT t, i, share FROM over UNION ALL SELECT (SELECT min(v) FROM g), -1, (SELECT count(*) FROM q)::DOUBLE UNION ALL SELECT (SELECT max(v) FROM g), (SELECT count(*) FROM lv), 0.0),
        b AS (SELECT i + 1 AS band, t AS lower, lead(t) OVER (ORDER BY i) AS upper, share - lead(share) OVER (ORDER BY i) AS share FROM steps)
        SELECT band::INTEGER AS band, band = 0 OR band = (SELECT count(*) FROM lv) AS is_open_ended, round(lower, 4) AS lower, round(upper, 4) AS upper, round(share * {CELL} * {CELL} / 1e6, 3) AS km2 FROM b WHERE share > 0""",
    ),
    "contour_labels": (
        lambda s, d: C.label(C.lines(ground(s, d), LEVELS), 3000.0, 30000.0).select("value", "kind", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("bearing", 2).alias("bearing")),
        None,
    ),
    "contour_auto_levels": (
        lambda s, d: s.createDataFrame([(v,) for v in C.levels_of(ground(s, d))], "level double").select(F.round("level", 6).alias("level")),
        f"""WITH {GROUND}, m AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 12 AS want FROM g),
        st AS (SELECT lo, hi, m * 10.0::DOUBLE ^ (floor(log10(want)) + e) AS step, want FROM m, (SELECT unnest([1.0, 2.0, 2.5, 5.0, 10.0])::DOUBLE AS m), (SELECT unnest([-1, 0, 1]) AS e)),
        one AS (SELECT * FROM st ORDER BY abs(ln(step / want)), step LIMIT 1)
        SELECT round(k * step, 6) AS level FROM (SELECT *, unnest(range(floor(lo / step)::BIGINT + 1, ceil(hi / step)::BIGINT)) AS k FROM one) WHERE k * step > lo AND k * step < hi""",
    ),
    "clip_grid_box": (
        lambda s, d: grids.clip_to_box(ground(s, d), (20000.0, 10000.0, 70000.0, 90000.0)).select("row", "col", F.round("value", 6).alias("value")),
        f"WITH {GROUND} SELECT r AS row, c AS col, CASE WHEN (c + 0.5) * {CELL} BETWEEN 20000 AND 70000 AND ({SIDE - 0.5} - r) * {CELL} BETWEEN 10000 AND 90000 THEN round(v, 6) END AS value FROM g",
    ),
    "clip_polygons": (
        lambda s, d: clipping.clip_to_polygons(_turned(_fine(s, d)), _diamonds(zones(s, d).where("zid % 2 = 1"), "zid")).select("cell_id", "value"),
        f"WITH {FINE}, {Z} SELECT cell_id, CASE WHEN EXISTS (SELECT 1 FROM zones WHERE zid % 2 = 1 AND x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax) THEN value END AS value FROM fine",
    ),
    "clip_polygons_invert": (
        lambda s, d: clipping.clip_to_polygons(_turned(_fine(s, d)), _diamonds(zones(s, d).where("zid % 2 = 1"), "zid"), invert=True).agg(F.count("value").alias("n"), F.sum("value").alias("total")),
        f"WITH {FINE}, {Z} SELECT count(*) AS n, sum(value) AS total FROM fine WHERE NOT EXISTS (SELECT 1 FROM zones WHERE zid % 2 = 1 AND x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax)",
    ),
    "control_supported": (
        lambda s, d: clipping.supported(_fine(s, d), points(s, d), 2500.0).select("cell_id", "supported"),
        f"WITH {PTS}, {FINE} SELECT cell_id, EXISTS (SELECT 1 FROM pts p WHERE (p.x - f.x)^2 + (p.y - f.y)^2 <= 6250000) AS supported FROM fine f",
    ),
    "grid_window": (
        _window,
        f"WITH {GROUND} SELECT r AS row, c AS col, round(v, 6) AS value FROM g WHERE (c + 0.5) * {CELL} BETWEEN 20000 AND 70000 AND ({SIDE - 0.5} - r) * {CELL} BETWEEN 10000 AND 90000",
    ),
    "grid_round_trip": (
        lambda s, d: read_grid(s, _stored(s, d), level=0)[0].groupBy().agg(F.count("*").alias("cells"), F.round(F.avg("value"), 6).alias("mean")),
        f"WITH {GROUND} SELECT count(*) AS cells, round(avg(v), 6) AS mean FROM g",
    ),
    "grid_cells": (_cells, f"WITH {COVER} SELECT * FROM cell"),
    "nice_cell_size": (
        lambda s, d: points(s, d).groupBy("nk").agg(((F.max("x") - F.min("x") + 1) / grids.ACROSS).alias("z")).select("nk", G.nice_at_least(F.col("z")).alias("size")),
        f"WITH {PTS}, z AS (SELECT nk, (max(x) - min(x) + 1) / 200 AS z FROM pts GROUP BY nk), p AS (SELECT *, 10.0::DOUBLE ^ floor(log10(z)) AS p FROM z) SELECT nk, {NICE_SQL} AS size FROM p",
    ),
    "pretty_breaks": (
        lambda s, d: _breaks(s, ST.classify(points(s, d), "v", "pretty", 6)),
        f"""WITH {PTS}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM pts), st AS (SELECT lo, hi, m * 10.0::DOUBLE ^ e AS step FROM m, (SELECT unnest([1.0, 2.0, 2.5, 5.0])::DOUBLE AS m), (SELECT unnest(range(-2, 6)) AS e)),
        one AS (SELECT * FROM st WHERE (ceil(hi / step) - floor(lo / step))::BIGINT - 1 = 5 ORDER BY step DESC LIMIT 1)
        SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS i, round(k * step, 4) AS b FROM (SELECT step, unnest(range(floor(lo / step)::BIGINT + 1, ceil(hi / step)::BIGINT)) AS k FROM one)""",
    ),
    "color_ramp": (
        lambda s, d: table(s, d, "customer").select(style.colour_column(STOPS, F.floor((F.col("c_acctbal") + 1000) / 1100) / 10.0).alias("colour")).groupBy("colour").agg(F.count("*").alias("n")),
        """WITH k AS (SELECT floor((c_acctbal + 1000) / 1100) AS k FROM customer), rgb AS (SELECT CASE WHEN k <= 5 THEN [k/5.0*255, k/5.0*255, 255] ELSE [255, (2-k/5.0)*255, (2-k/5.0)*255] END AS rgb FROM k)
        SELECT '#' || list_aggregate(list_transform(rgb, lambda c: lpad(lower(to_hex(floor(c + 0.5)::INTEGER)), 2, '0')), 'string_agg', '') AS colour, count(*) AS n FROM rgb GROUP BY 1""",
    ),
    "scale_bar": (
        lambda s, d: table(s, d, "customer").select((F.lit(25.0) + F.pmod("c_nationkey", F.lit(25))).alias("lat"), F.pmod("c_custkey", F.lit(19)).cast("double").alias("zoom")).groupBy("lat", "zoom").agg(F.count("*").alias("n")).select("lat", "zoom", "n", G.scale_bar(F.col("lat"), F.col("zoom"), 120.0).alias("b")).select("lat", "zoom", "n", "b.distance", F.round("b.width_px", 4).alias("width_px")),
        """WITH k AS (SELECT 25.0::DOUBLE + c_nationkey % 25 AS lat, (c_custkey % 19)::DOUBLE AS zoom, count(*) AS n FROM customer GROUP BY 1, 2),
        m AS (SELECT *, 2*pi()*6378137.0::DOUBLE*cos(radians(lat))/(512*2.0::DOUBLE^zoom) AS per FROM k), p AS (SELECT *, 10.0::DOUBLE^floor(log10(per*120)) AS p FROM m), q AS (SELECT *, p * CASE WHEN per*120/p >= 5 THEN 5 WHEN per*120/p >= 2 THEN 2 ELSE 1 END AS distance FROM p)
        SELECT lat, zoom, n, distance, round(distance/per, 4) AS width_px FROM q""",
    ),
    "variogram_model_eval": (
        lambda s, d: points(s, d).select("id", F.round(MODEL.gamma_column(F.col("x") / 7.0), 8).alias("gamma")),
        f"WITH {PTS} SELECT id, round(CASE WHEN x = 0 THEN 0 WHEN x / 7 / 9000 < 1 THEN 0.2 + 1.3 * (1.5 * (x/7/9000) - 0.5 * (x/7/9000)^3) ELSE 1.5 END, 8)::DOUBLE AS gamma FROM pts",
    ),
}


def _inside(s, d) -> set[float]:
    """The levels that the surface reaches; lines() numbers its index lines among the levels it is given."""
    r = ground(s, d).agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    return {t for t in LEVELS if r["a"] < t < r["b"]}
