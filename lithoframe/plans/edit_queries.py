"""Vertex edits, tiles, trends and flags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import mvt
from ..functions import vertices as VX
from ..layers import points, table
from ..operators import trend
from ..operators.variogram import Model
from .spatial_queries import PTS, _tile_points, boxes

BOX4 = "bx AS (SELECT s_suppkey AS sid, ((s_suppkey*7919)%97)*1000.0::DOUBLE AS x0, ((s_suppkey*104729)%89)*1000.0::DOUBLE AS y0, ((s_suppkey*7919)%97)*1000.0::DOUBLE + 3000 + (s_suppkey%7)*1000.0 AS x1, ((s_suppkey*104729)%89)*1000.0::DOUBLE + 2000 + (s_suppkey%5)*1500.0 AS y1 FROM supplier)"


def _rings(s, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes(s, d).select("sid", F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin")).alias("ring"))


def _text(ring):
    return F.array_join(F.transform(ring, lambda v: F.concat_ws(" ", v["x"].cast("long").cast("string"), v["y"].cast("long").cast("string"))), ",").alias("ring")


def _sql(*pairs):
    return f"WITH {BOX4} SELECT sid, " + " || ',' || ".join(f"({x})::BIGINT || ' ' || ({y})::BIGINT" for x, y in pairs) + " AS ring FROM bx"


def _reml(s, d):
    rows = points(s, d).select("id", "x", "y", "v").toArrow().sort_by("id")
    x, y, v = (rows[c].to_numpy() for c in ("x", "y", "v"))
    m = trend.fit_reml(np.stack([x, y], axis=1), v - v.mean(), np.ones((len(v), 1)), Model("exponential", 1e6, 9e6, 15000.0), rounds=40)
    return s.createDataFrame([(m.kind, float(m.nugget), float(m.sill), float(m.range))], "kind string, nugget double, sill double, range double")


def _trend(s, d):
    theta = trend.linear(table(s, d, "part"), ["p_size"], "p_retailprice")
    return s.createDataFrame([(n, round(float(t), 4)) for n, t in zip(("b0", "b1"), theta)], "name string, value double")


QUERIES = {
    "vertex_insert": (lambda s, d: _rings(s, d).select("sid", _text(VX.insert_vertex(F.col("ring"), 1, F.lit(7.0), F.lit(8.0)))), _sql(("x0", "y0"), ("x1", "y0"), ("7", "8"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))),
    "vertex_remove": (lambda s, d: _rings(s, d).select("sid", _text(VX.remove_vertex(F.col("ring"), 0))), _sql(("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x1", "y0"))),
    "vertex_set": (lambda s, d: _rings(s, d).select("sid", _text(VX.set_vertex(F.col("ring"), 4, F.lit(7.0), F.lit(8.0)))), _sql(("7", "8"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("7", "8"))),
    "vertex_clean": (lambda s, d: _rings(s, d).select("sid", _text(VX.without_repeats(F.concat("ring", F.slice("ring", 1, 1))))), _sql(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))),
    "ring_length": (lambda s, d: _rings(s, d).select("sid", F.round(VX.length(F.col("ring")), 4).alias("length")), f"WITH {BOX4} SELECT sid, round(2*(x1-x0) + 2*(y1-y0), 4) AS length FROM bx"),
    "mvt_tile": (
        lambda s, d: mvt.render_points(_tile_points(s, d), 3, ["id"], "pts").groupBy().agg(F.count("*").alias("tiles"), F.sum("n").alias("features"), F.sum(F.octet_length("tile")).alias("bytes")),
        None,
    ),
    "trend_linear": (
        _trend,
        "SELECT 'b0' AS name, round(regr_intercept(p_retailprice, p_size), 4) AS value FROM part UNION ALL SELECT 'b1', round(regr_slope(p_retailprice, p_size), 4) FROM part",
    ),
    "trend_expression": (
        lambda s, d: points(s, d).select("id", F.round(trend.parse_expression("2*x^0.5 - log(y + 10)/3", {"x": F.col("x"), "y": F.col("y")}), 6).alias("t")),
        f"WITH {PTS} SELECT id, round(2*x^0.5::DOUBLE - ln(y + 10)/3, 6) AS t FROM pts",
    ),
    "variogram_reml": (_reml, None),
}
