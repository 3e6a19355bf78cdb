"""Spatial joins, overlay, binning, zonal statistics, clustering keys and tiles over customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import wkb
from ..functions.projections import reproject
from ..layers import in_frame, points, table, zones
from ..operators import aggregate as A
from ..operators import overlay as O
from ..operators import relations as Q
from ..operators import spatial as S
from ..operators import topology

PTS = "pts AS (SELECT c_custkey AS id, ((c_custkey*7919)%10007)*10.0::DOUBLE AS x, ((c_custkey*104729)%10009)*10.0::DOUBLE AS y, c_acctbal AS v, c_nationkey AS nk, c_mktsegment AS seg FROM customer)"


def zones_sql(side: str = "20018.0", name: str = "zones") -> str:
    return f"{name} AS (SELECT n_nationkey AS zid, n_regionkey AS rk, (n_nationkey%5)*{side}::DOUBLE AS xmin, floor(n_nationkey/5.0)*{side}::DOUBLE AS ymin, (n_nationkey%5)*{side}::DOUBLE + {side}::DOUBLE AS xmax, floor(n_nationkey/5.0)*{side}::DOUBLE + {side}::DOUBLE AS ymax FROM nation)"


Z = zones_sql()
BOX = "bx AS (SELECT s_suppkey AS sid, ((s_suppkey*7919)%97)*1000.0::DOUBLE AS xmin, ((s_suppkey*104729)%89)*1000.0::DOUBLE AS ymin, ((s_suppkey*7919)%97)*1000.0::DOUBLE + 3000 + (s_suppkey%7)*1000.0 AS xmax, ((s_suppkey*104729)%89)*1000.0::DOUBLE + 2000 + (s_suppkey%5)*1500.0 AS ymax, s_acctbal AS bal FROM supplier)"
STATS = [A.Stat("count", "n"), A.Stat("mean", "v_mean", "v"), A.Stat("min", "v_min", "v"), A.Stat("max", "v_max", "v"), A.Stat("sum", "v_sum", "v")]
MASK = (15000.0, 25000.0, 61000.0, 70000.0)


def boxes(spark, d):
    k = F.col("s_suppkey")
    x, y = F.pmod(k * 7919, F.lit(97)) * 1000.0, F.pmod(k * 104729, F.lit(89)) * 1000.0
    return table(spark, d, "supplier").select(k.alias("sid"), x.alias("xmin"), y.alias("ymin"), (x + 3000 + (k % 7) * 1000.0).alias("xmax"), (y + 2000 + (k % 5) * 1500.0).alias("ymax"), F.col("s_acctbal").alias("bal"))


def _r(df, *names, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _zone_pairs(predicate, spark, d, cell=None):
    return S.pairs(boxes(spark, d), zones(spark, d, 20000.0), predicate, cell=cell).select("sid", "zid")


def _sql_pairs(condition):
    return f"WITH {BOX}, {zones_sql('20000.0', 'z')} SELECT sid, zid FROM bx a JOIN z b ON {condition}"


MEET = "a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"
INNER = "a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"
HOLDS = "a.xmin <= b.xmin AND a.xmax >= b.xmax AND a.ymin <= b.ymin AND a.ymax >= b.ymax"
HELD = "b.xmin <= a.xmin AND b.xmax >= a.xmax AND b.ymin <= a.ymin AND b.ymax >= a.ymax"


def _tile_points(spark, d):
    lon, lat = F.col("x") / 100060 * 300 - 150, F.col("y") / 100080 * 140 - 70
    p = points(spark, d).select("id", lon.alias("lon"), lat.alias("lat"))
    mx, my = G.to_mercator(F.col("lon"), F.col("lat"))
    return p.withColumns({"mx": mx, "my": my})


TILE = "t AS (SELECT id, radians(x / 100060 * 300 - 150) * 6378137.0::DOUBLE AS mx, ln(tan(radians(y / 100080 * 140 - 70) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS my FROM pts)"


def _diamonds(boxes, *names):
    """Boxes turned by 45 degrees, with half their area, as polygons: corners (u, v) at ((u + v) / 2, (u - v) / 2)."""
    corners = [("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin")]
    flat = F.array(*[e for u, v in corners for e in ((F.col(u) + F.col(v)) / 2, (F.col(u) - F.col(v)) / 2)])

    @F.pandas_udf("binary")
    def shape(xy):
        return xy.map(lambda a: wkb.encode("Polygon", [a.reshape(5, 2)]))

    return boxes.select(*names, shape(flat).alias("geometry"))


def _turned(pts):
    """Points turned as _diamonds turns boxes."""
    return pts.withColumns({"x": (F.col("x") + F.col("y")) / 2, "y": (F.col("x") - F.col("y")) / 2})


def _shape_pairs(predicate, s, d):
    return Q.spatial_join_shapes(_diamonds(boxes(s, d), "sid"), _diamonds(zones(s, d, 20000.0), "zid"), predicate).select("sid", "zid")


def _area(layer):
    from ..operators.polygons import area

    @F.pandas_udf("double")
    def measured(g):
        return g.map(lambda b: float(sum(area(r) for r in O.rings_of(*wkb.decode(b)))))

    return layer.withColumn("area", F.round(measured("geometry"), 2))


def _lon_lat(spark, d):
    return in_frame(points(spark, d).select("id", (F.col("x") / 100060 * 3 - 102).alias("x"), (F.col("y") / 100080 * 3 + 29.5).alias("y")), 4326)


def _conic_sql() -> str:
    """Lambert's conic of the Texas Central zone in its classical form, by powers and tangents."""
    t = lambda v: f"(tan(pi() / 4 - ({v}) / 2) / pow((1 - e * sin({v})) / (1 + e * sin({v})), e / 2))"
    w = lambda v: f"(cos({v}) / sqrt(1 - e * e * sin({v}) * sin({v})))"
    one, two, origin = (f"radians({d}::DOUBLE + {m}::DOUBLE / 60)" for d, m in ((31, 53), (30, 7), (29, 40)))
    return f"""WITH {PTS}, p AS (SELECT id, radians(x / 100060 * 3 - 102) AS lon, radians(y / 100080 * 3 + 29.5::DOUBLE) AS lat FROM pts),
k AS (SELECT sqrt((2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE) AS e),
c AS (SELECT e, ln({w(one)} / {w(two)}) / ln({t(one)} / {t(two)}) AS n FROM k),
q AS (SELECT e, n, 6378137 * {w(one)} / (n * pow({t(one)}, n)) AS f FROM c),
r AS (SELECT id, f * pow({t('lat')}, n) AS r, f * pow({t(origin)}, n) AS r0, n * (lon + radians(100 + 20::DOUBLE / 60)) AS turn FROM p, q)
SELECT id, round((700000 + r * sin(turn)) * 3937 / 1200, 3) AS x, round((3000000 + r0 - r * cos(turn)) * 3937 / 1200, 3) AS y FROM r"""


STATE_PLANE_SQL = _conic_sql()


def _hilbert(spark, d, order=8):
    return points(spark, d).select("id", G.hilbert_index(F.col("x"), F.col("y"), (0.0, 0.0, 100060.0, 100080.0), order).alias("h"))


HILBERT = f"""WITH RECURSIVE {PTS}, c AS (SELECT id, greatest(0, least(255, floor(x / 100060.0::DOUBLE * 255)))::BIGINT AS x, greatest(0, least(255, floor(y / 100080.0::DOUBLE * 255)))::BIGINT AS y FROM pts),
w(id, x, y, d, b) AS (SELECT id, x, y, 0::BIGINT, 7 FROM c UNION ALL
 SELECT id, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 255 - y ELSE y END ELSE x END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 255 - x ELSE x END ELSE y END,
  d + (1::BIGINT << b) * (1::BIGINT << b) * xor(3 * rx, ry), b - 1 FROM (SELECT *, (x >> b) & 1 AS rx, (y >> b) & 1 AS ry FROM w WHERE b >= 0))
SELECT id, d AS h FROM w WHERE b = -1"""

QUERIES = {
    "zone_summary": (
        lambda s, d: _r(A.summarize_within(zones(s, d), points(s, d), STATS), "v_mean", "v_sum").drop("xmin", "ymin", "xmax", "ymax"),
        f"WITH {PTS}, {Z} SELECT zid, rk, count(id) AS n, round(avg(v), 4) AS v_mean, min(v) AS v_min, max(v) AS v_max, round(sum(v), 4) AS v_sum FROM zones LEFT JOIN pts ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY zid, rk",
    ),
    "zone_summary_shared_edges": (
        lambda s, d: A.summarize_within(zones(s, d, 20020.0), points(s, d), [A.Stat("count", "n")]).select("zid", "n"),
        f"WITH {PTS}, {zones_sql('20020.0')} SELECT zid, count(id) AS n FROM zones LEFT JOIN pts ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY zid",
    ),
    "zone_summary_empty": (
        lambda s, d: _r(A.summarize_within(zones(s, d).withColumns({"xmin": F.when(F.col("zid") == 3, 9e6).otherwise(F.col("xmin")), "xmax": F.when(F.col("zid") == 3, 9.1e6).otherwise(F.col("xmax"))}), points(s, d), STATS[:2]), "v_mean").select("zid", "n", "v_mean"),
        f"WITH {PTS}, {Z} SELECT zid, count(id) AS n, round(avg(v), 4) AS v_mean FROM zones LEFT JOIN pts ON zid <> 3 AND x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY zid",
    ),
    "square_bin": (
        lambda s, d: A.aggregate_points(points(s, d), 5000.0, [A.Stat("count", "n")]),
        f"WITH {PTS} SELECT floor(x/5000)::BIGINT AS kx, floor(y/5000)::BIGINT AS ky, count(*) AS n, (floor(x/5000) + 0.5) * 5000 AS cx, (floor(y/5000) + 0.5) * 5000 AS cy FROM pts GROUP BY ALL",
    ),
    "square_bin_stats": (
        lambda s, d: _r(A.aggregate_points(points(s, d), 10000.0, STATS), "v_mean", "v_sum", digits=7).drop("cx", "cy"),
        f"WITH {PTS} SELECT floor(x/10000)::BIGINT AS kx, floor(y/10000)::BIGINT AS ky, count(*) AS n, round(avg(v), 7) AS v_mean, min(v) AS v_min, max(v) AS v_max, round(sum(v), 7) AS v_sum FROM pts GROUP BY ALL",
    ),
    "hexbin": (
        lambda s, d: _r(A.hexbin(points(s, d), 4000.0, [A.Stat("count", "n"), A.Stat("mean", "v_mean", "v")]), "v_mean", "cx", "cy"),
        f"""WITH {PTS}, k AS (SELECT *, round_even(x/4000.0::DOUBLE, 0) AS ec, round_even(y/(4000.0::DOUBLE*sqrt(3.0)), 0) AS er, round_even((x-2000.0::DOUBLE)/4000.0::DOUBLE, 0) AS oc, round_even((y-4000.0::DOUBLE*sqrt(3.0)/2)/(4000.0::DOUBLE*sqrt(3.0)), 0) AS orow FROM pts),
        dd AS (SELECT *, (x-ec*4000.0::DOUBLE)^2 + (y-er*4000.0::DOUBLE*sqrt(3.0))^2 AS de, (x-oc*4000.0::DOUBLE-2000)^2 + (y-orow*4000.0::DOUBLE*sqrt(3.0)-4000.0::DOUBLE*sqrt(3.0)/2)^2 AS do_ FROM k)
        SELECT (CASE WHEN de <= do_ THEN 2*ec ELSE 2*oc+1 END)::BIGINT AS kx, (CASE WHEN de <= do_ THEN er ELSE orow END)::BIGINT AS ky, count(*) AS n, round(avg(v), 4) AS v_mean,
        round(min(CASE WHEN de <= do_ THEN ec*4000 ELSE oc*4000+2000 END), 4) AS cx, round(min(CASE WHEN de <= do_ THEN er*4000.0::DOUBLE*sqrt(3.0) ELSE orow*4000.0::DOUBLE*sqrt(3.0)+4000.0::DOUBLE*sqrt(3.0)/2 END), 4) AS cy FROM dd GROUP BY 1, 2""",
    ),
    "spatial_join_inner": (
        lambda s, d: S.spatial_join(S.as_boxes(points(s, d)), zones(s, d), "intersects", transfer=["zid", "rk"]).select("id", "zid", "rk"),
        f"WITH {PTS}, {Z} SELECT id, zid, rk FROM pts JOIN zones ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax",
    ),
    "spatial_join_left": (
        lambda s, d: S.spatial_join(S.as_boxes(points(s, d)), zones(s, d).where("zid % 3 = 0").withColumn("v", F.col("zid") * 1.0), "intersects", how="left", transfer=["zid", "v"]).select("id", "zid", "v", "right_v"),
        f"WITH {PTS}, {Z} SELECT id, zid, v, zid * 1.0::DOUBLE AS right_v FROM pts LEFT JOIN zones ON zid % 3 = 0 AND x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax",
    ),
    "spatial_join_blocked": (
        lambda s, d: S.pairs(boxes(s, d), boxes(s, d).withColumnsRenamed({"sid": "other", "bal": "other_bal"}), "overlaps", cell=7000.0).select("sid", "other"),
        f"WITH {BOX} SELECT a.sid, b.sid AS other FROM bx a JOIN bx b ON {INNER} AND NOT ({HOLDS}) AND NOT ({HELD})",
    ),
    "spatial_join_intersects": (lambda s, d: _zone_pairs("intersects", s, d, 20000.0), _sql_pairs(MEET)),
    "spatial_join_within": (lambda s, d: _zone_pairs("within", s, d), _sql_pairs(f"{HELD} AND {INNER}")),
    "spatial_join_contains": (lambda s, d: S.pairs(zones(s, d, 20000.0), boxes(s, d), "contains").select("sid", "zid"), _sql_pairs(f"{HELD} AND {INNER}")),
    "spatial_join_touches": (lambda s, d: _zone_pairs("touches", s, d), _sql_pairs(f"{MEET} AND NOT ({INNER})")),
    "spatial_join_overlaps": (lambda s, d: _zone_pairs("overlaps", s, d), _sql_pairs(f"{INNER} AND NOT ({HOLDS}) AND NOT ({HELD})")),
    "spatial_join_crosses": (lambda s, d: _zone_pairs("crosses", s, d), _sql_pairs("false")),
    "box_intersect": (
        lambda s, d: S.intersect(boxes(s, d), zones(s, d)).select("sid", "zid", "rk", "bal", *G.SIDES),
        f"WITH {BOX}, {Z} SELECT sid, zid, rk, bal, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax FROM bx a JOIN zones b ON {INNER}",
    ),
    "polygon_intersect": (
        lambda s, d: _area(O.intersect_polygons(_diamonds(boxes(s, d), "sid"), _diamonds(zones(s, d), "zid", "rk"))).select("sid", F.col("right_zid").alias("zid"), F.col("right_rk").alias("rk"), "area"),
        f"WITH {BOX}, {Z} SELECT sid, zid, rk, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) / 2, 2) AS area FROM bx a JOIN zones b ON {INNER}",
    ),
    "polygon_erase": (
        lambda s, d: _area(O.erase_polygons(_diamonds(boxes(s, d), "sid"), _diamonds(zones(s, d).where("zid % 2 = 0"), "zid"))).select("sid", "area"),
        # zones do not overlap, so what they take adds up
        f"""WITH {BOX}, {Z}, t AS (SELECT sid, any_value((a.xmax-a.xmin)*(a.ymax-a.ymin)) - sum(greatest(0, least(a.xmax, b.xmax)-greatest(a.xmin, b.xmin))*greatest(0, least(a.ymax, b.ymax)-greatest(a.ymin, b.ymin))) AS left_over
        FROM bx a, zones b WHERE zid % 2 = 0 GROUP BY sid) SELECT sid, round(left_over / 2, 2) AS area FROM t WHERE left_over > 0.001""",
    ),
    "polygon_dissolve": (
        lambda s, d: _area(O.dissolve_polygons(_diamonds(boxes(s, d), "sid").withColumn("g", F.col("sid") % 6), "g")).select("g", "area"),
        # the boxes' edges stand on multiples of 1000 and 500, so cells of that size are covered whole or not at all
        f"""WITH {BOX}, c AS (SELECT x, y FROM (SELECT unnest(range(110)) * 1000.0::DOUBLE AS x), (SELECT unnest(range(210)) * 500.0::DOUBLE AS y))
        SELECT sid % 6 AS g, count(DISTINCT x * 1000 + y / 500)::DOUBLE * 250000 AS area FROM bx JOIN c ON xmin <= x AND xmax >= x + 1000 AND ymin <= y AND ymax >= y + 500 GROUP BY 1""",
    ),
    "polygon_union": (
        lambda s, d: _area(O.union_polygons(_diamonds(boxes(s, d).where("sid % 4 = 0"), "sid"), _diamonds(zones(s, d).where("zid % 2 = 0"), "zid"))).groupBy("sid").agg(F.round(F.sum("area"), 1).alias("area")).where("sid IS NOT NULL"),
        # whatever meets it, a supplier's box is all there: what it shares with zones, which do not overlap, and the rest
        f"WITH {BOX} SELECT sid, round((xmax - xmin) * (ymax - ymin) / 2, 1) AS area FROM bx WHERE sid % 4 = 0",
    ),
    "polygon_join_points": (
        lambda s, d: Q.spatial_join_shapes(_turned(points(s, d)), _diamonds(zones(s, d), "zid", "rk"), "intersects").select("id", "zid", "rk"),
        f"WITH {PTS}, {Z} SELECT id, zid, rk FROM pts JOIN zones ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax",
    ),
    "polygon_join_within": (
        lambda s, d: Q.spatial_join_shapes(_turned(points(s, d)), _diamonds(zones(s, d, 20020.0).where("zid % 3 = 0"), "zid"), "within", how="left").select("id", "zid"),
        f"WITH {PTS}, {zones_sql('20020.0')} SELECT id, zid FROM pts LEFT JOIN zones ON zid % 3 = 0 AND x > xmin AND x < xmax AND y > ymin AND y < ymax",
    ),
    "polygon_join_overlaps": (lambda s, d: _shape_pairs("overlaps", s, d), _sql_pairs(f"{INNER} AND NOT ({HOLDS}) AND NOT ({HELD})")),
    "polygon_join_touches": (lambda s, d: _shape_pairs("touches", s, d), _sql_pairs(f"{MEET} AND NOT ({INNER})")),
    "polygon_join_contains": (
        lambda s, d: Q.spatial_join_shapes(_diamonds(zones(s, d, 20000.0), "zid"), _diamonds(boxes(s, d), "sid"), "contains").select("sid", "zid"),
        _sql_pairs(f"{HELD} AND {INNER}"),
    ),
    "polygon_summary": (
        lambda s, d: _r(A.aggregate("summarize_within", [_diamonds(zones(s, d, 20020.0), "zid"), _turned(points(s, d))], STATS[:2]), "v_mean").select("zid", "n", "v_mean"),
        f"WITH {PTS}, {zones_sql('20020.0')} SELECT zid, count(id) AS n, round(avg(v), 4) AS v_mean FROM zones LEFT JOIN pts ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY zid",
    ),
    "topology_warnings": (
        lambda s, d: topology.shared_warnings(_diamonds(zones(s, d), "zid")).select("zid", "shared_vertices", "neighbours"),
        f"""WITH {Z}, c AS (SELECT zid, unnest([xmin, xmin, xmax, xmax]) AS x, unnest([ymin, ymax, ymin, ymax]) AS y FROM zones), p AS (SELECT a.zid, b.zid AS other, a.x, a.y FROM c a JOIN c b ON a.x = b.x AND a.y = b.y AND a.zid <> b.zid)
        SELECT zid, count(DISTINCT (x, y)) AS shared_vertices, count(DISTINCT other) AS neighbours FROM p GROUP BY zid""",
    ),
    "simplify_shared": (
        lambda s, d: _area(topology.simplify_shared(_diamonds(zones(s, d), "zid"), 5000.0)).select("zid", "area"),
        f"WITH {Z} SELECT zid, round((xmax - xmin) * (ymax - ymin) / 2, 2) AS area FROM zones",
    ),
    "box_clip": (
        lambda s, d: S.clip(boxes(s, d), MASK).select("sid", *G.SIDES),
        f"WITH {BOX} SELECT sid, greatest(xmin, 15000) AS xmin, greatest(ymin, 25000) AS ymin, least(xmax, 61000) AS xmax, least(ymax, 70000) AS ymax FROM bx WHERE xmin < 61000 AND xmax > 15000 AND ymin < 70000 AND ymax > 25000",
    ),
    "box_erase": (
        lambda s, d: S.erase(boxes(s, d), MASK).groupBy("sid").agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area")),
        f"WITH {BOX} SELECT sid, a - i AS area FROM (SELECT sid, (xmax-xmin)*(ymax-ymin) AS a, greatest(0, least(xmax, 61000)-greatest(xmin, 15000))*greatest(0, least(ymax, 70000)-greatest(ymin, 25000)) AS i FROM bx) WHERE a > i",
    ),
    "points_erase": (
        lambda s, d: S.erase_points(points(s, d), boxes(s, d)).select("id"),
        f"WITH {PTS}, {BOX} SELECT id FROM pts WHERE NOT EXISTS (SELECT 1 FROM bx WHERE x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax)",
    ),
    "box_union": (
        lambda s, d: S.union_layers(boxes(s, d), zones(s, d)).groupBy("part").agg(F.round(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), 2).alias("area")),
        # the boxes' edges stand on multiples of 1000 and 500, so cells of that size are covered whole or not at all; zones fill a square
        f"""WITH {BOX}, {Z}, i AS (SELECT sum(greatest(0, least(a.xmax, b.xmax)-greatest(a.xmin, b.xmin))*greatest(0, least(a.ymax, b.ymax)-greatest(a.ymin, b.ymin))) AS i FROM bx a, zones b),
        c AS (SELECT x, y FROM (SELECT unnest(range(110)) * 1000.0::DOUBLE AS x), (SELECT unnest(range(210)) * 500.0::DOUBLE AS y) WHERE EXISTS (SELECT 1 FROM bx WHERE xmin <= x AND xmax >= x + 1000 AND ymin <= y AND ymax >= y + 500)),
        u AS (SELECT sum(greatest(0, least(x + 1000, e) - x) * greatest(0, least(y + 500, e) - y)) AS u FROM c, (SELECT max(xmax) AS e FROM zones))
        SELECT * FROM (SELECT 'left' AS part, round((SELECT sum((xmax-xmin)*(ymax-ymin)) FROM bx) - i, 2) AS area FROM i UNION ALL SELECT 'right', round((SELECT sum((xmax-xmin)*(ymax-ymin)) FROM zones) - u, 2) FROM u UNION ALL SELECT 'both', round(i, 2) FROM i) WHERE area > 0""",
    ),
    "box_buffer": (
        lambda s, d: S.buffer_boxes(boxes(s, d), -1200.0).select("sid", *G.SIDES),
        f"WITH {BOX} SELECT sid, xmin+1200 AS xmin, ymin+1200 AS ymin, xmax-1200 AS xmax, ymax-1200 AS ymax FROM bx WHERE xmin+1200 < xmax-1200 AND ymin+1200 < ymax-1200",
    ),
    "dissolve_bbox_by_region": (
        lambda s, d: A.dissolve_boxes(zones(s, d), "rk"),
        f"WITH {Z} SELECT rk, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS source_features FROM zones GROUP BY rk",
    ),
    "dissolve_area_by_region": (
        lambda s, d: _r(A.dissolved_area(zones(s, d), "rk"), "area", digits=2),
        f"WITH {Z} SELECT rk, round(sum((xmax-xmin)*(ymax-ymin)), 2) AS area FROM zones GROUP BY rk",
    ),
    "dissolve_policies": (
        lambda s, d: A.attribute_preview(boxes(s, d).withColumn("g", F.col("sid") % 6), "g", "bal", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).withColumn("sum_numeric", F.round("sum_numeric", 4)),
        f"WITH {BOX} SELECT sid % 6 AS g, max_by(bal, ((xmax-xmin)*(ymax-ymin), bal)) AS largest, CASE WHEN min(bal) = max(bal) THEN min(bal) END AS common, round(sum(bal), 4) AS sum_numeric FROM bx GROUP BY 1",
    ),
    "centroid": (
        lambda s, d: A.centroids(boxes(s, d)).select("sid", "x", "y"),
        f"WITH {BOX} SELECT sid, (xmin+xmax)/2 AS x, (ymin+ymax)/2 AS y FROM bx",
    ),
    "ring_centroid": (
        lambda s, d: boxes(s, d).select("sid", G.shoelace_centroid(F.array("xmin", "xmax", "xmax", "xmin", "xmin"), F.array("ymin", "ymin", "ymax", "ymax", "ymin")).alias("c")).select("sid", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), F.round("c.area", 2).alias("area")),
        f"WITH {BOX} SELECT sid, round((xmin+xmax)/2, 4) AS x, round((ymin+ymax)/2, 4) AS y, round((xmax-xmin)*(ymax-ymin), 2) AS area FROM bx",
    ),
    "bbox_union": (lambda s, d: S.bounds(boxes(s, d)), f"WITH {BOX} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM bx"),
    "hilbert_order": (_hilbert, HILBERT),
    "tile_assign": (
        lambda s, d: _tile_points(s, d).select("id", G.tile_of(F.col("mx"), F.col("my"), 6)[0].alias("tx"), G.tile_of(F.col("mx"), F.col("my"), 6)[1].alias("ty")),
        f"WITH {PTS}, {TILE} SELECT id, greatest(0, least(63, floor((mx + 20037508.342789244::DOUBLE) / (2 * 20037508.342789244::DOUBLE / 64))))::INTEGER AS tx, greatest(0, least(63, floor((20037508.342789244::DOUBLE - my) / (2 * 20037508.342789244::DOUBLE / 64))))::INTEGER AS ty FROM t",
    ),
    "tile_filter": (
        lambda s, d: (lambda b: _tile_points(s, d).where((F.col("mx") >= b[0]) & (F.col("my") >= b[1]) & (F.col("mx") <= b[2]) & (F.col("my") <= b[3])).select("id"))(G.tile_bounds(2, 1, 1)),
        f"WITH {PTS}, {TILE} SELECT id FROM t WHERE mx >= -20037508.342789244::DOUBLE/2 AND mx <= 0 AND my >= 0 AND my <= 20037508.342789244::DOUBLE/2",
    ),
    "web_mercator": (
        lambda s, d: _tile_points(s, d).select("id", F.round("mx", 2).alias("mx"), F.round("my", 2).alias("my"), F.round(G.from_mercator(F.col("mx"), F.col("my"))[1], 6).alias("lat")),
        f"WITH {PTS}, {TILE} SELECT id, round(mx, 2) AS mx, round(my, 2) AS my, round(y / 100080 * 140 - 70, 6) AS lat FROM t JOIN pts USING (id)",
    ),
    "reproject_state_plane": (
        lambda s, d: reproject(_lon_lat(s, d), 2277).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")),
        STATE_PLANE_SQL,
    ),
    "reproject_round_trip": (
        lambda s, d: reproject(reproject(_lon_lat(s, d), 32614), 4326).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
        f"WITH {PTS} SELECT id, round(x / 100060 * 3 - 102, 6) AS x, round(y / 100080 * 3 + 29.5::DOUBLE, 6) AS y FROM pts",
    ),
    "rollup_region_nation": (
        lambda s, d: points(s, d).join(F.broadcast(table(s, d, "nation")), F.col("nk") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v")),
        f"WITH {PTS} SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(v), 2) AS v FROM pts JOIN nation ON nk = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    ),
}
