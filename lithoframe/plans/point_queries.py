"""Neighbours, interpolation, declustering, transforms, classes and variograms over customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layers import points, table
from ..operators import neighbours, prep, statistics as ST, variogram as V
from .spatial_queries import PTS

CELLS = "cells AS (SELECT a.n_nationkey * 25 + b.n_nationkey AS cell_id, a.n_nationkey * 4000.0::DOUBLE AS x, b.n_nationkey * 4000.0::DOUBLE AS y FROM nation a, nation b)"
NN = f"WITH {PTS}, nn AS (SELECT a.id, min(sqrt((a.x-b.x)^2+(a.y-b.y)^2)) AS distance FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id)"
NEAR = f"WITH {PTS}, {CELLS}, k AS (SELECT cell_id, id, v, (p.x-c.x)^2+(p.y-c.y)^2 AS d2, row_number() OVER (PARTITION BY cell_id ORDER BY (p.x-c.x)^2+(p.y-c.y)^2, id) AS rank FROM cells c, pts p)"


def cells(spark, d):
    i = F.col("id")
    return spark.range(625).select(i.alias("cell_id"), (F.floor(i / 25) * 4000.0).alias("x"), (F.pmod(i, F.lit(25)) * 4000.0).alias("y"))


def control(spark, d):
    return points(spark, d).withColumn("value", F.col("v"))


def coarse(spark, d):
    k = F.col("id")
    return points(spark, d).withColumns({"x": F.pmod(k, F.lit(97)) * 10.0, "y": F.pmod(k, F.lit(5)) * 10.0})


def _planted(spark, d):
    """Points in groups about a place, each within 0.8 of the next of its group."""
    k = F.col("id")
    return points(spark, d).withColumns({"x": F.pmod(k, F.lit(97)) * 10.0 + F.pmod(k, F.lit(3)) * 0.4, "y": F.pmod(k, F.lit(5)) * 10.0 + F.pmod(k, F.lit(2)) * 0.3})


def _flags(spark, kept, flags):
    return spark.createDataFrame([(f.name, f.number) for f in flags] + [("left", kept.count())], "name string, number long")


COARSE = f"{PTS}, co AS (SELECT id, (id%97)*10.0::DOUBLE AS x, (id%5)*10.0::DOUBLE AS y, v FROM pts)"


def _breaks(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, b double").withColumn("b", F.round("b", 4))


def _variogram(spark, d, **options):
    p = points(spark, d)
    return V.experimental(p, max_lag=20000.0, lags=20, **options).select("lag_bin", F.round("lag", 3).alias("lag"), F.round("gamma", 1).alias("gamma"), "n_pairs")


PAIRS = f"WITH {PTS}, p AS (SELECT sqrt((a.x-b.x)^2+(a.y-b.y)^2) AS h, b.x-a.x AS dx, b.y-a.y AS dy, (a.v-b.v)^2 AS dv FROM pts a JOIN pts b ON a.id < b.id AND (a.x-b.x)^2+(a.y-b.y)^2 < 400000000::DOUBLE)"
LAGGED = "SELECT floor(h/1000)::INTEGER AS lag_bin, round(avg(h), 3) AS lag, round(sum(dv)/(2*count(*)), 1) AS gamma, count(*) AS n_pairs FROM p {} GROUP BY 1 HAVING count(*) >= 30"
WITHIN = "y.s2 - q.s2 - (y.s1 - q.s1)^2 / (y.i - q.i)"
MODEL = V.Model("spherical", 0.2, 1.5, 9000.0)

QUERIES = {
    "control_points_scan": (
        lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").try_cast("double").alias("value")).agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.round(F.sum("value"), 3).alias("total")),
        "SELECT count(*) AS n, count(try_cast(props->>'k' AS DOUBLE)) AS with_value, round(sum(try_cast(props->>'k' AS DOUBLE)), 3) AS total FROM events",
    ),
    "coincident_points": (lambda s, d: ST.coincident(coarse(s, d)), f"WITH {COARSE} SELECT count(*) - count(DISTINCT (x, y)) AS coincident FROM co"),
    "nn_spacing": (lambda s, d: neighbours.spacing(points(s, d)).withColumn("distance", F.round("distance", 6)), f"{NN} SELECT id, round(distance, 6) AS distance FROM nn"),
    "search_radius": (lambda s, d: neighbours.search_radius(points(s, d)).withColumn("radius", F.round("radius", 6)), f"{NN} SELECT round(quantile_cont(distance, 0.5) * 3, 6) AS radius FROM nn"),
    "knn": (
        lambda s, d: neighbours.knn(cells(s, d).withColumnRenamed("cell_id", "query_id"), points(s, d), 16).select(F.col("query_id").alias("cell_id"), "id", "d2", "rank"),
        f"{NEAR} SELECT cell_id, id, d2, rank FROM k WHERE rank <= 16",
    ),
    "idw": (
        lambda s, d: neighbours.idw(cells(s, d), control(s, d)).withColumn("value", F.round("value", 6)),
        f"{NEAR} SELECT cell_id, round(CASE WHEN min(d2) = 0 THEN min(CASE WHEN d2 = 0 THEN v END) ELSE sum(CASE WHEN d2 > 0 THEN v / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END) END, 6) AS value FROM k WHERE rank <= 16 GROUP BY cell_id",
    ),
    "nearest": (lambda s, d: neighbours.nearest(cells(s, d), control(s, d)), f"{NEAR} SELECT cell_id, v AS value FROM k WHERE rank = 1"),
    "extrapolated_fraction": (lambda s, d: neighbours.extrapolated_fraction(cells(s, d), control(s, d), 1500.0), f"{NEAR} SELECT avg(CASE WHEN sqrt(d2) > 1500 THEN 1.0 ELSE 0.0 END)::DOUBLE AS fraction FROM k WHERE rank = 1"),
    "decluster_weights": (
        lambda s, d: ST.decluster_weights(points(s, d), 8000.0).select("id", F.round("weight", 8).alias("weight")),
        f"WITH {PTS}, c AS (SELECT id, count(*) OVER (PARTITION BY floor(x/8000), floor(y/8000)) AS c FROM pts) SELECT id, round((1.0::DOUBLE/c) * count(*) OVER () / sum(1.0::DOUBLE/c) OVER (), 8) AS weight FROM c",
    ),
    "decluster_sweep": (
        lambda s, d: ST.declustered_mean(points(s, d), "v", [4000.0, 8000.0, 16000.0]).withColumn("mean", F.round("mean", 6)),
        f"WITH {PTS}, t AS (SELECT v, size, o, floor((x + size*o/4)/size) AS kx, floor((y + size*o/4)/size) AS ky FROM pts, (SELECT unnest([4000.0::DOUBLE, 8000.0, 16000.0]) AS size), (SELECT unnest([0, 1, 2, 3]) AS o)), c AS (SELECT size, o, avg(v) AS m FROM t GROUP BY size, o, kx, ky), e AS (SELECT size, o, avg(m) AS m FROM c GROUP BY 1, 2) SELECT size, round(avg(m), 6) AS mean FROM e GROUP BY size",
    ),
    "weighted_mean": (
        lambda s, d: ST.weighted_mean(ST.decluster_weights(points(s, d), 8000.0), "v", "weight").withColumn("mean", F.round("mean", 6)),
        f"WITH {PTS}, c AS (SELECT v, count(*) OVER (PARTITION BY floor(x/8000), floor(y/8000)) AS c FROM pts) SELECT round(sum(v/c)/sum(1.0::DOUBLE/c), 6) AS mean FROM c",
    ),
    "weighted_quantile": (
        lambda s, d: ST.weighted_quantile(points(s, d).withColumn("w", F.lit(1.0) + F.col("id") % 3), "v", "w", 0.4).withColumn("value", F.round("value", 6)),
        f"WITH {PTS}, o AS (SELECT v, sum(1.0::DOUBLE + id % 3) AS w FROM pts GROUP BY v), q AS (SELECT v, (sum(w) OVER (ORDER BY v) - w/2) / sum(w) OVER () AS p FROM o), n AS (SELECT v, p, lead(v) OVER (ORDER BY v) AS v1, lead(p) OVER (ORDER BY v) AS p1 FROM q) SELECT round(v + (0.4 - p)/(p1 - p)*(v1 - v), 6) AS value FROM n WHERE p <= 0.4 AND p1 > 0.4",
    ),
    "dedupe_mean": (
        lambda s, d: ST.dedupe(coarse(s, d), 40.0).select("kx", "ky", F.round("x", 6).alias("x"), F.round("v", 6).alias("v"), "n"),
        f"WITH {COARSE} SELECT round_even(x/40, 0)::BIGINT AS kx, round_even(y/40, 0)::BIGINT AS ky, round(avg(x), 6) AS x, round(avg(v), 6) AS v, count(*) AS n FROM co GROUP BY 1, 2",
    ),
    "dedupe_first": (
        lambda s, d: ST.dedupe(coarse(s, d), 40.0, "first").select("kx", "ky", "id", "v", "n"),
        f"WITH {COARSE} SELECT round_even(x/40, 0)::BIGINT AS kx, round_even(y/40, 0)::BIGINT AS ky, min(id) AS id, min_by(v, id) AS v, count(*) AS n FROM co GROUP BY 1, 2",
    ),
    "variogram_iso": (lambda s, d: _variogram(s, d), f"{PAIRS} {LAGGED.format('')}"),
    "variogram_sectors": (
        lambda s, d: V.directional_sums(points(s, d), max_lag=20000.0, shuffles=0, most=100_000).where("n > 0").select("sector", "lag_bin", F.col("n").cast("long").alias("n_pairs"), F.round(F.col("h") / F.col("n"), 3).alias("lag"), F.round(F.col("d2") / F.col("n") / 2, 1).alias("gamma")),
        f"{PAIRS} SELECT floor(((degrees(atan2(dx, dy)) % 180 + 180) % 180) / 22.5)::INTEGER % 8 AS sector, floor(h/1000)::INTEGER AS lag_bin, count(*) AS n_pairs, round(avg(h), 3) AS lag, round(avg(dv)/2, 1) AS gamma FROM p WHERE h > 0 GROUP BY 1, 2",
    ),
    "control_clusters": (
        lambda s, d: prep.clusters(_planted(s, d), 1.0).groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.round(F.avg("v"), 6).alias("mean")).drop("cluster"),
        f"WITH {PTS}, p AS (SELECT id, id % 97 AS kx, id % 5 AS ky, v FROM pts) SELECT count(*) AS n, min(id) AS first, round(avg(v), 6) AS mean FROM p GROUP BY kx, ky",
    ),
    "control_valid": (
        lambda s, d: _flags(s, *prep.validate(_planted(s, d).withColumn("v", F.when(F.col("id") % 50 != 7, F.col("v"))), tolerance=1.0, duplicates="first")),
        f"WITH {PTS}, p AS (SELECT *, id % 97 AS kx, id % 5 AS ky FROM pts WHERE id % 50 <> 7), g AS (SELECT count(DISTINCT (kx, ky)) AS n, count(*) AS all_ FROM p) SELECT * FROM (SELECT 'ROWS_DROPPED' AS name, (SELECT count(*) FROM pts) - all_ AS number FROM g UNION ALL SELECT 'DUPLICATES_RESOLVED', all_ - n FROM g UNION ALL SELECT 'left', n FROM g) WHERE number > 0",
    ),
    "variogram_azimuth": (lambda s, d: _variogram(s, d, azimuth=45.0), f"{PAIRS} {LAGGED.format('WHERE least(((degrees(atan2(dx, dy)) - 45) % 180 + 180) % 180, 180 - ((degrees(atan2(dx, dy)) - 45) % 180 + 180) % 180) <= 22.5')}"),
    "log_transform": (lambda s, d: points(s, d).select("id", F.round(ST.log_transform(F.col("v"), 1001.0), 8).alias("t")), f"WITH {PTS} SELECT id, round(ln(v + 1001), 8) AS t FROM pts"),
    "boxcox_transform": (lambda s, d: points(s, d).select("id", F.round(ST.boxcox_transform(F.col("v"), 0.3, 1001.0), 6).alias("t")), f"WITH {PTS} SELECT id, round(((v + 1001)^0.3::DOUBLE - 1) / 0.3::DOUBLE, 6) AS t FROM pts"),
    "covariate_correlation": (
        lambda s, d: ST.correlations(points(s, d), ["x", "y", "v"]).select(*[F.round(c, 8).alias(c) for c in ("corr_x_y", "corr_x_v", "corr_y_v")]),
        f"WITH {PTS} SELECT round(corr(x, y), 8) AS corr_x_y, round(corr(x, v), 8) AS corr_x_v, round(corr(y, v), 8) AS corr_y_v FROM pts",
    ),
    "vif_two_covariates": (
        lambda s, d: s.createDataFrame([(k, round(v, 8)) for k, v in ST.vif(points(s, d), ["x", "v"]).items()], "name string, vif double"),
        f"WITH {PTS}, r AS (SELECT corr(x, v) AS r FROM pts) SELECT unnest(['x', 'v']) AS name, round(1 / (1 - r * r), 8) AS vif FROM r",
    ),
    "scenario_extrapolation": (
        lambda s, d: ST.outside_range(points(s, d), points(s, d).where("id % 10 = 0"), ["v", "x"]),
        f"WITH {PTS}, r AS (SELECT min(v) AS a, max(v) AS b, min(x) AS c, max(x) AS e FROM pts WHERE id % 10 = 0) SELECT avg(CASE WHEN v < a OR v > b THEN 1.0 ELSE 0.0 END)::DOUBLE AS outside_v, avg(CASE WHEN x < c OR x > e THEN 1.0 ELSE 0.0 END)::DOUBLE AS outside_x FROM pts, r",
    ),
    "display_range": (lambda s, d: ST.display_range(points(s, d), "v").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")), f"WITH {PTS} SELECT round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.95), 6) AS hi FROM pts"),
    "equal_interval_breaks": (lambda s, d: _breaks(s, ST.classify(points(s, d), "v", "equal_interval", 5)), f"WITH {PTS}, m AS (SELECT min(v) AS a, max(v) AS b FROM pts) SELECT (range - 1)::INTEGER AS i, round(a + (b - a) * range / 5, 4) AS b FROM m, range(1, 5)"),
    "quantile_breaks": (lambda s, d: _breaks(s, ST.classify(points(s, d), "v", "quantile", 4)), f"WITH {PTS} SELECT unnest([0, 1, 2]) AS i, round(unnest(quantile_cont(v, [0.25::DOUBLE, 0.5, 0.75])), 4) AS b FROM pts"),
    "stddev_breaks": (lambda s, d: _breaks(s, ST.classify(points(s, d), "v", "standard_deviation", 6)), f"WITH {PTS}, m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM pts) SELECT (range - 1)::INTEGER AS i, round(m + (range - 3) * s, 4) AS b FROM m, range(1, 6)"),
    "jenks_breaks": (
        lambda s, d: _breaks(s, ST.classify(points(s, d), "v", "natural_breaks", 4)),
        # the best splits of the first values into two, three and four classes; over all values, as jenks_breaks takes up to 5,000
        f"""WITH {PTS}, s AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM pts), p AS (SELECT 0 AS i, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, NULL::DOUBLE AS v UNION ALL SELECT i, sum(v) OVER (ORDER BY i), sum(v * v) OVER (ORDER BY i), v FROM s),
        b1 AS (SELECT i AS b, s2 - s1 * s1 / i AS c FROM p WHERE i > 0),
        b2 AS (SELECT y.i AS b, min(x.c + {WITHIN}) AS c, arg_min(q.i, x.c + {WITHIN}) AS a FROM p y JOIN p q ON q.i < y.i AND q.i >= 1 JOIN b1 x ON x.b = q.i GROUP BY y.i),
        b3 AS (SELECT y.i AS b, min(x.c + {WITHIN}) AS c, arg_min(q.i, x.c + {WITHIN}) AS a FROM p y JOIN p q ON q.i < y.i AND q.i >= 2 JOIN b2 x ON x.b = q.i GROUP BY y.i),
        b4 AS (SELECT arg_min(q.i, x.c + {WITHIN}) AS a FROM p y JOIN p q ON q.i < y.i AND q.i >= 3 JOIN b3 x ON x.b = q.i WHERE y.i = (SELECT max(i) FROM p)),
        cuts AS (SELECT 2 AS k, a FROM b4 UNION ALL SELECT 1, b3.a FROM b4 JOIN b3 ON b3.b = b4.a UNION ALL SELECT 0, b2.a FROM b4 JOIN b3 ON b3.b = b4.a JOIN b2 ON b2.b = b3.a)
        SELECT k AS i, round(v, 4) AS b FROM cuts JOIN p ON p.i = cuts.a + 1""",
    ),
    "class_assign": (lambda s, d: points(s, d).select(ST.class_of(F.col("v"), [0.0, 2500.0, 5000.0]).alias("class")).groupBy("class").agg(F.count("*").alias("n")), f"WITH {PTS} SELECT (v >= 0)::INTEGER + (v >= 2500)::INTEGER + (v >= 5000)::INTEGER AS class, count(*) AS n FROM pts GROUP BY 1"),
    "nscore_transform": (lambda s, d: ST.nscore(points(s, d), "v"), None),
}
