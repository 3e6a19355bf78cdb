"""Attribute-table queries over events, part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layers import table
from ..operators import attributes as A


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "props", "event_type", "value", "ts")


def _sparse(spark, d):
    """Attributes of every sort: numbers, text, booleans, nulls and absence."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    made = F.when(i % 7 == 0, F.lit("{}")).when(i % 7 == 1, F.lit('{"m":null}')).when(i % 7 == 2, F.concat(F.lit('{"m":"t'), k, F.lit('"}'))).when(i % 7 == 3, F.concat(F.lit('{"m":"'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"m":'), k, F.lit(',"q":true}')))
    return table(spark, d, "events").select(i.alias("id"), made.alias("props"))


SPARSE = """s AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN 't' || (props->>'k') WHEN event_id % 7 = 3 THEN props->>'k' ELSE props->>'k' END AS m,
 event_id % 7 AS r FROM events)"""
EV = "e AS (SELECT event_id AS id, props->>'k' AS k, event_type, value FROM events)"


def _reg(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("ds "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate")).alias("deleted_at"),
    )


QUERIES = {
    "attr_page_default": (
        lambda s, d: A.page(_events(s, d), offset=100, limit=50).select("id", "event_type", "value"),
        f"WITH {EV} SELECT id, event_type, value FROM e ORDER BY id LIMIT 50 OFFSET 100",
    ),
    "attr_page_sorted": (
        lambda s, d: A.page(_events(s, d), "k", offset=20, limit=50, descending=True).select("id", A.attribute("k").alias("k")),
        f"WITH {EV} SELECT id, k FROM e ORDER BY try_cast(k AS DOUBLE) DESC NULLS LAST, k DESC NULLS LAST, id LIMIT 50 OFFSET 20",
    ),
    "attr_page_sparse": (
        lambda s, d: A.page(_sparse(s, d), "m", offset=0, limit=4000).select("id", A.attribute("m").alias("m")),
        f"WITH {SPARSE} SELECT id, m FROM s ORDER BY try_cast(m AS DOUBLE) ASC NULLS LAST, m ASC NULLS LAST, id LIMIT 4000",
    ),
    "attr_names": (
        lambda s, d: A.names(_sparse(s, d)),
        "SELECT 'm' AS name UNION ALL SELECT 'q' AS name",
    ),
    "attr_kind": (
        lambda s, d: A.kind(_sparse(s, d), "m").unionAll(A.kind(_events(s, d), "k")),
        f"""WITH {SPARSE}, {EV}, a AS (SELECT count(m) AS n, count(try_cast(m AS DOUBLE)) AS n_numeric FROM s UNION ALL SELECT count(k), count(try_cast(k AS DOUBLE)) FROM e)
        SELECT n, n_numeric, CASE WHEN n > 0 AND n_numeric >= 0.98 * n THEN 'numeric' ELSE 'category' END AS kind FROM a""",
    ),
    "attr_categories": (
        lambda s, d: A.categories(_events(s, d), "k", shown=30),
        f"WITH {EV}, c AS (SELECT k AS value, count(*) AS n FROM e WHERE k IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS n_distinct FROM c) SELECT value, n, n_distinct, greatest(0, n_distinct - 30) AS remaining FROM c, t ORDER BY n DESC, value LIMIT 30",
    ),
    "attr_category_refusal": (
        lambda s, d: A.categories(_events(s, d).withColumn("props", F.concat(F.lit('{"u":'), F.col("id").cast("string"), F.lit("}"))), "u", most=50),
        "SELECT NULL::VARCHAR AS value, NULL::BIGINT AS n, count(DISTINCT event_id) AS n_distinct, count(DISTINCT event_id) AS remaining FROM events",
    ),
    "attr_histogram": (
        lambda s, d: A.histogram(_events(s, d), F.col("value").cast("string")).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "missing"),
        """WITH m AS (SELECT min(value) AS a, max(value) AS b, count(*) - count(value) AS missing FROM events), w AS (SELECT *, (b - a) / 40 AS w FROM m),
        c AS (SELECT least(39, cast(floor((value - a) / w) AS INTEGER)) AS bin, count(*) AS n FROM events, w WHERE value IS NOT NULL GROUP BY 1)
        SELECT cast(r.range AS INTEGER) AS bin, round(a + r.range * w, 6) AS lo, round(a + (r.range + 1) * w, 6) AS hi, coalesce(n, 0) AS n, missing FROM range(40) r CROSS JOIN w LEFT JOIN c ON c.bin = r.range""",
    ),
    "attr_histogram_constant": (
        lambda s, d: A.histogram(_events(s, d), F.lit("7.5")),
        "SELECT 0 AS bin, 7.5::DOUBLE AS lo, 7.5::DOUBLE AS hi, count(*) AS n, 0::BIGINT AS missing FROM events",
    ),
    "attr_missing": (
        lambda s, d: A.histogram(_sparse(s, d), A.attribute("m")).agg(F.max("missing").alias("missing"), F.sum("n").alias("present")),
        f"WITH {SPARSE} SELECT count(*) - count(try_cast(m AS DOUBLE)) AS missing, cast(count(try_cast(m AS DOUBLE)) AS BIGINT) AS present FROM s",
    ),
    "attr_summary": (
        lambda s, d: A.summary(_events(s, d), "k").select("bin", "n", "missing"),
        f"""WITH {EV}, v AS (SELECT try_cast(k AS DOUBLE) AS v FROM e), m AS (SELECT min(v) AS a, max(v) AS b, count(*) - count(v) AS missing FROM v),
        c AS (SELECT least(39, cast(floor((v - a) / ((b - a) / 40)) AS INTEGER)) AS bin, count(*) AS n FROM v, m WHERE v IS NOT NULL GROUP BY 1)
        SELECT cast(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n, missing FROM range(40) r CROSS JOIN m LEFT JOIN c ON c.bin = r.range""",
    ),
    "dataset_page": (
        lambda s, d: A.dataset_page(_reg(s, d), kind_of="1-URGENT", limit=30, offset=10).select("id", "name", "total"),
        "WITH r AS (SELECT * FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderpriority = '1-URGENT') SELECT o_orderkey AS id, 'ds ' || o_orderkey AS name, (SELECT count(*) FROM r) AS total FROM r ORDER BY o_orderdate DESC, name, id LIMIT 30 OFFSET 10",
    ),
    "dataset_search_ilike": (
        lambda s, d: table(s, d, "part").where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name"),
        "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'",
    ),
    "dataset_search_trigram": (
        lambda s, d: A.search(table(s, d, "part"), "p_name", "small red", at_least=0.2, limit=40, id_column="p_partkey").select("p_partkey", "p_name", "score"),
        """WITH q AS (SELECT list_distinct(list_transform(range(1, length('  small red ') - 1), lambda i: substr('  small red ', i, 3))) AS g),
        t AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part),
        s AS (SELECT p_partkey, p_name, round(len(list_intersect(t.g, q.g))::DOUBLE / (len(t.g) + len(q.g) - len(list_intersect(t.g, q.g))), 6) AS score FROM t, q)
        SELECT * FROM s WHERE score >= 0.2 OR p_name ILIKE '%small red%' ORDER BY score DESC, p_partkey LIMIT 40""",
    ),
    "dataset_search_bbox": (
        lambda s, d: _boxed(s, d).where(A.overlaps_box("bbox", (20000.0, 20000.0, 50000.0, 40040.0))).select("id"),
        "WITH b AS (SELECT c_custkey AS id, ((c_custkey*7919)%10007)*10.0 AS x, ((c_custkey*104729)%10009)*10.0 AS y FROM customer) SELECT id FROM b WHERE id % 11 <> 0 AND x <= 50000 AND x + 500 >= 20000 AND y <= 40040 AND y + 500 >= 20000",
    ),
}


def _boxed(spark, d):
    from ..layers import points

    p = points(spark, d)
    box = F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 500).alias("xmax"), (F.col("y") + 500).alias("ymax"))
    return p.select("id", F.when(F.col("id") % 11 != 0, box).alias("bbox"))
