"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors stand in vertical layout, a block's dimensions one after the other. For a block of queries, partial scores of all
candidates of a block grow by BLOCK dimensions at a time; a candidate stays while its partial score plus the most its
remaining mass can add (the product of the two remaining norms) reaches the query's k-th best score so far. Survivors are
compacted before the next dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written

K, EVERY, SCALE, BLOCK = 5, 50, 256, 16
#: Queries and candidates of one block; a task holds one block of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
#: Sums below this are exact in double precision.
EXACT, LONG = 2.0**53, 2.0**63


def _search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best of the candidates, ties to the smaller id; c and q hold
    integers, one row for each dimension. Candidates with the query's own id don't count.

    Partial scores are doubles. Their bounds hold the most that rounding can have taken, which is nothing while sums stay
    below 2^53; beyond, the survivors' scores are summed again as integers and held to what a long holds."""
    dims = q.shape[0]
    wide = dims and float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * dims >= EXACT
    order = np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")  # heavy dimensions first, so bounds close early
    whole_q, whole_c = q[order], c[order]
    q, c = whole_q.astype(float), whole_c.astype(float)
    cuts = list(range(0, dims, block)) + [dims]
    rest = lambda m: [np.sqrt((m[a:] ** 2).sum(axis=0)) for a in cuts]
    q_rest, c_rest = rest(q), rest(c)
    first = q[: cuts[1]].T @ c[: cuts[1]] if dims else np.zeros((q.shape[1], c.shape[1]))
    lost = (dims + 2) * 2.0**-50 if wide else 0.0
    qi, ci, sc = [], [], []
    for i in range(q.shape[1]):
        live = np.flatnonzero(c_ids != q_ids[i])
        partial = first[i][live]
        if dims and len(live) > k:
            slack = lost * q_rest[0][i] * c_rest[0]
            # the k best so far, by their whole scores, give the first bar
            lead = live[np.argpartition(-partial, k - 1)[:k]]
            bar = min(float((q[:, i] @ c[:, lead] - slack[lead]).min()), LONG)
            for b in range(1, len(cuts)):
                most = partial + q_rest[b][i] * c_rest[b][live] * (1 + 1e-9) + slack[live] + 1e-6
                stay = np.maximum(most, -LONG) >= bar
                if not stay.all():
                    live, partial = live[stay], partial[stay]
                if b + 1 < len(cuts):
                    partial = partial + q[cuts[b] : cuts[b + 1], i] @ c[cuts[b] : cuts[b + 1]][:, live]
                    if len(live) > k:
                        done = partial - q_rest[b + 1][i] * c_rest[b + 1][live] * (1 + 1e-9) - slack[live] - 1e-6
                        bar = max(bar, min(float(np.partition(done, len(done) - k)[len(done) - k]), LONG))
        if wide:
            own = [int(x) for x in whole_q[:, i]]
            exact = [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, whole_c[:, j])))) for j in live.tolist()]
            partial = np.array(exact, np.int64)
            best = np.lexsort((c_ids[live], ~partial))[:k]  # ~x falls as x rises and holds every long
        else:
            best = np.lexsort((c_ids[live], -partial))[:k]
            partial = np.rint(partial).astype(np.int64)
        qi.append(np.full(len(best), i)), ci.append(live[best]), sc.append(partial[best])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(qi).astype(np.int64), cat(ci).astype(np.int64), cat(sc).astype(np.int64)


def _pack(block: int):
    """Rows (part, vec_id, v) to one row for each run of a part: ids, dimensions and the vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, rows = None, [], []

        def out():
            dims = max((len(r) for r in rows), default=0)
            m = np.zeros((dims, len(rows)), np.int64)
            for i, r in enumerate(rows):
                m[: len(r), i] = r
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([dims], pa.int64()), pa.array([m.tobytes()])], names=["part", "ids", "dims", "m"])

        for batch in batches:
            parts, vec, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            flat, at = values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))))
            for i, (p, v) in enumerate(zip(parts, vec, strict=True)):
                if rows and (p != part or len(rows) >= block):
                    yield out()
                    ids, rows = [], []
                part = p
                ids.append(v), rows.append(flat[at[i] : at[i + 1]])
        if rows:
            yield out()

    return run


def _join_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                dims = min(r["q_dims"], r["c_dims"])  # what a shorter vector lacks counts as 0
                q = np.frombuffer(r["q"], np.int64).reshape(r["q_dims"], len(a))[:dims]
                c = np.frombuffer(r["c"], np.int64).reshape(r["c_dims"], len(b))[:dims]
                i, j, s = _search(a, q, b, c, k)
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; vectors that are null or hold null or non-finite
    components are left out."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select("vec_id", x.alias("_x")).where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull()).where(fine)
        .select("vec_id", F.transform("_x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    )


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest integer inner product, ties to the smaller
    vec_id; all where there are fewer. Queries are the rows whose vec_id is divisible by `every`; a row is no candidate for
    a query of its own vec_id.

    Both sides are cut into blocks of bounded size, each query block meets each candidate block once, and every meeting
    sends on k rows for a query. Rows that repeat a vec_id are candidates each; where a query's vec_id repeats, equal rows ask
    once, and the k best of its different rows' scores count. An empty vector scores 0 with all, and what a shorter vector lacks counts as 0; scores that a
    long can't hold are held to its ends; an empty table gives no rows; other columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    base = Written(quantised(vectors), "vectors")
    packed = "part long, ids binary, dims long, m binary"
    own = F.spark_partition_id().cast("long")
    c = Written(base.df.select(own.alias("part"), "vec_id", "v").mapInArrow(_pack(CANDIDATE_BLOCK), packed), "candidates")
    queries = base.df.where(F.col("vec_id") % every == 0).distinct()
    n = -(-queries.count() // QUERY_BLOCK)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a seeded hash deals the queries into n blocks of about QUERY_BLOCK rows
    dealt = queries.select(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(n)).alias("part"), "vec_id", "v").repartition("part").sortWithinPartitions("part", "vec_id")
    q = Written(dealt.mapInArrow(_pack(2 * QUERY_BLOCK), packed), "queries")
    q_blocks = q.df.select(F.col("part").alias("no"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("m").alias("q"))
    met = c.df.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("no"), F.col("ids").alias("c_ids"), F.col("dims").alias("c_dims"), F.col("m").alias("c"))
    met = met.join(q_blocks, "no").select("q_ids", "q_dims", "q", "c_ids", "c_dims", "c")
    found = met.mapInArrow(_join_blocks(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(x, lambda y: floor(256 * y)) AS v FROM f WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
