"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector, less the mean of its label's vectors, by the signs of its projections on BITS random directions,
one after the other, and orders the vectors of a label lexicographically by these bits; neighbours in that order are compared by exact cosine. A window goes
on from block to block as long as it finds links, so a group larger than a window is compared whole. The verified pairs of
a window leave it as the edges of a forest, one for each vector, and the passes' forests are united to components.
Passes come in rounds: a label goes on for as many as its size asks for, and while a round unites components. Links are
then counted inside each component, block by block, by exact cosine: no pair is ever a row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, small

#: Passes of a round, hash bits of each, and rows of a block: a row meets its own block and the next at least.
PASSES, BITS, BLOCK = 12, 64, 256
#: Share of the bits that linked vectors agree in, at a mean cosine of 0.9 in the label, and odds of a link that no pass finds.
AGREE, MISSED = 0.8, 0.001
#: Labels whose means are broadcast.
CENTRES = 20_000
#: Vectors of a block of links counted, on average.
COUNT_BLOCK = 512
SIMILAR = 0.98


def _directions(dims: int, turn: int, bits: int) -> np.ndarray:
    return np.random.default_rng([23, turn, dims]).standard_normal((dims, bits))


def _rows(lengths: np.ndarray, values: pa.Array, groups: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, unit vectors) of the rows of each group of equal length."""
    flat, at = values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
    for rows in groups:
        yield rows, _unit(np.stack([flat[at[r] : at[r + 1]] for r in rows]))


def _groups(*keys: np.ndarray) -> list[np.ndarray]:
    """The row numbers of each distinct combination of the keys."""
    order = np.lexsort(keys)
    change = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, v) to (label, dims, n, s): the sum of the unit vectors of each label and length in a batch."""
    for batch in batches:
        labels, lengths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for rows, m in _rows(lengths, batch.column(1), _groups(labels, lengths)):
            own = [pa.array([labels[rows[0]]], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([m.sum(axis=0).tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(own, names=["label", "dims", "n", "s"])


def centres(vectors: DataFrame, block: int, passes: int) -> DataFrame:
    """(label, dims, centre, turns) of vectors (label, v): the mean unit vector, rounded so that it doesn't depend on the order
    of sums, and the passes that so many vectors ask for.

    A pass finds a link when the bits agree that tell apart as many blocks as the label has."""
    parts = vectors.select("label", "v").mapInArrow(_sums, "label long, dims int, n long, s array<double>")
    sums = parts.select("label", "dims", "n", F.posexplode("s").alias("pos", "x")).groupBy("label", "dims", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = sums.groupBy("label", "dims").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.round(F.col("x") / F.col("n"), 9).alias("x")))).alias("c"))
    odds = F.pow(F.lit(AGREE), F.log2(F.greatest(F.col("n") / block, F.lit(1.0))))
    turns = F.when(odds >= 1 - MISSED, 1).otherwise(F.ceil(math.log(MISSED) / F.log1p(-odds)))
    return out.select("label", "dims", F.transform("c", lambda e: e["x"]).alias("centre"), F.greatest(F.lit(passes), turns.cast("int")).alias("turns"))


def _codes(first: int, passes: int, bits: int):
    """Rows (node, label, v, centre) to (turn, code, node, label, v); the bits of a code are big-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, middle = batch.column(2), batch.column(3)
            lengths, labels = values.value_lengths().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, m in _rows(lengths, values, _groups(labels, lengths)):
                m = m - np.array(middle[int(rows[0])].as_py())
                own = batch.take(pa.array(rows))
                for turn in range(first, first + passes):
                    bit = np.packbits(m @ _directions(m.shape[1], turn, bits) >= 0, axis=1)
                    code = pa.array([b.tobytes() for b in bit], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), turn), pa.int32()), code, *own.columns[:3]], names=["turn", "code", "node", "label", "v"])

    return run


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def forest(links: np.ndarray) -> np.ndarray:
    """The least index that each of the columns is connected to, by links [rows, columns] between the last columns and all."""
    rows, columns = links.shape
    label, far = np.arange(columns), columns
    while True:
        own = np.minimum(label[columns - rows :], np.where(links, label[None, :], far).min(axis=1))
        new = label.copy()
        new[columns - rows :] = own
        new = np.minimum(new, np.where(links, own[:, None], far).min(axis=0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _windows(similar: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by turn, label and code; the vectors of earlier blocks of a run of equal (turn, label) are kept
        while they still link with what follows, those of the last block always."""
        ids, units = np.zeros(0, np.int64), np.zeros((0, 0))
        key, new, rows = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, units, new, rows
            if not new:
                return
            own, m = np.array(new, np.int64), _unit(np.stack(rows))
            ids, units = (np.concatenate((ids, own)), np.concatenate((units, m))) if len(ids) else (own, m)
            links = m @ units.T >= similar
            label = forest(links)
            at = np.flatnonzero(label != np.arange(len(label)))
            a, b = ids[label[at]], ids[at]
            past = len(ids) - len(own)
            keep = np.concatenate((links[:, :past].any(axis=0), np.ones(len(own), bool)))
            ids, units = ids[keep], units[keep]
            new, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            turns, labels, nodes, values = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4)
            flat, at = values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))))
            for i, now in enumerate(zip(turns, labels, np.diff(at).tolist(), strict=True)):
                if now != key or len(new) >= block:
                    yield from close()
                    if now != key:
                        ids, units, key = np.zeros(0, np.int64), np.zeros((0, 0)), now
                new.append(nodes[i]), rows.append(flat[at[i] : at[i + 1]])
        yield from close()

    return run


def _counts(similar: float):
    """Rows (b1, b2, left, right) of two blocks of a component, each an array of (node, times, v), to (node, n): how many
    vectors of the other block each links with."""

    def read(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = x.values
        v = s.field("v")
        node, times = s.field("node").to_numpy(zero_copy_only=False), s.field("times").to_numpy(zero_copy_only=False)
        return node, times.astype(float), _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                same = one.column(0)[0].as_py() == one.column(1)[0].as_py()
                (n1, t1, u1), (n2, t2, u2) = (read(pa.ListArray.from_arrays(pa.array([0, len(c[0].values)], pa.int32()), c[0].values)) for c in (one.column(2), one.column(3)))
                links = u1 @ u2.T >= similar
                if same:
                    np.fill_diagonal(links, False)
                    node, n = n1, links @ t2
                else:
                    node, n = np.concatenate((n1, n2)), np.concatenate((links @ t2, t1 @ links))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64))], names=["node", "n"])

    return run


def link_counts(members: DataFrame, similar: float) -> DataFrame:
    """(node, more): links of each member (component, node, times, v) with other members of its component, by times.

    A component is dealt into blocks by a hash, and two of its blocks meet under a key of their own, so that a large
    component's comparisons spread over tasks."""
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / COUNT_BLOCK).alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("blk", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")))
    packed = Written(dealt.groupBy("component", "blk", "blocks").agg(F.collect_list(F.struct("node", "times", "v")).alias("rows")), "blocks").df
    left = packed.select("component", F.col("blk").alias("b1"), F.explode(F.sequence("blk", F.col("blocks") - 1)).alias("b2"), F.col("rows").alias("left"))
    right = packed.select("component", F.explode(F.sequence(F.lit(0).cast("long"), "blk")).alias("b1"), F.col("blk").alias("b2"), F.col("rows").alias("right"))
    met = left.join(right, ["component", "b1", "b2"]).select("b1", "b2", "left", "right")
    return met.mapInArrow(_counts(similar), "node long, n long").groupBy("node").agg(F.sum("n").alias("more"))


def linked_components(named: DataFrame, similar: float, passes: int, bits: int, block: int) -> DataFrame:
    """(node, component) of the vectors (node, label, v) that link with others, by rounds of passes."""
    middle = Written(centres(named, block, passes), "centres").df
    keys, dims = ["label", "dims"], F.size("v").alias("dims")
    live, comps, first = middle, None, 0
    while True:
        own = named.withColumn("dims", dims).join(small(live, CENTRES), keys).select("node", "label", "v", "centre")
        coded = Written(own.mapInArrow(_codes(first, passes, bits), "turn int, code binary, node long, label long, v array<double>"), "codes")
        ordered = coded.df.repartitionByRange("turn", "label", F.size("v"), "code").sortWithinPartitions("turn", "label", F.size("v"), "code", "node")
        pairs = Written(ordered.mapInArrow(_windows(similar, block), "a long, b long").where("a <> b").distinct(), "pairs")
        coded.drop()
        new, first = pairs.df, first + passes
        if comps is not None:
            at = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            apart = new.join(at("a"), "a", "left").join(at("b"), "b", "left")
            new = Written(apart.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "new").df
        if comps is None or not new.isEmpty():
            edges = new if comps is None else new.unionAll(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
            comps = Written(components(edges), "components").df
        fresh = named.withColumn("dims", dims).join(new.select(F.col("a").alias("node")), "node").select(*keys).distinct().withColumn("fresh", F.lit(True))
        live = Written(middle.join(fresh, keys, "left").where((F.col("turns") > first) | F.col("fresh")).drop("fresh"), "live").df
        if live.isEmpty():
            return comps


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, passes: int = PASSES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine in double precision
    is `similar` or more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows without vec_id. Equal vectors of a label become one node first, which counts each of them. n_links: other rows
    linked directly. component_id: the smallest vec_id reachable by links, itself included; kept where it is vec_id. Rows
    that repeat a vec_id are rows of their own that share its component. Links found are verified; a link whose two vectors
    are far apart in every pass's order is missed, with odds that fall with the number of passes, which follow the label's size
and what they find; `passes` is a round of them. Equal codes go by a hash of the vector; vectors of any length are compared
    whole; an empty table gives no rows; other columns are ignored, whatever their names."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # -0.0 + 0.0 is 0.0; the largest component is taken out, so that squares neither overflow nor vanish
    scale = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda e: e / scale + 0.0))).withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit("second"), "v", "label"))
    base = Written(rows, "vectors")
    nodes = Written(base.df.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")), "nodes")
    # a vec_id that stands for two vectors would be two nodes of one name: the hash keeps them apart
    named = Written(base.df.where("ok").join(small(nodes.df), ["h1", "h2"]).where("vec_id = node").select(F.col("h1").alias("node"), "label", "v").dropDuplicates(["node"]), "named")
    comps = linked_components(named.df, similar, passes, bits, block)
    weights = nodes.df.select(F.col("h1").alias("node"), "times").dropDuplicates(["node"])
    linked = link_counts(named.df.join(comps, "node").join(weights, "node").select("component", "node", "times", "v"), similar).withColumnRenamed("node", "a")
    names = nodes.df.select("h1", "node")
    edges = comps.join(names.select(F.col("h1").alias("node"), F.col("node").alias("na")), "node").join(names.select(F.col("h1").alias("component"), F.col("node").alias("nb")), "component").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    many = base.df.where("ok").groupBy("vec_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("vec_id")
    ties = base.df.where("ok").join(small(nodes.df), ["h1", "h2"]).where("vec_id <> node").join(many, "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    labels = components(edges.unionAll(ties)).where("node <> component").select(F.col("node").alias("_node"), "component")
    known = Written(nodes.df.join(linked.withColumnRenamed("a", "h1"), "h1", "left").join(labels, F.col("node") == F.col("_node"), "left").select("h1", "h2", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component")), "known")
    out = base.df.select("vec_id", "ok", "h1", "h2").join(small(known.df), ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


SQL = """
WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM f WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (WITH RECURSIVE q(node, reach) AS (SELECT vec_id, vec_id FROM f UNION SELECT q.node, e.b FROM q JOIN e ON q.reach = e.a) SELECT node, min(reach) AS c FROM q GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT f.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, r.c = f.vec_id AS kept FROM f JOIN r ON r.node = f.vec_id LEFT JOIN n ON n.a = f.vec_id
"""
