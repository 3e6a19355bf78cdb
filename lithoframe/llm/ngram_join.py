"""Exact Jaccard self-join on word shingles, filtered by prefixes under several global token orders.

Texts with equal shingle sets become one node first. Under order A, the order of the hashes, a node's list is its prefix
long enough that two linked nodes share a known number of tokens of their lists. Nodes whose lists share too few tokens
with all others have no partner. Order B puts the tokens of the whole sets of the nodes left by how many of them hold a
token, rarest first. Order C is another hash order of whole sets. Two linked nodes share a token of their prefixes under
each order, so a pair is verified on whole sets only if it shares one under B, one under A and one under C, and if the
two sizes allow a link.

Nodes that share a B-prefix token meet in blocks: nodes take names that such neighbours share and are dealt by name into
blocks of about a bounded size; a block meets itself, and two blocks meet with those of their nodes that share a token
across them. A meeting is one Arrow group. It tests every pair that isn't joined already by links found before, and sends
on a forest of links, at most one for each node. So no pair is ever a row, and a large group of near copies, linked or
not, costs rows in proportion to its members times its blocks. None of its pairs is capped or dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import Written, components, small

#: Blocks hold about this many nodes and tokens at most; a longer text is never cut.
BLOCK_NODES, BLOCK_TOKENS = 1024, 500_000
#: Candidates of a node that are tested before those joined meanwhile are left out; each further step takes four times as many.
FIRST_TESTS = 64
_ORDER_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _limits(n: int, num: int, den: int) -> tuple[int, int]:
    """(o, l) for a set of n: every partner shares o tokens or more; linked sets share the smaller of their l in their lists."""
    o = -(-num * n // den)
    return o, min(o, max(1, (n - o + 2) // 2))


def _need(n: Column, num: int, den: int) -> Column:
    """The smallest l that a partner of a set of n can have."""
    up = lambda x: F.expr(f"({num} * ({x}) + {den - 1}) div {den}")
    least = "least_n"
    o = up(least)
    return F.least(o, F.greatest(F.lit(1), F.expr(f"({least} - (({num} * {least} + {den - 1}) div {den}) + 2) div 2")))


def _digests(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, lists, at = [], [], [], [], [0]
            for s in tk.shingle_sets(tk.values(batch.column(1)), k):
                a, b = tk.fingerprint(s)
                own = np.zeros(0, np.uint64)
                if len(s):
                    o, l = _limits(len(s), num, den)
                    own = s[: len(s) - o + l]
                n.append(len(s)), f1.append(a), f2.append(b), lists.append(own), at.append(at[-1] + len(own))
            tokens = np.concatenate(lists or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens))],
                names=["doc_id", "n", "f1", "f2", "list"],
            )

    return run


def _sets(k: int):
    """Rows (doc_id, text) to (doc_id, n, tokens): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, packed = [], []
            for s in tk.shingle_sets(tk.values(batch.column(1)), k):
                n.append(len(s)), packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "tokens"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of sets."""
    for batch in batches:
        sets = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(1)]
        sizes = np.array([len(x) for x in sets], np.int64)
        rows = np.repeat(np.arange(len(sets)), sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes[rows]), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)]))], names=["doc_id", "n", "tok"])


class Meeting:
    """Nodes of one block or of two that meet: their sets and B-prefixes, and the links among them."""

    def __init__(self, sets: list[np.ndarray], prefixes: list[np.ndarray], side: np.ndarray | None, num: int, den: int):
        self.num, self.den, self.side = num, den, side
        self.n = np.array([len(s) for s in sets], np.int64)
        own = np.repeat(np.arange(len(sets)), self.n)
        raw = np.concatenate(sets)
        first = np.cumsum(self.n) - self.n
        distinct, tokens = np.unique(raw, return_inverse=True)
        least = self.n - -(-num * self.n // den) + 1  # tokens of a prefix
        by_c = np.lexsort((tk.mix(raw.view(np.uint64) ^ _ORDER_C), own))
        head = np.arange(len(raw)) - np.repeat(first, self.n) < np.repeat(least, self.n)
        self.whole = (tokens, first, self.n)
        self.a = (tokens[head], np.cumsum(least) - least, least)
        self.c = (tokens[by_c][head], self.a[1], least)
        self.flag = np.zeros(len(distinct), bool)
        # postings of B-prefix tokens, by rising node
        holder = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
        names, which = np.unique(np.concatenate(prefixes), return_inverse=True)
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(names)))
        self.postings, self.ends = holder[order], ends
        self.begins = ends - np.bincount(which, minlength=len(names))
        cuts = np.cumsum([0] + [len(p) for p in prefixes])
        self.held = [which[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _common(self, lists: tuple, node: int, others: np.ndarray) -> np.ndarray:
        """How many tokens of node's list each of the others' lists holds."""
        tokens, first, size = lists
        mine = tokens[first[node] : first[node] + size[node]]
        self.flag[mine] = True
        sizes = size[others]
        ends = np.cumsum(sizes)
        hits = self.flag[tokens[np.repeat(first[others] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]]
        self.flag[mine] = False
        return np.add.reduceat(hits, ends - sizes, dtype=np.int64)

    def _linked(self, node: int, others: np.ndarray) -> np.ndarray:
        for lists in (self.a, self.c):
            others = others[self._common(lists, node, others) > 0]
            if not len(others):
                return others
        both = self._common(self.whole, node, others)
        return others[self.den * both >= self.num * (self.n[node] + self.n[others] - both)]

    def forest(self) -> list[tuple[int, int]]:
        """Links that join whatever all links join."""
        root, out = np.arange(len(self.n)), []
        for node in range(1, len(self.n)):
            spans = [self.postings[self.begins[t] : self.ends[t]] for t in self.held[node].tolist()]
            near = np.concatenate(spans)
            near = np.unique(near[near < node])
            if self.side is not None:
                near = near[self.side[near] != self.side[node]]
            lo, hi = np.minimum(self.n[near], self.n[node]), np.maximum(self.n[near], self.n[node])
            near = near[self.den * lo >= self.num * hi]
            step = FIRST_TESTS
            while len(near):
                near = near[root[near] != root[node]]
                if not len(near):
                    break
                now, near, step = near[:step], near[step:], 4 * step
                for other in self._linked(node, now).tolist():
                    if root[other] != root[node]:
                        out.append((node, other))
                        root[root == root[other]] = root[node]
        return out


def _meet(num: int, den: int):
    """Rows (x, y, block, doc_id, tokens, prefix) sorted by (x, y) to the links of each meeting (x, y)."""

    def links(pair: tuple, rows: list[tuple], ids: list) -> pa.RecordBatch:
        x, y = pair
        side = None if x == y else np.array([r[0] == x for r in rows])
        found = Meeting([r[1] for r in rows], [r[2] for r in rows], side, num, den).forest()
        a, b = (pa.concat_arrays(ids).take(pa.array([e[i] for e in found], pa.int64())) for i in range(2))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows, ids = None, [], []
        for batch in batches:
            for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now != pair:
                    if len(rows) > 1:
                        yield links(pair, rows, ids)
                    pair, rows, ids = now, [], []
                rows.append((batch.column(2)[i].as_py(), np.frombuffer(batch.column(4)[i].as_py(), np.int64), batch.column(5)[i].values.to_numpy()))
                ids.append(batch.column(3).slice(i, 1))
        if len(rows) > 1:
            yield links(pair, rows, ids)

    return run


def _near_links(members: DataFrame, sets: DataFrame, num: int, den: int, most_nodes: int, most_tokens: int) -> Written:
    """(a, b): links that join whatever the links between nodes of a common B-prefix token join. members: (tok, doc_id)."""
    kind = members.schema["doc_id"].dataType.simpleString()
    # names that keep a bucket's nodes together: each node takes the least name that its buckets' nodes hold, twice
    name = members.groupBy("tok").agg(F.min("doc_id").alias("name"))
    once = members.join(name, "tok").groupBy("doc_id").agg(F.min("name").alias("name"))
    name = members.join(once, "doc_id").groupBy("tok").agg(F.min("name").alias("name"))
    nodes = members.join(name, "tok").groupBy("doc_id").agg(F.min("name").alias("name"), F.collect_list("tok").alias("prefix"))
    nodes = Written(nodes.join(sets, "doc_id").select("doc_id", "name", "n", "tokens", "prefix"), "nodes")
    # a block is what a hash deals out of the nodes of equal name; a name of more nodes than a block is dealt into parts
    total = nodes.df.agg(F.count("*"), F.sum("n")).first()
    parts = lambda count, size: F.greatest(F.ceil(count / most_nodes), F.ceil(size / most_tokens))
    count = max(1, -(-total[0] // most_nodes), -(-(total[1] or 0) // most_tokens))
    wide = Written(nodes.df.groupBy("name").agg(parts(F.count("*"), F.sum("n")).alias("parts")).where("parts > 1"), "wide")
    part = F.xxhash64("name", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("parts")))
    block = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("name"), F.lit(count))).otherwise(part)
    blocks = Written(nodes.df.select("doc_id", "name").distinct().join(small(wide.df), "name", "left").select("doc_id", block.alias("block")), "blocks")
    # two blocks meet with the nodes that share a token across them
    at = Written(members.join(small(blocks.df), "doc_id").select("tok", "doc_id", "block"), "places")
    apart = at.df.groupBy("tok").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("tok")
    spread = Written(at.df.join(apart, "tok").select("tok", "doc_id", "block"), "spread")
    other = spread.df.select("tok", F.col("block").alias("other")).distinct()
    across = spread.df.join(other, "tok").where("block <> other").select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id").distinct()
    seats = Written(across.unionAll(blocks.df.select(F.col("block").alias("x"), F.col("block").alias("y"), "block", "doc_id")), "seats")
    met = seats.df.join(nodes.df.select("doc_id", "tokens", "prefix"), "doc_id").select("x", "y", "block", "doc_id", "tokens", "prefix")
    found = Written(met.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(_meet(num, den), f"a {kind}, b {kind}"), "links")
    for w in (nodes, wide, blocks, at, spread, seats):
        w.drop()
    return found


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, most_nodes: int = BLOCK_NODES, most_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles (A-Z lower-cased;
    a text of fewer words is one shingle). component_id is the smallest doc_id reachable by links, itself included. Null,
    empty and blank texts have no shingles and link with nothing; an empty table gives no rows. Texts of any length are
    taken whole. A row without doc_id links with nothing and has a null component. Rows that repeat a doc_id are one node:
    what links with one of them is in the component of all. Other columns are ignored, whatever their names. Shingles are
    told apart by 64 bits, sets by 128."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = Written(docs.select("doc_id", "text").mapInArrow(_digests(k, num, den), f"doc_id {kind}, n long, f1 long, f2 long, list array<long>"), "digests")
    nodes = digest.df.where("n > 0 AND doc_id IS NOT NULL")
    copies = Written(nodes.groupBy("f1", "f2").agg(F.count("*").alias("c"), F.min("doc_id").alias("rep")).where("c > 1").select("f1", "f2", "rep"), "copies")
    named = nodes.join(small(copies.df), ["f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    # a doc_id that stands for several sets ties their components together
    many = nodes.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id")
    ties = Written(named.select("doc_id", "rep").where("doc_id <> rep").join(many, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ties")

    # order A: nodes whose lists share enough tokens with other lists
    tokens = named.where("doc_id = rep").select("doc_id", "n", F.explode("list").alias("tok"))
    held = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1").select("tok")
    shared = tokens.join(held, "tok").groupBy("doc_id", "n").agg(F.count("*").alias("s")).withColumn("least_n", F.expr(f"({num} * n + {den - 1}) div {den}"))
    ids = Written(shared.where(F.col("s") >= _need(F.col("least_n"), num, den)).select(F.col("doc_id").alias("__lf_id")).distinct(), "open-ids")
    digest_ids = Written(digest.df.select("doc_id", "n", "f1", "f2"), "digest-ids")
    digest.drop()
    text = docs.select("doc_id", "text").join(small(ids.df), F.col("doc_id") == F.col("__lf_id"), "left_semi")
    sets = Written(text.mapInArrow(_sets(k), f"doc_id {kind}, n long, tokens binary").where("n > 0"), "sets")
    ids.drop()

    # order B: rarest first in whole sets; o tokens of n must be shared, so the first n - o + 1 hold one of them
    tokens = sets.df.select("doc_id", "tokens").mapInArrow(_tokens, f"doc_id {kind}, n long, tok long")
    held = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(held, "tok").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("list"))
    slots = (F.size("list") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1).cast("int")
    members = Written(ranked.where(slots > 0).select("doc_id", F.explode(F.slice("list", F.lit(1), slots)).alias("x")).select("doc_id", F.col("x.tok").alias("tok")), "members")
    twice = members.df.groupBy("tok").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    open_ = Written(members.df.join(twice.select("tok"), "tok").distinct(), "open")
    members.drop()
    links = _near_links(open_.df, sets.df, num, den, most_nodes, most_tokens)
    open_.drop()
    sets.drop()

    labels = Written(components(ties.df.unionAll(links.df)).where("node <> component"), "labels")
    ties.drop()
    links.drop()
    out = digest_ids.df.join(small(copies.df), ["f1", "f2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    result = out.join(small(labels.df), out["rep"] == labels.df["node"], "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: of the rows that hold its smallest doc_id, the one of least text hash, then of
    least text and least other columns as JSON.

    Rows without shingles are components of their own and stay, one for each doc_id that repeats; rows without doc_id all
    stay; an empty table stays empty. Texts of any length are compared whole; all columns are kept, whatever their names."""
    found = jaccard_components(docs, k, num, den)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__lf_id")).distinct()
    again = Written(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__lf_id")).agg(F.count("*").alias("__lf_c")).where("__lf_c > 1").select("__lf_id"), "repeated-ids")
    left = docs.join(gone, docs["doc_id"] == gone["__lf_id"], "left_anti")
    repeated = small(again.df)
    if again.df.isEmpty():
        return left
    single = left.join(repeated, left["doc_id"] == repeated["__lf_id"], "left_anti")
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = F.struct(F.xxhash64("text"), F.col("text"), F.to_json(row))
    picked = left.join(repeated, left["doc_id"] == repeated["__lf_id"], "left_semi").groupBy(F.col("doc_id").alias("__lf_id")).agg(F.min_by(row, first).alias("__lf_row"))
    return single.unionAll(picked.select(*[F.col(f"__lf_row.`{c}`").alias(c) for c in docs.columns]))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS tok FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE q(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT q.node, u.b FROM q JOIN u ON q.reach = u.a) SELECT node, min(reach) AS component_id FROM q GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, r.component_id FROM n JOIN r ON r.node = n.doc_id
"""
