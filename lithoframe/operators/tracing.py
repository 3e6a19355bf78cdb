"""Lines and rings of gridded surfaces, traced by tiles.

A tile's squares give directed edges: pieces of level lines with the higher side on their left, and for bands also the pieces of the
surface's own border. Ends are named by the grid side or corner they lie on, so what meets is decided by whole numbers. Each tile chains
its edges to paths; paths that end at a tile's border are chained on in larger and larger tiles, by their ends alone, while their
coordinates stay where they are. Only a finished line or ring is ever brought together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut

#: Squares along a tile, and tiles along a larger tile.
TILE, WIDER = 64, 8

#: The ends of a square's pieces by which corners are up (upper left 8, upper right 4, lower right 2, lower left 1), the up side on the
#: left; sides are top 0, right 1, bottom 2, left 3. Of the two squares with opposite corners up, the second form is for a low middle.
PIECES = {1: ((2, 3),), 2: ((1, 2),), 3: ((1, 3),), 4: ((0, 1),), 6: ((0, 2),), 7: ((0, 3),), 8: ((3, 0),), 9: ((2, 0),), 11: ((1, 0),), 12: ((3, 1),), 13: ((2, 1),), 14: ((3, 2),)}
SADDLES = {5: (((0, 3), (2, 1)), ((0, 1), (2, 3))), 10: (((1, 0), (3, 2)), ((3, 0), (1, 2)))}

PATH = "g int, ti int, tj int, pid bigint, s bigint, e bigint, xs array<double>, ys array<double>, rows array<int>, places array<double>, ties array<int>"


class _Tile:
    """The values of a tile's squares and of one ring of squares around them; vertex (0, 0) is at (row, col) of the grid."""

    def __init__(self, pdf: pd.DataFrame, ti: int, tj: int, side: int):
        self.row, self.col, self.side = ti * side - 1, tj * side - 1, side
        shape = (side + 3, side + 3)
        self.v, self.x, self.y = (np.full(shape, np.nan) for _ in range(3))
        at = (pdf["row"].to_numpy() - self.row, pdf["col"].to_numpy() - self.col)
        self.v[at], self.x[at], self.y[at] = pdf["value"], pdf["x"], pdf["y"]
        ok = np.isfinite(self.v)
        self.valid = ok[:-1, :-1] & ok[:-1, 1:] & ok[1:, 1:] & ok[1:, :-1]
        self.own = self.valid.copy()
        self.own[[0, -1]] = False
        self.own[:, [0, -1]] = False

    def key(self, r: np.ndarray, c: np.ndarray, kind) -> np.ndarray:
        return ((r + self.row).astype(np.int64) << 36) | ((c + self.col).astype(np.int64) << 8) | kind

    def crossing(self, r: np.ndarray, c: np.ndarray, side, t: float, kind: int) -> tuple[np.ndarray, ...]:
        """(key, x, y, place along the row or -1, tie) of where level t crosses a side of squares (r, c); the same from both sides."""
        side = np.broadcast_to(side, r.shape)
        r, c, flat = np.where(side == 2, r + 1, r), np.where(side == 1, c + 1, c), side % 2 == 0
        r2, c2 = np.where(flat, r, r + 1), np.where(flat, c + 1, c)
        a, b = self.v[r, c], self.v[r2, c2]
        f = (t - a) / (b - a)
        x, y = self.x[r, c] + f * (self.x[r2, c2] - self.x[r, c]), self.y[r, c] + f * (self.y[r2, c2] - self.y[r, c])
        return self.key(r, c, np.where(flat, kind, kind + 1)), x, y, np.where(flat, c + self.col + f, -1.0), np.where(f >= 1, -1, np.where(f <= 0, 1, 0))

    def pieces(self, t: float, kind: int, back: bool = False) -> Iterator[tuple]:
        """Edges (start, end) of level t in the own squares."""
        if not math.isfinite(t):
            return
        up = (self.v >= t).astype(int)
        case = np.where(self.own, up[:-1, :-1] * 8 + up[:-1, 1:] * 4 + up[1:, 1:] * 2 + up[1:, :-1], 0)
        for k in np.unique(case).tolist():
            if k in PIECES:
                groups = [(PIECES[k], case == k)]
            elif k in SADDLES:
                high = (self.v[:-1, :-1] + self.v[:-1, 1:] + self.v[1:, 1:] + self.v[1:, :-1]) / 4 >= t
                groups = [(SADDLES[k][0], (case == k) & high), (SADDLES[k][1], (case == k) & ~high)]
            else:
                continue
            for ends, where in groups:
                r, c = np.nonzero(where)
                if len(r):
                    for a, b in ends:
                        one, two = self.crossing(r, c, a, t, kind), self.crossing(r, c, b, t, kind)
                        yield (two, one) if back else (one, two)

    def corner(self, r: np.ndarray, c: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
        """A corner as the end of border pieces. Where just two opposite squares meet in it, each has a corner of its own."""
        q = self.valid
        around = [q[r - 1, c - 1], q[r - 1, c], q[r, c], q[r, c - 1]]
        apart = (around[0] & around[2] & ~around[1] & ~around[3]) | (around[1] & around[3] & ~around[0] & ~around[2])
        return self.key(r, c, 8 + (apart & down)), self.x[r, c], self.y[r, c], (c + self.col).astype(float), np.zeros(len(r), int)

    def border(self, lo: float, hi: float) -> Iterator[tuple]:
        """Edges along the surface's own border where it lies in [lo, hi), the surface on their left."""
        n = self.side + 2
        for side, (dr, dc), (pr, pc), (qr, qc) in ((0, (-1, 0), (0, 1), (0, 0)), (3, (0, -1), (0, 0), (1, 0)), (2, (1, 0), (1, 0), (1, 1)), (1, (0, 1), (1, 1), (0, 1))):
            beside = np.zeros_like(self.valid)
            beside[max(0, -dr) : n - max(0, dr), max(0, -dc) : n - max(0, dc)] = self.valid[max(0, dr) : n + min(0, dr), max(0, dc) : n + min(0, dc)]
            r, c = np.nonzero(self.own & ~beside)
            p, q = self.v[r + pr, c + pc], self.v[r + qr, c + qc]
            part = ~((p < lo) & (q < lo)) & ~((p >= hi) & (q >= hi))
            r, c, p, q = r[part], c[part], p[part], q[part]
            if not len(r):
                continue
            start, end = self.corner(r + pr, c + pc, np.full(len(r), pr == 0)), self.corner(r + qr, c + qc, np.full(len(r), qr == 0))
            for t, kind, out_p, out_q in ((lo, 0, p < lo, q < lo), (hi, 2, p >= hi, q >= hi)):
                if math.isfinite(t) and (out_p | out_q).any():
                    with np.errstate(divide="ignore", invalid="ignore"):
                        at = self.crossing(r, c, side, t, kind)
                    start = tuple(np.where(out_p, a, s) for a, s in zip(at, start))
                    end = tuple(np.where(out_q, a, s) for a, s in zip(at, end))
            yield start, end

    def row_of(self, key: np.ndarray) -> np.ndarray:
        return (key >> 36).astype(np.int32)


def chains(s: np.ndarray, e: np.ndarray) -> list[list[int]]:
    """Edges or paths with ends s, e in the order they follow each other; an end is the start of one other at most. A chain that
    comes back to its start is a ring and begins at its smallest start."""
    order = np.argsort(s, kind="stable")
    at = np.minimum(np.searchsorted(s[order], e), max(0, len(s) - 1))
    nxt = np.where(s[order][at] == e, order[at], -1) if len(s) else np.zeros(0, int)
    heads = np.ones(len(s), bool)
    heads[nxt[nxt >= 0]] = False
    nxt, done, out = nxt.tolist(), bytearray(len(s)), []
    for i in [*np.flatnonzero(heads).tolist(), *order.tolist()]:
        if not done[i]:
            chain = []
            while i >= 0 and not done[i]:
                done[i] = 1
                chain.append(i)
                i = nxt[i]
            out.append(chain)
    return out


def paths(surface: DataFrame, groups: list[tuple[float, float | None]], side: int = TILE) -> DataFrame:
    """PATH rows of each tile: for (t, None) the lines of level t, for (lo, hi) the border of the band from lo to below hi. Cells
    of a missing or non-finite value are outside the surface."""

    def trace(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = (int(k) for k in key)
        tile, out = _Tile(pdf, ti, tj, side), []
        if tile.own.any():
            for g, (lo, hi) in enumerate(groups):
                edges = [*tile.pieces(lo, 0)]
                if hi is not None:
                    edges += [*tile.pieces(hi, 2, back=True), *tile.border(lo, hi)]
                if not edges:
                    continue
                start, end = ([np.concatenate(x) for x in zip(*(e[k] for e in edges))] for k in (0, 1))
                for k, chain in enumerate(chains(start[0], end[0])):
                    node = [np.append(a[chain], b[chain[-1]]) for a, b in zip(start, end)]
                    flat = np.flatnonzero(node[3][:-1] >= 0) if hi is not None else np.zeros(0, int)  # the next path begins with the last
                    pid = (ti << 44) | (tj << 24) | (len(out) & 0xFFFFFF)
                    out.append((g, ti, tj, pid, node[0][0], node[0][-1], node[1], node[2], tile.row_of(node[0][flat]), node[3][flat], node[4][flat].astype(np.int32)))
        return pd.DataFrame(out, columns=["g", "ti", "tj", "pid", "s", "e", "xs", "ys", "rows", "places", "ties"])

    def tiles(n: str):
        return F.explode(F.sequence(F.greatest(F.floor((F.col(n) - 2) / side), F.lit(0)).cast("int"), F.floor((F.col(n) + 1) / side).cast("int")))

    known = surface.where("value IS NOT NULL").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])
    return known.withColumn("ti", tiles("row")).withColumn("tj", tiles("col")).groupBy("ti", "tj").applyInPandas(trace, PATH)


def joined(made: DataFrame, wider: int = WIDER) -> DataFrame:
    """(g, chain, members): the pids of each finished line or ring of tile paths, in order. Each round meets the ends that are still
    open in tiles wider times as wide, so a task holds what crosses one wide tile's inner borders."""
    ends = made.select("g", "ti", "tj", "s", "e", F.array("pid").alias("members"))
    done, now = [ends.where("s = e")], ends.where("s <> e")
    wide = (made.agg(F.max(F.greatest("ti", "tj")).alias("m")).first()["m"] or 0) + 1

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s, e, members = pdf["s"].to_numpy(), pdf["e"].to_numpy(), pdf["members"].tolist()
        out = [(*key, s[c[0]], e[c[-1]], np.concatenate([members[i] for i in c])) for c in chains(s, e)]
        return pd.DataFrame(out, columns=["g", "ti", "tj", "s", "e", "members"])

    while wide > 1:
        wide = -(-wide // wider)
        now = now.withColumn("ti", F.floor(F.col("ti") / wider).cast("int")).withColumn("tj", F.floor(F.col("tj") / wider).cast("int"))
        now = cut(now.groupBy("g", "ti", "tj").applyInPandas(meet, "g int, ti int, tj int, s bigint, e bigint, members array<bigint>"))
        done.append(now.where("s = e"))
        now = now.where("s <> e")
    out = now
    for d in done:
        out = out.unionByName(d)
    return out.select("g", F.col("members")[0].alias("chain"), (F.col("s") == F.col("e")).alias("closed"), "members")


def _drawn(made: DataFrame, whole: DataFrame) -> DataFrame:
    """(g, chain, closed, xs, ys) of chains; closed ones repeat their first point."""
    parts = whole.select("g", "chain", "closed", F.posexplode("members").alias("pos", "pid")).join(made.select("pid", "xs", "ys"), "pid")
    held = parts.groupBy("g", "chain", "closed").agg(F.array_sort(F.collect_list(F.struct("pos", "xs", "ys"))).alias("p"))
    line = lambda c: F.concat(F.flatten(F.transform("p", lambda p: F.slice(p[c], 1, F.size(p[c]) - 1))), F.slice(F.element_at("p", -1)[c], -1, 1))
    return held.select("g", "chain", "closed", line("xs").alias("xs"), line("ys").alias("ys"))


def level_lines(surface: DataFrame, levels: list[float], side: int = TILE, wider: int = WIDER) -> DataFrame:
    """(g, chain, closed, xs, ys): each level's lines; g is the level's place in levels."""
    made = cut(paths(surface, [(float(t), None) for t in levels], side))
    return _drawn(made, joined(made, wider))


def band_rings(surface: DataFrame, edges: list[float], tiny: float = 0.0, side: int = TILE, wider: int = WIDER) -> DataFrame:
    """(g, ring, outer, xs, ys): the rings around the bands between neighbouring edges; outer is the ring's own id for outer rings,
    that of the ring around it for holes.

    Left of a hole's first place on a grid row its band goes on until the next ring of the band; that is its outer ring, or another hole of
    the same, which is followed on in turn. Rings of at most the area tiny, where the surface just touches a level, are taken as
    holes; nothing lies in them. A ring without a place on a grid row is an outer one: it runs across the surface between two rows."""
    made = cut(paths(surface, list(zip(edges[:-1], edges[1:])), side))
    whole = cut(joined(made, wider))
    sense = surface.agg((F.signum(F.covar_pop("col", "x")) * F.signum(F.covar_pop("row", -F.col("y")))).alias("s")).first()["s"] or 1.0
    rings = cut(_turns(_drawn(made, whole)).withColumn("turn", F.col("turn") * sense))
    nodes = made.select("g", "pid", F.explode(F.arrays_zip("rows", "places", "ties")).alias("n")).join(whole.select(F.explode("members").alias("pid"), F.col("chain").alias("ring")), "pid")
    place = F.struct("n.rows", "n.places", "n.ties")
    left = F.lag("ring").over(W.partitionBy("g", "n.rows").orderBy("n.places", "n.ties", "ring"))
    first = nodes.where("n.places >= 0").select("g", "ring", place.alias("place"), left.alias("left")).groupBy("g", "ring").agg(F.min_by("left", "place").alias("left"))
    kinds = rings.select("g", "ring", "turn")
    link = kinds.join(first, ["g", "ring"], "left").select("g", "ring", F.when(F.col("turn") > tiny, F.col("ring")).otherwise(F.col("left")).alias("outer"))
    link = cut(link)
    while True:
        nxt = link.select("g", F.col("ring").alias("outer"), F.col("outer").alias("further"))
        moved = cut(link.join(nxt, ["g", "outer"], "left").select("g", "ring", F.coalesce("further", "outer").alias("outer")))
        if not moved.exceptAll(link).limit(1).count():
            break
        link = moved
    return rings.join(link, ["g", "ring"]).select("g", "ring", "outer", "xs", "ys", "turn")


def _turns(rings: DataFrame) -> DataFrame:
    """(g, ring, xs, ys, turn): turn is the signed area, above 0 around a part of the band where y falls from row to row."""
    n = F.size("xs") - 1
    dx, dy = lambda i: F.col("xs")[i] - F.col("xs")[0], lambda i: F.col("ys")[i] - F.col("ys")[0]
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + dx(i) * dy(i + 1) - dx(i + 1) * dy(i))
    return rings.select("g", F.col("chain").alias("ring"), "xs", "ys", (twice / 2).alias("turn"))
