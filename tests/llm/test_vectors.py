"""Exact top-k search and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from lithoframe.llm import neardup, topk


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "extra") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, score string")


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(1000, None, 1), (1050, [nan] + [0.0] * 15, 1), (1100, [inf] * 16, 2), (1150, [None] * 16, 1), (1200, [0.0] * 16, 1), (1250, [0.5] * 16, None)]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = [(i, r.normal(size=16).astype(np.float32).tolist(), int(r.integers(3))) for i in range(260)]
    base = r.normal(size=16)
    out += [(300 + i, (base + r.normal(size=16) * 0.03 * (i % 4)).astype(np.float32).tolist(), 1) for i in range(60)]
    out += [(400 + i, base.astype(np.float32).tolist(), 1 + i % 2) for i in range(40)]
    out += [(500 + i, (2.0 * base).astype(np.float32).tolist(), 2) for i in range(3)]
    return out + odd_rows()


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark, rows):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect()}
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if usable(v)}
    want = {}
    for i in (i for i in q if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:5]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want


def test_branch_and_bound_alone_with_ties_and_wide_numbers():
    r = np.random.default_rng(6)
    for scale in (3, 300, 2**24, 2**28, 2**40, 2**62):
        c = r.integers(-scale, scale + 1, (40, 500))
        q = np.concatenate((c[:, :7], r.integers(-scale, scale + 1, (40, 3))), axis=1)
        qi, ci, sc = topk._search(np.array([*range(7), 900, 901, 902]), q, np.arange(500), c, 5)
        exact = c.astype(object).T @ q.astype(object)
        for i in range(10):
            exact[:, i] = np.clip(exact[:, i], -(2**63), 2**63 - 1)
            want = sorted((j for j in range(500) if j != i or i >= 7), key=lambda j: (-exact[j, i], j))[:5]
            assert sorted(ci[qi == i].tolist(), key=lambda j: (-exact[j, i], j)) == want
            assert sorted(sc[qi == i].tolist(), reverse=True) == [exact[j, i] for j in want]


def test_top_k_of_repeated_empty_and_ragged_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [0.5], 1), (50, [], 1), (1, [3.0, 1.0], 1), (1, [3.0, 1.0], 1), (1, [0.0, 9.0], 1), (2, [1.0, 1.0, 7.0], 1), (3, [], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect())
    q = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    want = []
    for i in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for n, v in q if n == i for j, w in q if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want


def test_top_k_of_few_and_none(spark):
    got = topk.top_k(frame(spark, [(0, [1.0], 1), (1, [2.0], 1), (0, [1.0], 1)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(frame(spark, [])).count() == 0 and topk.top_k(frame(spark, [(7, [1.0], 1)])).count() == 0


def brute(rows):
    fine = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if usable(v) and lab is not None and any(v)]
    links, comp = {}, {i: i for i, _, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, x, p) in enumerate(fine):
        for j, y, q in fine[:a]:
            if p == q and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                lo, hi = sorted((root(i), root(j)))
                comp[hi] = lo
    return {i: (links.get(i, 0), root(i), root(i) == i) for i in comp}


def test_near_duplicates_equal_brute_force(spark, rows):
    for block in (256, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), block=block).collect()}
        assert got == brute(rows)


def test_near_duplicates_of_none_and_repeats(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    got = neardup.near_duplicates(frame(spark, [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_links_of_vectors_with_a_common_direction(spark):
    r = np.random.default_rng(9)
    u = r.normal(size=(6000, 64))
    u = u / np.linalg.norm(u, axis=1)[:, None] * math.sqrt(0.1)
    u[:, 0] += math.sqrt(0.9)
    u /= np.linalg.norm(u, axis=1)[:, None]
    side = r.normal(size=(3000, 64))
    side -= (side * u[:3000]).sum(axis=1)[:, None] * u[:3000]
    u[3000:] = 0.981 * u[:3000] + math.sqrt(1 - 0.981**2) * side / np.linalg.norm(side, axis=1)[:, None]
    u = u.astype(np.float32)
    x = u.astype(float) / np.linalg.norm(u.astype(float), axis=1)[:, None]
    links = x @ x.T >= 0.98
    np.fill_diagonal(links, False)
    label = np.arange(6000)
    while (new := np.minimum(label, np.where(links, label[None, :], 6000).min(axis=1))).tolist() != label.tolist():
        label = new
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(u)]), block=16).collect()}
    assert got == {i: (int(links[i].sum()), int(label[i])) for i in range(6000)}


def test_recall_of_a_large_label_that_points_one_way(spark):
    """20,000 vectors of one label, their mean cosine about 0.8, half of them just within reach of another: at least 0.9 of all links
    between them are found with the parameters of the query, and none that is not there."""
    r = np.random.default_rng(12)
    n, d = 20_000, 64
    spread = np.linspace(2.0, 0.2, d)  # some directions vary more than others
    u = r.normal(size=(n, d)) * spread
    u = u / np.linalg.norm(u, axis=1)[:, None] * math.sqrt(0.2)
    u[:, 0] += math.sqrt(0.8)
    u /= np.linalg.norm(u, axis=1)[:, None]
    half = n // 2
    side = r.normal(size=(half, d)) * spread
    side -= (side * u[:half]).sum(axis=1)[:, None] * u[:half]
    cos = r.uniform(0.9802, 0.99, half)[:, None]
    u[half:] = cos * u[:half] + np.sqrt(1 - cos**2) * side / np.linalg.norm(side, axis=1)[:, None]
    u = u.astype(np.float32)
    x = u.astype(float) / np.linalg.norm(u.astype(float), axis=1)[:, None]
    links = np.concatenate([((x[k : k + 2000] @ x.T) >= 0.98).sum(axis=1) - 1 for k in range(0, n, 2000)])
    got = {g.vec_id: g.n_links for g in neardup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(u)], "vec_id long, embedding array<float>, label long")).collect()}
    assert links.sum() >= n and all(got[i] <= links[i] for i in range(n))
    recall = sum(got.values()) / links.sum()
    print(f"recall {recall:.4f} of {links.sum()} links")
    assert recall >= 0.9
