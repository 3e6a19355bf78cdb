import random
import re

import numpy as np

from lithoframe.llm import ngram_join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    comp = {i: i for i, _ in rows if i is not None}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                comp[hi] = lo
    return {i: root(i) for i in comp}


def near_copies(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 30, 80, 200]))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((i, " ".join(t).title()))
            i += 1
    r.shuffle(rows)
    return rows


def test_components_equal_brute_force(docs_of):
    rows = near_copies(5, 60) + [(900, None), (901, ""), (902, " \n\t"), (903, "A b"), (904, "a B"), (None, "a b"), (905, "é à"), (905, "one more text of this id"), (906, "one more text of this id"), (907, "É à")]
    got = ngram_join.jaccard_components(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    sizes = {(i, len(shingles(t, 4))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def kin(seed, n, words, share):
    """Texts that all hold a part of one passage, so that pairs lie on both sides of the threshold."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(r.randint(0, int(words * share))):
            t[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    return rows


def test_a_large_group_about_the_threshold_and_a_long_text(docs_of):
    r = random.Random(2)
    long = [f"l{r.randrange(9000)}" for _ in range(20_000)]
    other = list(long)
    for _ in range(150):
        other[r.randrange(len(other))] = "y"
    rows = kin(1, 250, 60, 0.06) + [(1000, " ".join(long)), (1001, " ".join(other)), (1002, " ".join(long[:15_000]))]
    want = brute(rows, 4, 85, 100)
    assert 10 < len(set(want.values())) < 240 and want[1001] == 1000 != want[1002]
    for size in (7, 1024):
        got = ngram_join.jaccard_components(docs_of(rows), most_nodes=size).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_a_meeting_joins_what_links_join():
    rows = kin(3, 120, 40, 0.08)
    sets = [np.sort(np.array([hash(s) for s in shingles(t, 4)], np.int64).view(np.uint64)).view(np.int64) for _, t in rows]
    side = np.array([i % 3 == 0 for i in range(len(rows))])
    for own in (None, side):
        found = ngram_join.Meeting(sets, sets, own, 85, 100).forest()
        links = {(i, j) for i in range(len(sets)) for j in range(i) if (own is None or own[i] != own[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        assert set(found) <= links and len(found) < len(sets)
        parts = [list(range(len(sets))) for _ in range(2)]
        for part, edges in zip(parts, (found, links)):
            for a, b in sorted(edges):
                lo, hi = sorted((part[a], part[b]))
                part[:] = [lo if p == hi else p for p in part]
        assert parts[0] == parts[1]


def test_one_document_of_each_group_stays(docs_of):
    rows = near_copies(6, 30)
    want = brute(rows, 5, 80, 100)
    got = ngram_join.one_of_each(docs_of(rows))
    assert got.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in want.items() if i == c)


def test_one_row_of_each_repeated_id_stays(docs_of):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (3, None), (None, "a b c d e f g h"), (4, "x y z"), (4, "z y x w v u")]
    got = ngram_join.one_of_each(docs_of(rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, 4, None]


def test_empty(docs_of):
    assert ngram_join.one_of_each(docs_of([])).count() == 0
    assert ngram_join.jaccard_components(docs_of([])).count() == 0
