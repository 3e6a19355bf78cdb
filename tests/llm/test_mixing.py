import re

import pyarrow.parquet as pq
import pytest
import xxhash

from lithoframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, rest = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        capped |= over


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x") for i, s, t in rows], "doc_id long, source string, text string, size int, target string")


ROWS = (
    [(i, "big", "word " * (i % 90)) for i in range(300)] + [(i, "tiny", "a b c") for i in range(300, 303)] + [(i, None, "x " * 40) for i in range(303, 340)]
    + [(i, "ñ", None) for i in range(340, 345)] + [(345, "z", " \n\t"), (346, "", "one two"), (346, "", "one two"), (None, "big", "no id here")] + [(400, "zz", "long " * 5000)]
)


def test_targets_takes_and_order(spark):
    got = mixing.mix(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes, of = {}, {}
    for i, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        of[i] = s
    want, taken = brute_targets(sizes), {}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= sum(sizes.values())) and len(r.positions) == r.passes and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert [r.position is None for r in got] == sorted(r.position is None for r in got)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed)
    again = mixing.mix(table(spark, ROWS[::-1])).collect()
    key = lambda r: (str(r.doc_id), r.taken, r.position or 0.0)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows_and_empty(spark):
    df = table(spark, ROWS)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix(df).collect():
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + int(r.taken / r["size"] + 0.5)
    assert times == {i: n for i, n in want.items() if n}
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0


def test_one_source_is_taken_once(spark):
    rows = [(i, "only", "w " * i) for i in range(1, 50)]
    assert all(r.taken == r["size"] for r in mixing.mix(table(spark, rows)).collect())


def plain_order(doc_id, text, seed=mixing.SEED):
    """The seeded hash order of a document: XXH64 over seed, id and the text's own hash, nulls left out, as a signed number."""
    h = lambda data, at: xxhash.xxh64_intdigest(data, seed=at)
    own = 42 if text is None else h(text.encode(), 42)
    at = h(seed.to_bytes(4, "little"), 42)
    at = at if doc_id is None else h(doc_id.to_bytes(8, "little", signed=True), at)
    at = h(own.to_bytes(8, "little"), at)
    return at - (1 << 64) if at >> 63 else at


def brute_mix(rows):
    """[(doc_id, size, taken, positions)]: each source's reel played word by word count, times found by bisection, and what all
    sources have given by a time added up."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    reels = {}
    for i, s, t in rows:
        reels.setdefault(s, []).append((plain_order(i, t), -1 if i is None else i, i, words(t)))
    target = brute_targets({s: sum(r[3] for r in reel) for s, reel in reels.items()})
    names = sorted(s for s in reels if s is not None) + ([None] if None in reels else [])
    slopes = {s: mixing.SLOPES[rank % 3] for rank, s in enumerate(names)}
    given = lambda s, t: target[s] * ((1 + slopes[s]) * t - slopes[s] * t * t)
    out = []
    for s in names:
        total, goal, at = sum(r[3] for r in reels[s]), target[s], 0
        for _, _, i, n in sorted(reels[s]):
            # pass after pass, this document lies at [at + pass * total, + n) of the endless reel
            parts = [max(0, min(n, int(goal + 0.5) - at - p * total)) for p in range(4)] if total else []
            places = []
            for p, part in enumerate(parts):
                if part:
                    lo, hi = 0.0, 1.0
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if given(s, mid) < at + p * total else (lo, mid)
                    places.append(sum(given(x, hi) for x in names))
            out.append((i, n, sum(parts), places))
            at += n
    return out


def test_every_document_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 40)  # several buckets a source
    documents = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for rows in (ROWS, documents):
        key = lambda r: (str(r[0]), r[1], r[2], r[3])
        got = sorted(((r.doc_id, r["size"], r.taken, list(r.positions)) for r in mixing.mix(table(spark, rows)).collect()), key=key)
        want = sorted(brute_mix(rows), key=key)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert all(a[3] == pytest.approx(b[3], abs=1e-5) for a, b in zip(got, want))


def test_mixed_documents_come_in_the_order_of_their_positions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "RANGE_WORDS", 1_000)
    rows = [(i, f"s{i % 5}", f"w{i} " * (1 + i % 37)) for i in range(400)]
    mixing.mixed_documents(table(spark, rows)).write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("part-*.parquet"))
    seen = [i for f in files for i in pq.ParquetFile(f).read(["doc_id"]).column(0).to_pylist()]
    places = {r.doc_id: (list(r.positions), int(r.taken / r["size"] + 0.5)) for r in mixing.mix(table(spark, rows)).collect()}
    want = sorted((p, i) for i, (at, n) in places.items() for p in at[:n])
    at = {i: iter(p) for i, (p, _) in places.items()}
    order = [next(at[i]) for i in seen]
    assert order == sorted(order) and len(seen) == len(want) and len(files) > 4
    # the curriculum: a source of falling weight gives more in the first half of the words than one of rising weight
    half = sum(len(rows[i][2].split()) for i in seen) / 2
    early = {s: sum(p < half for p, i in want if rows[i][1] == s) / sum(rows[i][1] == s for _, i in want) for s in ("s0", "s2")}
    assert early["s0"] < 0.5 < early["s2"] - 0.05
