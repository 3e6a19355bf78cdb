import hashlib
import random
import threading

import pytest

from lithoframe.llm import sharding


def test_rows_survive_and_shards_reach_the_target(docs_of):
    rows = [(i, None if i % 50 == 0 else f"text {i} " * (i % 70)) for i in range(600)] + [(None, "x"), (5, "again")]
    df = docs_of(rows).repartition(24)
    got = sharding.shard_digest(df, target_bytes=8_000).collect()
    want = sorted(((i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text_sha256) for r in got), key=str) == want
    sizes = {r.shard: r.shard_bytes for r in got}
    assert 2 < len(sizes) < 24 and max(sizes.values()) <= 16_000
    assert all(sum(r.shard == s for r in got) == n for s, n in {(r.shard, r.shard_rows) for r in got})


def test_names_that_clash_and_long_texts_stay(spark, tmp_path):
    rows = [(1, "x" * 300_000, {"file_name": "a"}, 5), (None, "", None, None)]
    df = spark.createDataFrame([(i, t, (m or {}).get("file_name"), z) for i, t, m, z in rows], "doc_id long, text string, _metadata string, __lf_none int")
    store, now = sharding.shard_documents(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, store.read(df.schema).collect()), key=str) == sorted([(1, "x" * 300_000, "a", 5), (None, "", None, None)], key=str)
    assert sum(s["rows"] for s in now["shards"]) == 2 and sharding.shard_digest(df).count() == 2


def plan_by_tiers(sizes, target, fan_in, ratio):
    """Sizes of the groups that merge, plainly: from the smallest tier on, shards by size are packed up to 5/4 of the target."""
    tiers = {}
    for n in sorted(sizes):
        t = 0 if n >= target * 3 // 4 else next(k for k in range(1, 99) if n * ratio**k > target)
        tiers.setdefault(t, []).append(n)
    tiers.pop(0, None)
    out = []
    for t in sorted(tiers, reverse=True):
        runs = [[]]
        for n in tiers[t]:
            if runs[-1] and sum(runs[-1]) + n > target * 5 // 4:
                runs.append([])
            runs[-1].append(n)
        out += [r for r in runs if len(r) >= fan_in or (len(r) > 1 and sum(r) >= target * 3 // 4)]
    return out


def test_plans_equal_the_plain_rule(spark, tmp_path):
    r = random.Random(1)
    store = sharding.Store(spark, f"file://{tmp_path}/p", target_bytes=1000, fan_in=3)
    for _ in range(200):
        sizes = [r.choice([3, 17, 40, 90, 260, 400, 700, 751, 900, 2000]) + r.randrange(9) for _ in range(r.randrange(40))]
        shards = [{"path": f"{i:03d}", "bytes": n, "rows": 1, "tier": store.tier(n)} for i, n in enumerate(sizes)]
        assert [[s["bytes"] for s in g] for g in store.plan(shards)] == plan_by_tiers(sizes, 1000, 3, sharding.RATIO)
        sealed = store.plan(shards, final=True)
        assert all(len(g) > 1 and all(s["tier"] > 0 for s in g) for g in sealed)


def test_versions_appends_and_conflicts(spark, docs_of, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target_bytes=10_000)
    one = store.append(docs_of([(1, "a")]).coalesce(1))
    two = store.append(docs_of([(2, "b")]).coalesce(1))
    schema = docs_of([]).schema
    assert (one["version"], two["version"]) == (1, 2)
    assert {r.doc_id for r in store.read(schema).collect()} == {1, 2} and {r.doc_id for r in store.read(schema, 1).collect()} == {1}
    with pytest.raises(sharding.Conflict):
        store.commit(1, [])
    for i in range(3, 7):
        store.append(docs_of([(i, "c" * i)]).coalesce(1))
    merged = store.compact(schema=schema)
    assert merged["version"] == 7 and len(merged["shards"]) == 1
    assert store.compact(schema=schema)["version"] == 7
    assert store.vacuum(7) == 6 and sorted(r.doc_id for r in store.read(schema).collect()) == list(range(1, 7))


def test_one_of_several_writers_wins(spark, tmp_path):
    for race in range(40):
        store = sharding.Store(spark, f"file://{tmp_path}/r{race}")
        won, gate = [], threading.Barrier(4)

        def write(k, store=store, won=won, gate=gate):
            gate.wait()
            try:
                store.commit(0, [{"path": str(k), "rows": 1, "bytes": 1, "tier": 1}])
                won.append(k)
            except sharding.Conflict:
                pass

        ts = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        [t.start() for t in ts], [t.join() for t in ts]
        assert len(won) == 1 and store.versions() == [1] and store.manifest()["shards"][0]["path"] == str(won[0])


def test_tiers_merge_and_no_shard_is_empty_or_small(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionAll(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    store, now = sharding.shard_documents(docs.repartition(5), f"file://{tmp_path}/t")
    history = [store.manifest(v)["shards"] for v in store.versions()]
    target = store.target
    assert all(s["rows"] > 0 for shards in history for s in shards) and sum(s["rows"] for s in now["shards"]) == docs.count()
    # of the final shards at most one is below half the target, and none is far above it
    sizes = sorted(s["bytes"] for s in now["shards"])
    assert len(sizes) > 2 and all(n >= target // 2 for n in sizes[1:]) and sizes[-1] < 2 * target
    assert now["version"] >= 8
    assert store.compact(final=True, schema=docs.schema)["version"] == now["version"]
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(store.read(docs.schema)) == same(docs)
    listed = {p.name for p in (tmp_path / "t").rglob("*.parquet")}
    assert {s["path"].split("/")[-1] for s in now["shards"]} <= listed and len(listed) <= 3 * len(sizes) + 20


def test_a_lost_race_is_tried_again(spark, docs_of, tmp_path):
    one, two = (sharding.Store(spark, f"file://{tmp_path}/race", target_bytes=10_000) for _ in range(2))
    shards = [[*s.write(docs_of([(k, "x")]).coalesce(1))] for k, s in enumerate((one, two))]
    gate, done = threading.Barrier(2), []

    def add(store, own):
        gate.wait()
        done.append(store.add(own)["version"])

    ts = [threading.Thread(target=add, args=x) for x in zip((one, two), shards)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert sorted(done) == [1, 2] and {r.doc_id for r in one.read(docs_of([]).schema).collect()} == {0, 1}
    # a merge whose shards another writer has merged meanwhile changes nothing
    for k in range(2, 6):
        one.append(docs_of([(k, "y" * k)]).coalesce(1))
    real, before = two.commit, two.manifest()

    def late(base, shards):
        two.commit = real
        one.compact(schema=docs_of([]).schema)
        return real(base, shards)

    two.commit = late
    assert two.compact(schema=docs_of([]).schema)["version"] == before["version"] + 1
    assert sorted(r.doc_id for r in two.read(docs_of([]).schema).collect()) == list(range(6))


def test_empty(docs_of):
    assert sharding.shard_digest(docs_of([])).count() == 0
