import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lithoframe.llm import catalog, collocation


def plainly(rows, least, depth, top):
    """rows of (lang, text) by counting every phrase in a dictionary."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + m]) for m in range(1, depth + 1) for i in range(len(words) - m + 1))
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + m] for q, a in kept.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= 100 * kept[q[i : i + m]]}
        scored = []
        for p, a in kept.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, rows):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "x1", "�", "\x01", "　", "a" * 300] + [f"w{i}" for i in range(30)]
    fixed = ["New York city of the x1", "the of the of the", "é é é é é é é", "x1 a\tb"]
    pick = lambda: r.choice(fixed) if r.random() < 0.3 else words[min(r.randrange(40), r.randrange(40))]
    return [(r.choice(["en", "en", None, "und", "de"]), "".join(pick() + r.choice([" ", " ", "  ", ", ", ".\n", "\t"]) for _ in range(r.randint(0, 60)))) for _ in range(rows)]


def got(spark, rows, **how):
    data = [(i, t, k, "clash", 7) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, phrase string, n long").repartition(3)
    return sorted(tuple(x) for x in collocation.collocations(df, **how).collect())


@pytest.mark.parametrize("least,depth,top", [(5, 5, 2000), (3, 3, 10), (40, 5, 2000), (1, 2, 5)])
def test_equals_counting_every_phrase(spark, least, depth, top):
    rows = texts(least, 150) + [(None, None), ("fr", ""), ("fr", " . ,"), ("fr", None)]
    want = plainly(rows, least, depth, top)
    assert got(spark, rows, least=least, depth=depth, top=top) == want and want


def tally(counts, batch):
    for r in batch.to_pylist():
        for h, n in zip(np.frombuffer(r["hashes"], "<u4").tolist(), np.frombuffer(r["counts"], "<u4").tolist()):
            counts[r["range"], h] += n


def test_small_shards_and_crowded_bitmaps_change_nothing(spark, monkeypatch):
    rows = texts(9, 150)
    want = plainly(rows, 6, 5, 50)
    for name, value in (("PART_BYTES", 64), ("HELD", 20), ("HELD_WINDOWS", 16), ("RANGE_WINDOWS", 50), ("RANGES", 4), ("RANK_PARTS", 2)):
        monkeypatch.setattr(collocation, name, value)
    all_bits = np.full((1 << collocation.FILTER_BITS) // 8, 255, np.uint8)
    data = pa.RecordBatch.from_pydict({"lang": ["en" if k is None else k for k, _ in rows], "text": [t for _, t in rows]})
    words_of = lambda b: [((r["lang"], r["word"]), r["n"]) for r in b.to_pylist()]
    nodes_of = lambda b: [((r["lang"], x), n) for r in b.to_pylist() for x, n in zip(r["nodes"].split(b"\n"), np.frombuffer(r["counts"], "<i8").tolist())]
    for make, read in ((collocation.Words, words_of), (lambda: collocation.Tries(all_bits, 5, 4), nodes_of)):
        counts, rows_out = [], 0
        for split in (True, False):  # shards that end after each part, and one for all
            shard, c = make(), Counter()
            for lang, part in collocation.by_language(iter([data])):
                shard.add(lang, part)
                for b in shard.rows() if split else ():
                    for k, n in read(b):
                        c[k] += n
                        rows_out += 1
            for b in shard.rows():
                for k, n in read(b):
                    c[k] += n
            counts.append(c)
        assert counts[0] == counts[1] and rows_out > len(counts[0])
    windows = [collocation.Windows(all_bits, 3, 4) for _ in range(2)]
    seen = [Counter(), Counter()]
    for w, c, split in zip(windows, seen, (True, False)):
        for lang, part in collocation.by_language(iter([data])):
            w.add(lang, part)
            for b in w.rows() if split else ():
                tally(c, b)
        for b in w.rows():
            tally(c, b)
    assert seen[0] == seen[1] and seen[0]
    assert got(spark, rows, least=6, depth=5, top=50) == want


def test_parts_end_with_pieces(monkeypatch):
    monkeypatch.setattr(collocation, "PART_BYTES", 10)
    r = random.Random(2)
    for _ in range(200):
        text = bytes(r.choice(b"ab \xff") for _ in range(r.randint(0, 60)))
        parts = list(collocation.parts_of(text))
        assert [p for x in parts for p in x.split(b"\xff") if p] == [p for p in text.split(b"\xff") if p]
    assert list(collocation.parts_of(b"a" * 50)) == [b"a" * 50]


def test_hashes_and_bitmaps_agree(spark):
    words = ["a", "é", "x" * 100, ""]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, word string").select(F.xxhash64("lang", "word").alias("h"))
    own = [xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest(b"en", 42)) for w in words]
    assert [r.h % 2**64 for r in df.collect()] == own
    r = np.random.default_rng(1)
    h = np.concatenate((np.array(own, np.uint64), r.integers(0, 2**64, 1000, np.uint64)))
    held = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    bits = collocation.bitmap(held)
    assert collocation.has(bits, h).all() and collocation.has(bits, r.integers(0, 2**64, 1000, np.uint64)).sum() < 4
    assert np.unpackbits(bits).sum() <= len(h)


def test_no_rows(spark):
    assert got(spark, []) == [] == got(spark, [(None, None), ("en", "few words")])


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b " * 30)]
    trie = plainly(rows, 20, 2, 9)
    assert trie == got(spark, rows, least=20, depth=2, top=9)
    big = spark.sql("select 4000000000000L a, 90000000000000L n, 5000000000000L l, 7000000000000L r").select(
        F.call_function("div", F.lit(1000).cast("decimal(38,0)") * F.col("a").cast("decimal(38,0)") * F.col("n").cast("decimal(38,0)"), F.col("l").cast("decimal(38,0)") * F.col("r").cast("decimal(38,0)")).alias("s")
    )
    assert big.first().s == 1000 * 4000000000000 * 90000000000000 // (5000000000000 * 7000000000000)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.sql(collocation.SQL).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["op12_phrase_collocations"](spark, sf_dir).collect()) == want and want
