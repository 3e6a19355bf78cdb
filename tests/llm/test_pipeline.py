"""The pipeline's stages against plain Python on what their predecessors kept."""

import hashlib

import corpus_pipeline
from lithoframe.llm import mixing, pieces, quality

from .test_linededup import brute as line_brute
from .test_ngram_join import brute as jaccard_brute

D = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns or i == 4
        kept.append(docs)
    start = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    good = {r.doc_id: r.text for r in kept[0].collect()}
    want = {r.doc_id for r in quality.quality_digest(spark.read.parquet(f"{D}/documents.parquet")).collect() if r.keep}
    assert set(good) == want and all(start[i].text == t for i, t in good.items())
    lines = {r.doc_id: r.text for r in kept[1].collect()}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in lines.items()} == {i: h for i, _, _, h in line_brute(list(good.items()))}
    single = {r.doc_id: r.text for r in kept[2].collect()}
    groups = jaccard_brute(list(lines.items()), 5, 80, 100)
    assert single == {i: lines[i] for i, c in groups.items() if i == c}
    mixed = [(r.doc_id, r.text) for r in kept[3].collect()]
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(kept[2]).collect() if r.taken}
    assert sorted(mixed) == sorted((i, single[i]) for i, n in times.items() for _ in range(n))
    coder = pieces.Coder(pieces.read_model())
    out = kept[4].collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in mixed)
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in out)
    assert all(coder.decode(__import__("numpy").array(r.ids, "int32")) == single[r.doc_id] for r in out)
    whole = corpus_pipeline.run(spark, D).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole) == sorted((r.doc_id, tuple(r.ids)) for r in out)


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    prose = "The cat sat on the mat, and it was good. {} is a fine day for all of us, and so the sun was out at {}."
    rows = [(i, prose.format(i, 7 * i) + f" Then she saw that there were {i} of them.", f"s{i % 3}") for i in range(60)]
    rows += [(70, rows[5][1], "s1"), (5, rows[5][1], "s2"), (71, None, "s0"), (72, "", None), (73, " \n\t", "s0"), (None, rows[9][1] + " No id.", None)]
    rows += [(74, " ".join(prose.format(k, k) for k in range(20_000)), "s0")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, taken long, component long, ids string"
    for name, data in (("odd", rows), ("none", [])):
        made = spark.createDataFrame([(i, t, None, s, None, "x", 1, 2, None) for i, t, s in data], schema)
        made.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs, kept = made, []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{i}")
            assert i == 4 or docs.columns == made.columns
            kept.append(docs.collect())
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((str(r.doc_id), list(r.ids)) for r in out) == sorted((str(r.doc_id), list(r.ids)) for r in kept[4]) and all(r.lossless for r in out)
        if not data:
            assert not out and not any(kept)
            continue
        assert all((r.text or "").strip() for r in kept[0]) and {r.doc_id for r in kept[0]} == {i for i, t, _ in rows if (t or "").strip()}
        texts = {r.doc_id: r.text for r in kept[1]}
        single = [r.doc_id for r in kept[2]]
        assert single.count(5) == 1 and 70 not in single and None in single and 74 in single
        assert all(r.text == texts[r.doc_id] and (r.size, r.taken, r.component) == ("x", 1, 2) for r in kept[2])
