import re

import numpy as np

from lithoframe.llm import quality


def test_em_finds_accuracies_without_gold():
    r = np.random.default_rng(3)
    truth = r.random(20000) < 0.7
    accuracy = (0.95, 0.8, 0.9, 0.7)
    votes = np.stack([np.where(r.random(20000) < 0.2, quality.ABSTAIN, np.where((r.random(20000) < a) == truth, quality.GOOD, quality.BAD)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = quality.estimate(patterns, counts.astype(float))
    assert abs(got["good"] - 0.7) < 0.03
    assert all(abs(got["rates"][j, 1, 1] - a) < 0.04 and abs(got["rates"][j, 0, 0] - a) < 0.04 for j, a in enumerate(accuracy))


def test_accuracy_on_labels_it_never_saw(spark):
    d = "/root/testdata/sf0.01"
    got = quality.quality_digest(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    clean, junk = got[got.quality == 1], got[got.quality == 0]
    assert clean.keep.mean() > 0.98 and (~junk.keep).mean() > 0.9


def test_odd_rows_and_columns(docs_of):
    rows = [(i, "The cat sat on the mat and it was good. It is a fine day for all of us.") for i in range(30)] + [(50, None), (51, ""), (52, " \n"), (None, "A word."), (1, "The cat sat on the mat and it was good. It is a fine day for all of us."), (53, "x " * 200_000), (54, "!" * 100_000)]
    df = docs_of(rows)
    out = quality.classify(df)
    assert out.columns == [*df.columns, "__lf_quality"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r["__lf_quality"] for r in got}
    assert not any(by[i].keep or by[i].score for i in (50, 51, 52))
    assert quality.quality_digest(docs_of([])).count() == 0 and quality.good_documents(df).columns == df.columns


ODD, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain_hash(word):
    """The sum of (byte + 1) * ODD ** place, through splitmix64's finaliser, in whole numbers."""
    h = sum((b + 1) * pow(ODD, i, 1 << 64) for i, b in enumerate(word)) & ALL
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & ALL
    return h ^ (h >> 31)


def plain_document(text):
    """(words, votes, {feature: value}) of one text, word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, lower = len(words), [w.lower() for w in words]
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b >= 0x80
    letters, m = sum(map(letter, raw)), max(1, n)
    common = {w.encode() for w in quality.FUNCTION_WORDS}
    stats = [
        sum(b in b"*$%#&!|{}<>~^=\\@_[]+" for b in raw) / max(1, len(raw)), sum(65 <= b <= 90 for b in raw) / max(1, letters),
        sum(w in common for w in lower) / m, sum(len(w) == 1 and not letter(w[0]) for w in words) / m, len(set(lower)) / m,
        sum(w[-1:] in (b".", b"?", b"!") for w in words) / m, letters / m if n else 0.0, sum(a == b for a, b in zip(lower, lower[1:])) / m,
    ]
    symbols, capitals, function, separators, distinct, stops, length, again = stats
    rules = [
        (3, symbols > 0.03, symbols < 0.01), (3, capitals > 0.3, capitals < 0.15), (20, function < 0.08, function > 0.15), (10, separators > 0.1, separators < 0.03),
        (60, distinct < 0.25, distinct > 0.5), (40, stops < 0.01, 0.03 < stops < 0.3), (5, length < 2.5 or length > 14, 3 < length < 10), (8, again > 0.2, again < 0.05),
    ]
    votes = tuple(quality.ABSTAIN if n < least else quality.BAD if bad else quality.GOOD if good else quality.ABSTAIN for least, bad, good in rules)
    x = {}
    for w in words:
        kinds = [b"A" if 65 <= b <= 90 else b"a" if letter(b) else b"0" if 48 <= b <= 57 else bytes([b]) for b in w]
        shape = b"".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])
        for f in (plain_hash(shape) % quality.SHAPES, quality.SHAPES + plain_hash(w.lower()) % quality.WORDS):
            x[f] = x.get(f, 0.0) + 1 / (n + quality.SHORT)
    for j, s in enumerate(stats):
        x[quality.SHAPES + quality.WORDS + 32 * j + int(min(s / 20 if j == 6 else s, 0.999) * 20)] = 0.5
    return n, votes, x


def brute_scores(texts):
    """Scores of texts: expectation-maximisation document by document, then the scorer on a dense matrix."""
    docs = [plain_document(t) for t in texts]
    rate = [{quality.GOOD: {quality.BAD: 0.1, quality.GOOD: 0.9}, quality.BAD: {quality.BAD: 0.6, quality.GOOD: 0.4}} for _ in range(8)]
    good = 0.8
    for _ in range(100):
        post = []
        for _, votes, _ in docs:
            p, q = good, 1 - good
            for r, v in zip(rate, votes):
                if v != quality.ABSTAIN:
                    p, q = p * r[quality.GOOD][v], q * r[quality.BAD][v]
            post.append(p / (p + q))
        good = min(0.99, max(0.01, sum(post) / len(post)))
        for j, r in enumerate(rate):
            for truth in (quality.BAD, quality.GOOD):
                weight = {v: 1.0 + sum(p if truth == quality.GOOD else 1 - p for p, (_, votes, _) in zip(post, docs) if votes[j] == v) for v in (quality.BAD, quality.GOOD)}
                r[truth] = {v: w / sum(weight.values()) for v, w in weight.items()}
    x = np.zeros((len(docs), quality.SHAPES + quality.WORDS + quality.STATS))
    for i, (_, _, f) in enumerate(docs):
        for k, v in f.items():
            x[i, k] = v
    # gradient steps with Nesterov's momentum, at rate 2 and ridge 1e-4
    w = look = np.zeros(x.shape[1] + 1)
    x1 = np.c_[x, np.ones(len(x))]
    for t in range(120):
        g = (1 / (1 + np.exp(-x1 @ look)) - post) @ x1 / len(x)
        g[:-1] += 1e-4 * look[:-1]
        new = look - 2.0 * g
        look, w = new + t / (t + 3) * (new - w), new
    return [1 / (1 + np.exp(-float(x1[i] @ w))) if n else 0.0 for i, (n, _, _) in enumerate(docs)]


def test_scores_equal_brute_force(spark, docs_of):
    odd = docs_of([(10**6, None), (10**6 + 1, " \n"), (10**6 + 2, "ÄÖ ß! " * 70), (10**6 + 3, "1 2 3 4 $ %"), (3, "SAME id, Other text."), (None, "No id here, and so it is.")])
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    rows = documents.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute_scores([r.text for r in rows])))
    got = sorted((str(r.doc_id), r.score, r.keep) for r in quality.quality_digest(documents).collect())
    assert [i for i, _ in want] == [i for i, _, _ in got]
    assert max(abs(a - b) for (_, a), (_, b, _) in zip(want, got)) < 1e-4
    assert all(keep == (score >= quality.THRESHOLD) for _, score, keep in got)
