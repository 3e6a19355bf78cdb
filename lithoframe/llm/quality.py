"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of
their vote patterns, of all documents, estimates each labeller's accuracy without any gold label. The posteriors of a
bounded sample then train a linear scorer on hashed word shapes, words and document statistics, which scores every
document whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk

#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on are as with be by this from an at have not or which his her he she but they we you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "le la les de des et un une du en que est dans qui pour par sur pas plus au ce il elle se avec ne son sa "
    "el la los las de y en que un una por con no se del al es lo como más para su sus"
).split()
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "shouting", "function_words", "separators", "repetition", "sentences", "word_length", "stutter")
#: Documents in the training sample, by hash, on average; and sizes of the hashed features.
SAMPLE_ROWS, SHAPES, WORDS, STATS = 5_000, 4096, 8192, 256
#: A text of SHORT words has half the say of its words and shapes; the rest is its statistics' and the bias's.
SHORT = 20
THRESHOLD = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*$%#&!|{}<>~^=\\@_[]+"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LETTER] = ord("a")
_SHAPE[_UPPER] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def _function_hashes() -> np.ndarray:
    buf, starts, ends, _ = tk.word_spans([" ".join(FUNCTION_WORDS).encode()])
    return np.unique(tk.word_hashes(buf, starts, ends))


def measure(texts: Iterable[str | None]) -> Iterator[tuple]:
    """For runs of texts: (counts of words, statistics [rows, 8], word hashes, shape hashes); statistics are shares of
    symbols and of capitals, of function words, separators, distinct words, words that end a sentence,
    word length, and words that repeat the one before."""
    known = _function_hashes()
    for _, encoded in tk.chunks(texts):
        buf, starts, ends, counts = tk.word_spans(encoded)
        words = tk.word_hashes(buf, starts, ends)
        at = np.concatenate(([0], np.cumsum([len(b) + 1 for b in encoded])))[:-1]
        per_text = lambda mask: np.add.reduceat(mask.astype(np.int64), at)
        first = np.concatenate(([0], np.cumsum(counts)))

        def per_word(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[first[1:]] - total[first[:-1]]

        letters, size = per_text(_LETTER[buf]), np.diff(np.concatenate((at, [len(buf)]))) - 1
        n = np.maximum(counts, 1)
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
        last = buf[ends - 1]
        again = np.concatenate(([False], words[1:] == words[:-1]))[: len(words)]
        again[first[:-1][counts > 0]] = False
        stats = np.stack([
            per_text(_SYMBOL[buf]) / np.maximum(size, 1), per_text(_UPPER[buf]) / np.maximum(letters, 1),
            per_word(np.isin(words, known)) / n, per_word((ends - starts == 1) & ~_LETTER[last]) / n,
            distinct / n, per_word(_STOP[last]) / n, np.where(counts, letters / n, 0.0), per_word(again) / n,
        ], axis=1)
        # the shape of a word: its kinds of bytes, with runs taken together
        kinds = _SHAPE[buf]
        fresh = np.concatenate(([True], kinds[1:] != kinds[:-1]))
        fresh[starts] = True
        place = np.cumsum(fresh)
        short = kinds[fresh]
        shapes = tk.word_hashes(short, place[starts] - 1, place[ends - 1], lower=False)
        yield counts, stats, words, shapes


def votes(counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """[rows, labellers] of ABSTAIN, BAD or GOOD; texts too short for a labeller get no vote of it."""
    symbols, capitals, function, separators, distinct, stops, length, again = stats.T
    rule = lambda enough, bad, good: np.where(~enough, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))
    return np.stack([
        rule(counts >= 3, symbols > 0.03, symbols < 0.01), rule(counts >= 3, capitals > 0.3, capitals < 0.15),
        rule(counts >= 20, function < 0.08, function > 0.15), rule(counts >= 10, separators > 0.1, separators < 0.03),
        rule(counts >= 60, distinct < 0.25, distinct > 0.5), rule(counts >= 40, stops < 0.01, (stops > 0.03) & (stops < 0.3)),
        rule(counts >= 5, (length < 2.5) | (length > 14), (length > 3) & (length < 10)),
        rule(counts >= 8, again > 0.2, again < 0.05),
    ], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict:
    """EM on distinct vote patterns with their counts: good (the prior), rates [labeller, class, BAD or GOOD] of
    votes cast, posterior by pattern. To abstain says nothing."""
    m = patterns.shape[1]
    rates = np.tile(np.array([[0.6, 0.4], [0.1, 0.9]]), (m, 1, 1))  # where labellers start: better than chance
    good = 0.8
    for _ in range(rounds):
        logs = np.tile(np.log(np.array([1 - good, good])), (len(patterns), 1))
        for j in range(m):
            cast = patterns[:, j] != ABSTAIN
            logs[cast] += np.log(rates[j][:, patterns[cast, j] - 1]).T
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        good = float(np.clip(weight[:, 1].sum() / counts.sum(), 0.01, 0.99))
        for j in range(m):
            for v in (BAD, GOOD):
                rates[j, :, v - 1] = weight[patterns[:, j] == v].sum(axis=0) + 1.0
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
    return {"good": good, "rates": rates, "posterior": post[:, 1]}


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [votes(c, s) @ (3 ** np.arange(len(LABELLERS))) for c, s, _, _ in measure(tk.values(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out or [np.zeros(0, np.int64)]), pa.int64())], names=["doc_id", "pattern"])


def hashed(counts: np.ndarray, stats: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each occurrence: shapes and words by their share of the text, statistics by tenths."""
    row = np.repeat(np.arange(len(counts)), counts)
    share = 1.0 / (counts + SHORT)[row]
    tenths = (np.minimum(np.concatenate((stats[:, :6], stats[:, 6:7] / 20, stats[:, 7:]), axis=1), 0.999) * 20).astype(np.int64)
    slot = SHAPES + WORDS + np.arange(stats.shape[1]) * 32 + tenths
    feature = np.concatenate(((shapes % np.uint64(SHAPES)).astype(np.int64), SHAPES + (words % np.uint64(WORDS)).astype(np.int64), slot.ravel()))
    return np.concatenate((row, row, np.repeat(np.arange(len(counts)), stats.shape[1]))), feature, np.concatenate((share, share, np.full(slot.size, 0.5)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = SHAPES + WORDS + STATS
    for batch in batches:
        codes, at, features, values = [], [0], [], []
        for counts, stats, words, shapes in measure(tk.values(batch.column(0))):
            codes.append(votes(counts, stats) @ (3 ** np.arange(len(LABELLERS))))
            row, f, v = hashed(counts, stats, words, shapes)
            cell, where = np.unique(row * size + f, return_inverse=True)
            features.append(cell % size), values.append(np.bincount(where, v))
            at.extend((at[-1] + np.cumsum(np.bincount(cell // size, minlength=len(counts)))).tolist())
        cat = lambda x, t: np.concatenate(x or [np.zeros(0)]).astype(t)
        offsets = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(cat(codes, np.int64)), pa.ListArray.from_arrays(offsets, pa.array(cat(features, np.int32))), pa.ListArray.from_arrays(offsets, pa.array(cat(values, np.float32)))], names=["pattern", "f", "v"])


def train(codes: np.ndarray, features: list, values: list, posterior: dict[int, float], rounds: int = 120, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Nesterov's gradient steps: (weights, bias)."""
    y = np.array([posterior[int(c)] for c in codes])
    row, f, v = np.repeat(np.arange(len(features)), [len(x) for x in features]), np.concatenate(features), np.concatenate(values).astype(float)
    w = np.zeros(SHAPES + WORDS + STATS)
    b, look_w, look_b = 0.0, w.copy(), 0.0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, v * look_w[f], len(y)) + look_b)))
        g = (p - y) / len(y)
        new_w, new_b = look_w - rate * (np.bincount(f, v * g[row], len(w)) + ridge * look_w), look_b - rate * g.sum()
        look_w, look_b = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The weak-label model over all documents and the scorer trained on about sample_rows of them, chosen by a hash."""
    texts = docs.select("doc_id", "text")
    counted = texts.mapInArrow(_codes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern long").groupBy("pattern").count().collect()
    if not counted:
        return {"weights": np.zeros(SHAPES + WORDS + STATS), "bias": 0.0, "labellers": {}, "good": 0.5}
    codes, n = np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted], float)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    em = estimate(patterns, n)
    share = min(1.0, sample_rows / n.sum())
    chosen = texts.where(F.xxhash64(F.lit(31), "doc_id", F.xxhash64("text")) / 2.0**64 + 0.5 < share).select("text")
    rows = chosen.mapInArrow(_featured, "pattern long, f array<int>, v array<float>").toArrow()
    weights, bias = np.zeros(SHAPES + WORDS + STATS), float(np.log(em["good"] / (1 - em["good"])))
    if rows.num_rows:
        lists = lambda name: [x.values.to_numpy(zero_copy_only=False) for x in rows.column(name).combine_chunks()]
        weights, bias = train(rows.column("pattern").to_numpy(), lists("f"), lists("v"), dict(zip(codes.tolist(), em["posterior"].tolist(), strict=True)))
    right = em["good"] * em["rates"][:, 1, 1] + (1 - em["good"]) * em["rates"][:, 0, 0]
    accuracy = dict(zip(LABELLERS, right.tolist(), strict=True))
    return {"weights": weights, "bias": bias, "labellers": accuracy, "good": em["good"]}


def classify(docs: DataFrame, model: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with column `__lf_quality`, struct (score, keep): the scorer's probability that the text is good, and whether it
    reaches the threshold. Null and blank texts score 0 and are rejected; texts of any length are scored whole; a score equal
    to the threshold is kept. Every column passes through, whatever its name; repeated rows score alike; an empty table
    stays empty."""
    model = model or fit(docs)
    weights, bias = model["weights"].astype(np.float32), model["bias"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts, stats, words, shapes in measure(tk.values(batch.column(at))):
                n = len(counts)
                row = np.repeat(np.arange(n), counts)
                z = np.bincount(row, weights[(shapes % np.uint64(SHAPES)).astype(np.int64)] + weights[SHAPES + (words % np.uint64(WORDS)).astype(np.int64)], n) / (counts + SHORT)
                _, slot, value = hashed(np.zeros(n, np.int64), stats, words[:0], shapes[:0])
                z += (weights[slot] * value).reshape(n, -1).sum(axis=1)
                out.append(np.where(counts, 1 / (1 + np.exp(-(z + bias))), 0.0))
            score = np.concatenate(out or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold)], names=[*(f"c{i}" for i in range(batch.num_columns)), "score", "keep"])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    fields = [StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)]
    got = plain.mapInArrow(run, StructType([*fields, StructField("score", DoubleType()), StructField("keep", BooleanType())]))
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.struct("score", "keep").alias("__lf_quality"))


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, score, keep for every row, by `classify`; no row for an empty table."""
    return classify(docs.select("doc_id", "text")).select("doc_id", F.col("__lf_quality.score").alias("score"), F.col("__lf_quality.keep").alias("keep"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that `classify` keeps, with their columns; null and blank texts go, and an empty table stays empty."""
    return classify(docs).where("__lf_quality.keep").drop("__lf_quality")
