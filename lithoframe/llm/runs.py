"""Runs of words that repeat with a period: aligned blocks of 2, 4, 8 ... words are searched across their document, and blocks found
again at a distance that suits their size are extended both ways, word by word, to whole runs.

A run of period q and length at least max(shortest, 2q) holds at least need = max(shortest - q, q) words in a row that come again q
words later. If 2B - 1 <= need, an aligned block of B words lies within them. So the blocks of each size B answer for the
periods whose largest such power of two is B, between about 2B and 4B, and each has few places to look at."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least number of words of a run.
SHORTEST = 12
#: Rows are handed on once their texts hold this many bytes.
CHUNK_BYTES = 4_000_000


def block_of(q: np.ndarray, shortest: int) -> np.ndarray:
    """The size of the blocks that answer for each period."""
    need = np.maximum(shortest - q, q)
    return 1 << (np.frexp((need + 1) / 2)[1] - 1)


def occurrences(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, names of the blocks there) of every occurrence, aligned or not, of the aligned blocks of size words.

    names has, for each place, one plus the name of the half block that starts there, 0 where that is of no use. A block is the
    two names of its halves; the text to search is, for each remainder of places by the halves' size, the names at those places."""
    half, n = size // 2, len(names)
    starts = np.arange(0, n - size + 1, size)
    left, right = names[starts], names[starts + half]
    keep = (left > 0) & (right > 0)
    blocks = np.unique(left[keep] * (int(names.max()) + 1) + right[keep])
    if not len(blocks):
        return blocks, blocks
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, (a, b) in enumerate(zip(*(x.tolist() for x in np.divmod(blocks, int(names.max()) + 1)))):
        search.add_word((a, b), k)
    search.make_automaton()
    rows = -(-n // half) + 1
    held = np.zeros(rows * half, np.int64)
    held[:n] = names
    text = held.reshape(rows, half).T.ravel()
    shown = np.flatnonzero((text > 0) | (np.concatenate(([0], text[:-1])) > 0))
    found = np.fromiter(chain.from_iterable(search.iter(tuple(text[shown].tolist()))), np.int64).reshape(-1, 2)
    remainder, row = np.divmod(shown[found[:, 0] - 1], rows)
    return row * half + remainder, found[:, 1]


def meetings(starts: np.ndarray, names: np.ndarray, at: np.ndarray, which: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of blocks and the occurrences of the same block low to high words after them."""
    wide = int(at.max()) + high + 2
    key = which * wide + at
    key.sort()
    first = np.searchsorted(key, names * wide + starts + low)
    many = np.searchsorted(key, names * wide + starts + high, "right") - first
    b = np.repeat(starts, many)
    place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(b))
    return b, key[place] - np.repeat(names, many) * wide - b


def known(b: np.ndarray, q: np.ndarray, size: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Which meetings lie in a run found before, of a period that divides theirs: they would give that run again."""
    out = np.zeros(len(b), bool)
    least = int(q.min()) + size
    order = np.argsort(b, kind="stable")
    b, q = b[order], q[order]
    for (s, e), p in runs.items():
        if e - s >= least:
            i, j = np.searchsorted(b, (s, e))
            out[i:j] |= (b[i:j] + q[i:j] + size <= e) & (q[i:j] % p == 0)
    back = np.empty_like(out)
    back[order] = out
    return back


def extended(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on, forwards or backwards, are the same."""
    n, width, total = len(w), 8, 0
    while True:
        room = min(width, n - j) if step > 0 else min(width, i + 1)
        if room <= 0:
            return total
        same = w[i : i + room] == w[j : j + room] if step > 0 else (w[i + 1 - room : i + 1] == w[j + 1 - room : j + 1])[::-1]
        if not same.all():
            return total + int(np.argmin(same))
        total += room
        i, j, width = i + step * room, j + step * room, width * 2


def runs_of(numbers: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of small numbers, by start, then period."""
    n = len(numbers)
    if n < max(shortest, 2):
        return []
    w = np.array(numbers, np.int64)
    periods = np.arange(1, n // 2 + 1)
    blocks = block_of(periods, shortest)
    runs: dict[tuple[int, int], int] = {}
    size, least, most = 1, int(blocks.min()), int(blocks.max())
    at, which = np.arange(n), w
    while True:
        stay = np.bincount(which)[which] > 1
        at, which = at[stay], which[stay]
        if not len(at):
            break
        own = periods[blocks == size]
        if size >= least and len(own):
            aligned = at % size == 0
            b, q = meetings(at[aligned], which[aligned], at, which, int(own[0]), int(own[-1]))
            fit = blocks[np.minimum(q, n // 2) - 1] == size
            b, q = b[fit], q[fit]
            order = np.lexsort((b, q))
            b, q = b[order], q[order]
            fresh = np.ones(len(b), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (b[1:] - b[:-1] != size)
            b, q = b[fresh], q[fresh]
            if runs and len(b):
                fresh = ~known(b, q, size, runs)
                b, q = b[fresh], q[fresh]
            for i, d in zip(b.tolist(), q.tolist()):
                s = i - extended(w, i - 1, i + d - 1, -1)
                e = i + size + d + extended(w, i + size, i + size + d, 1)
                if e - s >= max(shortest, 2 * d):
                    runs[s, e] = min(d, runs.get((s, e), d))
        size *= 2
        if size > most:
            break
        names = np.zeros(n, np.int64)
        names[at] = which + 1
        at, which = occurrences(names, size)
    return sorted((s, e - s, p) for (s, e), p in runs.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, one blank apart."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text's words without those a run
    repeats, one blank apart) of each row of docs.

    Words are what ASCII blanks part. Null, empty and blank texts have no words, no runs and an empty collapsed text; of stretches
    with several periods the smallest counts, and runs that overlap are all given. Rows that repeat a doc_id, and rows without
    one, each come out; an empty table gives no rows, and other columns are ignored, whatever their names. A text is worked on
    whole in its own task, in memory of its own length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            first, counts, found, left, size = 0, [], [], [], 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                seen: dict[bytes, int] = {}
                runs = runs_of([seen.setdefault(x, len(seen)) for x in words], shortest)
                counts.append(len(words))
                found.append(runs)
                left.append(collapsed(words, runs).decode())
                size += len(left[-1]) + 24 * len(runs)
                if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, found)])
                    flat = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
                    structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(first, len(counts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(left, pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    first, counts, found, left, size = i + 1, [], [], [], 0

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words bigint, runs array<{run}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the contract: for every tenth hash of doc_id, the words from a place on repeat with a period. Other texts, and
    those of rows without doc_id, stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - F.lit(1).cast("bigint")), lambda i: words[F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")]), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """The runs of the documents with planted repeats: number, the longest, and digests of all and of the collapsed text. Rows as
    in periodic_runs()."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
