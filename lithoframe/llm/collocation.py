"""Phrases whose words keep together, from depth-limited count tries of each shard that are merged by ranges of their prefixes.

A phrase found a hundred times has no part that is rarer. So words are counted first, then by hashes the windows of two words and
more whose parts may be frequent, and a shard's trie holds just the nodes that may be frequent. What may be is sent as a bitmap of a
fixed size: a rare window that shares a bit with a frequent one costs a node, which the exact counts then drop."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written
from .textkernels import mix

#: Phrases have 2 to DEPTH words, are found at least LEAST times, and the first TOP of each language are reported.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Bits of a bitmap, as a power of two (16 MB); bits of one of its rows.
FILTER_BITS, ROW_BITS = 27, 1 << 15
#: Words that are taken together (bytes of text), words or phrases that a shard holds, and windows that it holds, before it is serialised.
PART_BYTES, HELD, HELD_WINDOWS = 2_000_000, 400_000, 4_000_000
#: Words of the input for each range of window hashes, and ranges there are at least.
RANGE_WINDOWS, RANGES = 1 << 21, 128
#: Parts of a language that are ranked by themselves before their first rows meet.
RANK_PARTS = 16

STOP = 0xFF  #: No byte of UTF-8; stands for what parts pieces.
_TABLE = bytearray(range(256))
for _b in range(0x41, 0x5B):
    _TABLE[_b] = _b + 0x20
for _b in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_b] = STOP
_TABLE[0x09] = 0x20
TABLE, END, SPACED = bytes(_TABLE), bytes([STOP]), b" " + bytes([STOP]) + b" "
ODD = np.uint64(0x9E3779B97F4A7C15)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A translated text in parts of about PART_BYTES that end where a piece ends; a longer piece stays whole."""
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= PART_BYTES else text.rfind(END, start, start + PART_BYTES)
        if end < 0:
            end = text.find(END, start + PART_BYTES)
            end = len(text) if end < 0 else end
        yield text[start:end]
        start = end + 1


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, words and STOPs) of rows (lang, text), texts of a language together."""
    for batch in batches:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for i, lang in enumerate(batch.column(0).to_pylist()):
            one = (batch.column(1)[i].as_py() or "").encode().translate(TABLE)
            held[lang].append(one)
            size += len(one)
            if size >= PART_BYTES or i + 1 == batch.num_rows:
                for k, texts in held.items():
                    for part in parts_of(END.join(texts)):
                        yield k, part
                held.clear()
                size = 0


class Words:
    """Counts of words; at the empty word, of all words of the language."""

    schema = "lang string, word string, n bigint"

    def __init__(self):
        self.counts: dict[str, Counter] = defaultdict(Counter)

    def add(self, lang: str, part: bytes) -> None:
        words = part.replace(END, b" ").split()
        own = self.counts[lang]
        own.update(words)
        own[b""] += len(words)

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) >= HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([w.decode() for w in own]), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
        self.counts.clear()


class Vocabulary:
    """Numbers, hashes and possible frequency of a language's words; number 0 is the STOP, which is never frequent."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]
        self.frequent, self.seed = frequent, xxhash.xxh64_intdigest(lang.encode(), 42)
        self.words, self.hashes, self.maybe = [END], np.zeros(1, np.uint64), np.zeros(1, bool)

    def read(self, part: bytes) -> np.ndarray:
        words = part.replace(END, SPACED).split()
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > len(self.words):
            new = list(islice(self.numbers, len(self.words), None))
            h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64)
            self.words += new
            self.hashes = np.concatenate((self.hashes, mix(h)))
            self.maybe = np.concatenate((self.maybe, has(self.frequent, h)))
        return out

    def windows(self, ids: np.ndarray, levels: int, known: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2 to levels words: hashes of the windows that start at each place, and whether the window stands in one piece
        and its parts may be frequent; below the level known, whether it may be itself, too."""
        own = self.hashes[ids]
        h, alive = own, self.maybe[ids]
        for k in range(2, levels + 1):
            h, alive = mix(h[:-1] * ODD + own[k - 1 :]), alive[:-1] & alive[1:]
            if k < known:
                alive[alive] = has(self.frequent, h[alive])
            yield h, alive


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes, their first FILTER_BITS, are set."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Windows:
    """Counts of the hashes of windows of level words, serialised sorted, one row for each range of hashes: the 32 bits after the
    range's, and counts."""

    schema = "range int, hashes binary, counts binary"

    def __init__(self, frequent: np.ndarray, level: int, range_bits: int):
        self.frequent, self.level, self.bits = frequent, level, range_bits
        self.known: dict[str, Vocabulary] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = Vocabulary(lang, self.frequent)
        words = self.known[lang]
        *_, (h, alive) = words.windows(words.read(part), self.level, self.level)
        self.held.append(np.unique(h[alive] >> np.uint64(32 - self.bits), return_counts=True))
        self.size += len(self.held[-1][0])
        if sum(len(v.words) for v in self.known.values()) >= HELD:
            self.known.clear()
        if self.size >= HELD_WINDOWS:
            self.held = [summed(self.held)]
            self.size = len(self.held[0][0])

    def full(self) -> bool:
        return self.size >= HELD_WINDOWS // 2 and len(self.held) == 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            h, c = summed(self.held)
            where = h >> np.uint64(32)
            cut = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(h)])) if len(h) else np.zeros(1, int)
            h, c = h.astype("<u4"), c.astype("<u4")
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(where[cut[:-1]].astype(np.int32)), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([c[a:b].tobytes() for a, b in spans], pa.binary())], names=["range", "hashes", "counts"])
        self.held, self.size = [], 0


def summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (hash, count) as one, with a row for each hash."""
    h, c = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    if not len(h):
        return h, c
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(c, first)


class Tries:
    """Count tries of each language's windows that may be frequent, built level by level and serialised sorted: a row for each
    range of prefixes, by the hash of a node's first two words, with the nodes as lines and their counts."""

    schema = "range int, lang string, nodes binary, counts binary"

    def __init__(self, frequent: np.ndarray, depth: int, range_bits: int):
        self.frequent, self.depth, self.bits = frequent, depth, range_bits
        self.known: dict[str, Vocabulary] = {}
        self.counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

    def add(self, lang: str, part: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = Vocabulary(lang, self.frequent)
        words, own = self.known[lang], self.counts[lang]
        ids = words.read(part)
        at = np.flatnonzero(words.maybe[ids])
        names, node, n = np.unique(ids[at], return_inverse=True, return_counts=True)
        spelled = [words.words[i] for i in names.tolist()]
        count(own, spelled, n)
        for level, (_, alive) in enumerate(words.windows(ids, self.depth, self.depth), 1):
            go = np.append(alive, np.zeros(level, bool))[at]
            at, node = at[go], node[go]
            names, node, n = np.unique(node * len(words.words) + ids[at + level], return_inverse=True, return_counts=True)
            parent, last = np.divmod(names, len(words.words))
            spelled = [spelled[p] + b" " + words.words[i] for p, i in zip(parent.tolist(), last.tolist())]
            count(own, spelled, n)
        if sum(len(v.words) for v in self.known.values()) >= HELD:
            self.known.clear()

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) >= HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.counts.items():
            dealt: dict[int, list[bytes]] = defaultdict(list)
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            for phrase in sorted(own):
                dealt[xxhash.xxh64_intdigest(b" ".join(phrase.split(b" ", 2)[:2]), seed) >> (64 - self.bits)].append(phrase)
            held = list(dealt.values())
            columns = [pa.array(list(dealt), pa.int32()), pa.array([lang] * len(held), pa.string()), pa.array([b"\n".join(x) for x in held], pa.binary()), pa.array([np.array([own[p] for p in x], "<i8").tobytes() for x in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "lang", "nodes", "counts"])
        self.counts.clear()


def count(counts: dict[bytes, int], phrases: list[bytes], n: np.ndarray) -> None:
    for phrase, k in zip(phrases, n.tolist()):
        counts[phrase] += k


def over_shards(docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """What the shards of each task serialise: a shard ends with the task or when it is full."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = make()
        for lang, part in by_language(batches):
            shard.add(lang, part)
            if shard.full():
                yield from shard.rows()
        yield from shard.rows()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(work, schema)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of 64-bit hashes (column h), gathered in rows of ROW_BITS: 16 MB at most, whatever the input."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = hashes.groupBy(F.floor(bit / ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(ROW_BITS))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[row.row * ROW_BITS // 8 :][: ROW_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def frequent_windows(windows: DataFrame, least: int, range_bits: int) -> DataFrame:
    """h, a hash with the first bits of each window that may be frequent: the shards' sorted runs meet by range."""

    def merge(table: pa.Table) -> pa.Table:
        runs = [(np.frombuffer(h.as_py(), "<u4"), np.frombuffer(c.as_py(), "<u4").astype(np.int64)) for h, c in zip(table["hashes"], table["counts"])]
        h, c = summed(runs)
        h = h[c >= least].astype(np.uint64) | np.uint64(table["range"][0].as_py() << 32)
        return pa.table({"h": (h << np.uint64(32 - range_bits)).view(np.int64)})

    return windows.groupBy("range").applyInArrow(merge, "h bigint")


def merged(shards: DataFrame, least: int) -> DataFrame:
    """lang, phrase and f of the nodes of all shards: in each range the shards' sorted runs are merged, equal nodes added up."""

    def merge(table: pa.Table) -> pa.Table:
        runs = defaultdict(list)
        for lang, nodes, counts in zip(table["lang"].to_pylist(), table["nodes"], table["counts"]):
            runs[lang].append(zip(nodes.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<i8").tolist()))
        out: tuple[list, list, list] = ([], [], [])
        for lang, own in runs.items():
            for phrase, same in groupby(heapq.merge(*own), itemgetter(0)):
                f = sum(n for _, n in same)
                if f >= least:
                    for column, value in zip(out, (lang, phrase.decode(), f)):
                        column.append(value)
        return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()), "f": pa.array(out[2], pa.int64())})

    return shards.groupBy("range").applyInArrow(merge, "lang string, phrase string, f bigint")


def merged_trie(docs: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[Written, Written]:
    """(trie, totals): lang, phrase and f of every phrase of 1 to depth words found at least least times, and lang and n, the
    number of all words."""
    spark = docs.sparkSession
    words = over_shards(docs, Words, Words.schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == ""))
    words = Written(words, "words")
    totals = Written(words.df.where("word = ''").select("lang", "n"), "totals")
    bits = bitmap(words.df.where("word <> ''").select(F.xxhash64("lang", "word").alias("h")))
    whole = totals.df.agg(F.sum("n")).first()[0] or 0
    words.drop()

    range_bits = max(RANGES, whole // RANGE_WINDOWS).bit_length()
    sent = spark.sparkContext.broadcast(bits)
    for level in range(2, depth):
        windows = over_shards(docs, lambda level=level, sent=sent: Windows(sent.value, level, range_bits), Windows.schema)
        bits = bits | bitmap(frequent_windows(windows, least, range_bits))
        sent = spark.sparkContext.broadcast(bits)

    trie = Written(merged(over_shards(docs, lambda: Tries(sent.value, depth, range_bits), Tries.schema), least), "trie")
    return trie, totals


def phrase_of(words: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """The first top phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Words are what blanks and tabs part, A-Z lower-cased, in pieces between the marks .,;:!? and line ends. Null texts have no words, a null
    lang is und. Ties go to the more frequent phrase, then to the first by its bytes. Repeated rows and rows without doc_id each
    count; an empty table gives no rows, and other columns are ignored, whatever their names. Texts are read whole, in parts
    that end with a piece."""
    trie, totals = merged_trie(docs, least, depth)
    node = trie.df.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    links = F.array(phrase_of(F.col("w"), 1, F.col("m") - 1), phrase_of(F.col("w"), 2, F.col("m") - 1))  # parent and suffix link
    longer = node.where("m > 2").select("lang", F.explode(links).alias("phrase"), F.lit(None).cast("bigint").alias("a"), F.col("f").alias("longer"))
    whole = node.where("m > 1").select("lang", "phrase", F.col("f").alias("a"), F.lit(0).cast("bigint").alias("longer"))
    best = whole.unionAll(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).where("longer < a").drop("longer")

    w = F.split("phrase", " ")
    part = lambda k, left, c: F.struct(k.alias("k"), F.lit(left).alias("is_left"), c.alias("part"))
    cuts = F.sequence(F.lit(1), F.size(w) - 1)
    sides = F.concat(F.transform(cuts, lambda k: part(k, True, phrase_of(w, 1, k))), F.transform(cuts, lambda k: part(k, False, phrase_of(w, k + 1, F.size(w) - k))))
    asked = best.select("lang", "phrase", "a", F.inline(sides))
    found = asked.join(trie.df.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("is_left") == left), F.col("f")))
    cut = found.groupBy("lang", "phrase", "a").agg(*[side(k, s).alias(f"{'l' if s else 'r'}{k}") for k in range(1, depth) for s in (True, False)]).join(totals.df, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.call_function("div", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), big(f"l{k}") * big(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, depth)]
    scored = cut.select("lang", "phrase", "a", "n", F.array_min(F.array(*scores)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order))).where(F.col("at") <= top).drop("at")
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w))::bigint as n from words group by lang
), grams as (
  select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest([1, 2, 3, 4, 5]) as m from words) where len(w) >= m
), trie as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, m, count(*) as f from grams group by all having count(*) >= 100
), candidates as (
  select lang, phrase, string_split(phrase, ' ') as w, m, f as a from trie where m > 1
), longer as (
  select lang, phrase, max(a) as a from (
    select lang, array_to_string(w[1 : m - 1], ' ') as phrase, a from candidates union all select lang, array_to_string(w[2 : m], ' '), a from candidates
  ) group by all
), best as (
  select * from candidates c where not exists (select 1 from longer x where x.lang = c.lang and x.phrase = c.phrase and x.a >= c.a)
), cuts as (
  select *, array_to_string(w[1 : k], ' ') as lp, array_to_string(w[k + 1 : m], ' ') as rp from (select *, unnest(range(1, m)) as k from best)
), scored as (
  select c.lang, c.phrase, c.a, x.f as l, y.f as r, n, c.k, (1000::hugeint * c.a * n // (x.f::hugeint * y.f))::bigint as score
  from cuts c join trie x on x.lang = c.lang and x.phrase = c.lp join trie y on y.lang = c.lang and y.phrase = c.rp join totals t on t.lang = c.lang
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) where rank <= 2000
"""
