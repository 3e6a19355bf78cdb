"""Corpus-wide line deduplication: the search moves hashes and positions alone and gives each document a compressed keep
bitmap; each text then meets its own bitmap once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, Written, ascii_lower

MIN_CHARS, MIN_DOCS = 20, 3
#: Parts that a line's documents are dealt into where the repeated lines are too many for a broadcast.
SALTS = 32


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, keep_runs) for every document that loses lines.

    keep_runs is the keep bitmap as its runs of kept lines, [start, stop) of 0-based positions; stop is null in the last one,
    which goes to the end of the text.

    A key is a line stripped of ASCII blanks with A-Z lower-cased. Only keys of min_chars code points or more count, as a
    128-bit hash. Hashes are range-partitioned and sorted by hash, document and position; the first occurrence of a key in a
    document is taken as the sorted rows stream by, and the largest document and the number of documents of a key from these
    first occurrences, summed in each partition before one row for each key and partition meets the others. A line that a
    third of all documents hold is so never one task's group. Rows that repeat a doc_id count as one document; rows without
    doc_id or text lose nothing and count nothing."""
    line = F.col("x.line")
    lines = (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(ascii_lower(F.col("text")), "\n", -1).alias("lines"))
        .select("doc_id", "text_hash", F.transform("lines", lambda s, i: F.struct(F.btrim(s, F.lit(BLANKS)).alias("line"), i.alias("pos"))).alias("lines"))
        .select("doc_id", "text_hash", F.explode(F.filter("lines", lambda x: F.char_length(x["line"]) >= min_chars)).alias("x"))
        .select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), "doc_id", "text_hash", F.col("x.pos").alias("pos"))
    )
    written = Written(lines, "lines")
    ordered = written.df.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    # the range order serves this window as it is: nothing is shuffled or sorted again
    first = F.row_number().over(W.partitionBy("h1", "h2", "doc_id").orderBy("text_hash", "pos")) == 1
    held = Written(ordered.withColumn("first", first), "line-keys")
    written.drop()
    found = Written(
        held.df.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last"),
        "repeated-lines",
    )
    if found.df.count() <= broadcast_rows:
        known = held.df.join(F.broadcast(found.df), ["h1", "h2"])
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        known = held.df.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(found.df.withColumn("part", parts), ["h1", "h2", "part"])
    lost = known.where("doc_id <> last").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    # a kept run begins with the text or behind a lost line whose successor stays, and ends before a lost line whose predecessor stays
    after = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    before = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    starts = F.concat(F.array(F.lit(0)), F.transform(after, lambda p: p + 1))
    runs = lost.select("doc_id", "text_hash", starts.alias("starts"), before.alias("stops"))
    return runs.select("doc_id", "text_hash", F.transform("starts", lambda a, i: F.struct(a.alias("start"), F.get("stops", i).alias("stop"))).alias("keep_runs"))


def with_kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with struct column `__lf_lines` (n_lines, n_dropped, kept); a null or empty text is one empty line.

    Lines that stay are cut out by the runs of the keep bitmap and joined by newlines unchanged. Extra columns pass through,
    whatever their names."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("__lf_id"), F.col("text_hash").alias("__lf_hash"), F.col("keep_runs").alias("__lf_runs"))
    source = docs.withColumn("__lf_own", F.xxhash64("text"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    joined = source.join(bitmaps, (source["doc_id"] == bitmaps["__lf_id"]) & (source["__lf_own"] == bitmaps["__lf_hash"]), "left")
    length = lambda r: F.coalesce(r["stop"], F.size(lines)) - r["start"]
    stay = F.coalesce(F.aggregate("__lf_runs", F.lit(0), lambda n, r: n + length(r)), F.size(lines))
    kept = F.when(F.col("__lf_runs").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.flatten(F.transform("__lf_runs", lambda r: F.slice(lines, r["start"] + 1, length(r)))), "\n")
    )
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - stay).cast("long").alias("n_dropped"), kept.alias("kept")).alias("__lf_lines"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs; none for an empty table.

    Null and empty texts are one empty line, which stays; a text whose lines all go has the hash of the empty text. Of equal
    lines in one document all stay or go together; of the documents that hold a line, the one of largest doc_id keeps it.
    Rows that repeat a doc_id are one document; rows without one lose nothing. Texts of any length are split whole; other
    columns are ignored, whatever their names."""
    out = with_kept_lines(docs)
    return out.select("doc_id", F.col("__lf_lines.n_lines").alias("n_lines"), F.col("__lf_lines.n_dropped").alias("n_dropped"), F.sha2(F.col("__lf_lines.kept"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that lost taken out of text; the other columns and the row order of columns stay."""
    return with_kept_lines(docs).select(*[F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("__lf_lines.kept")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, (f.key IS NOT NULL AND k.doc_id <> f.last) AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
