"""A training-data pipeline over documents: five stages, each written and read again before the next.

Every stage takes an empty table to an empty one, works on whole texts of any length, and passes extra columns through
whatever their names, but the last, which returns columns of its own. Rows of null or blank text go in the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import linededup, mixing, ngram_join, pieces, quality
from lithoframe.llm.common import Written, table

#: Near copies: shingles of this many words, and links from this percentage of common shingles.
WORDS, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-label classifier, fitted on these documents, keeps. Null and blank texts go; a score equal
    to the threshold stays; repeated rows are judged alike, and rows without doc_id like any other."""
    return quality.good_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat; the largest doc_id keeps a line. A null text stays null, and one
    that loses all lines is empty. Rows that repeat a doc_id count as one document; rows without one lose nothing."""
    return linededup.dedup_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near copies. Texts without words are no copies; rows that
    repeat a doc_id leave one; rows without doc_id all stay."""
    return ngram_join.one_of_each(docs, WORDS, PERCENT, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it, in the order of the curriculum. Null is a source of its own;
    texts without words have no size and go; repeated rows each count."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless of each row; null and empty texts have no ids. Repeated rows come out alike."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, the mix's hash order and the encoder are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = Written(docs, f"stage-{i}").df
    return docs
