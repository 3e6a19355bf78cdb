"""Shared helpers: tables, shared scratch space, guarded broadcasts, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder

#: What the contracts call white space, and the letters they lower-case.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join may be broadcast up to this many rows of a few fixed-width columns (about 50 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a local master without one, as in tests."""
    return folder(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Written:
    """A table written once to the shared folder, so that no later step recomputes it and lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the table, and lets Spark delete the shuffle files of the steps that are done."""
        remove_path(self.spark, self.path)
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a written table of fixed-width rows when its counted size is within the bound; beyond it, the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps; every step sends each edge by its key with the minimum aggregated
    before the shuffle, and a written table cuts the lineage after each round."""
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now = Written(e, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = mark(now.df)
    while seen[0]:
        both = now.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.df.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        star = joined.select("hi", F.col("m").alias("lo")).unionAll(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        nxt = Written(star.distinct(), "edges")
        now.drop()
        now, before, seen = nxt, seen, mark(nxt.df)
        if seen == before:
            break
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        now.df.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    ).distinct()
