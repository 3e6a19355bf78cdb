"""Deterministic spatial layers on the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, v, nk, seg: a point for each customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.pmod(F.col("c_custkey") * 7919, F.lit(10007)).cast("double") * 10.0).alias("x"),
        (F.pmod(F.col("c_custkey") * 104729, F.lit(10009)).cast("double") * 10.0).alias("y"),
        F.col("c_acctbal").alias("v"),
        F.col("c_nationkey").alias("nk"),
        F.col("c_mktsegment").alias("seg"),
    )


def zones(spark: SparkSession, sf_dir: str, side: float = 20018.0) -> DataFrame:
    """zid, rk, xmin, ymin, xmax, ymax: 5 x 5 boxes, one for each nation."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("zid"), F.col("n_regionkey").alias("rk"),
        (F.pmod(n, F.lit(5)) * side).alias("xmin"), (F.floor(n / 5.0) * side).alias("ymin"),
        (F.pmod(n, F.lit(5)) * side + side).alias("xmax"), (F.floor(n / 5.0) * side + side).alias("ymax"),
    )


def in_frame(df: DataFrame, srid: int) -> DataFrame:
    """df with its spatial reference noted; nothing is reprojected."""
    return df.withMetadata(df.columns[0], {"srid": srid})


def frame_of(df: DataFrame) -> int | None:
    return next((f.metadata["srid"] for f in df.schema if "srid" in f.metadata), None)


def same_frame(a: DataFrame, b: DataFrame) -> None:
    """Refuses two layers in different frames."""
    fa, fb = frame_of(a), frame_of(b)
    if fa is not None and fb is not None and fa != fb:
        raise ValueError(f"the layers are in frames {fa} and {fb}; reproject one of them first")
