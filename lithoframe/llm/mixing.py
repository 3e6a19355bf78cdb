"""Mixing sources to target weights along a time-varying curriculum, by integrals and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Written, small

#: Weights by the code-point rank of the source, repeating; no source gives more than MOST times its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: A source's rate goes linearly from (1 + slope) to (1 - slope) of its mean over training, by its weight.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of a source that one task orders at most, on average.
BUCKET_DOCS = 20_000
#: Words of the mix that one range of positions holds at most.
RANGE_WORDS = 20_000_000
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with w, slope and target, by filling to a common level.

    The level is the one at which min(most * source_size, level * w) adds up to all sizes: what capped sources can't
    give is reshared among the rest by weight. Null is a source, ranked last. One row for each source is ordered here."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (k + 1).cast("int"))
    ranked = sizes.withColumn("w", pick(weights)).withColumn("slope", pick(SLOPES)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    filled = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level_here", F.col("left") / F.col("w_left"))
    # the first source in this order that the level does not cap sets the level for itself and those after it
    open_here = F.col("cap") / F.col("w") >= F.col("level_here")
    level = F.min(F.when(open_here, F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level_here").alias("level")))).over(everything)["level"]
    return filled.withColumn("level", level).select(
        *sizes.columns, "w", "slope",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"),
    )


def when_reached(share: Column, slope: Column) -> Column:
    """The training time in [0, 1] at which a source has given `share` of its target: inverts
    (1 + slope) t - slope t^2, the integral of its rate."""
    inside = F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share))
    return F.when(slope == 0, share).otherwise((1 + slope - inside) / (2 * slope) + 0.0)


def all_given(sources: DataFrame) -> tuple[float, float]:
    """(a, b): by the time t, all sources together have given a t - b t^2 words, their schedules' integrals added up."""
    r = sources.agg(F.sum(F.col("target") * (1 + F.col("slope"))).alias("a"), F.sum(F.col("target") * F.col("slope")).alias("b")).first()
    return r["a"] or 0.0, r["b"] or 0.0


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, passes, positions, position, range-sorted by position.

    Each source is an endless reel of its documents in a seeded hash order; the mix plays target words of it, so every
    document is taken floor(target / source_size) times whole, and the last, partial pass stops at the target. Each pass starts
    at a time by the source's own schedule; positions has, for each pass, the words that all sources together have given by then,
    so equal steps are equal numbers of words; position is the first. Documents without words, and those that the partial pass
    doesn't reach, have taken 0, no positions and null position. A source's reel is cut into hash buckets whose totals are added up first, so the
    order within a hot source is never one task's. Null text has size 0; a null source is a source of its own; repeated
    rows each count, in an order among themselves that no result shows. Texts of any length are counted whole; rows of equal
    hash go by doc_id, and rows of equal position are sorted by doc_id; an empty table gives no rows. Other columns are
    ignored, whatever their names."""
    last = F.col("position").asc_nulls_last()
    return _placed(docs, weights, most, seed).drop("order").repartitionByRange(last, "doc_id").sortWithinPartitions(last, "doc_id")


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))


def _placed(docs: DataFrame, weights: tuple, most: int, seed: int) -> DataFrame:
    base = Written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("order")),
        "sizes",
    )
    sizes = base.df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = Written(source_targets(sizes, weights, most), "targets").df
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_DOCS))
    each = (
        base.df.join(small(sources), base.df["source"].eqNullSafe(sources["source"]))
        .select("doc_id", base.df["source"], "size", "order", "source_size", "target", "slope", F.floor((F.col("order") / 2.0**64 + 0.5) * buckets).cast("long").alias("bucket"))
    )
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = Written(each.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", before.alias("start")), "reels").df
    same = each["source"].eqNullSafe(starts["source"]) & (each["bucket"] == starts["bucket"])
    within = W.partitionBy(each["source"], each["bucket"]).orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = each.join(small(starts), same).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    words = F.round("target").cast("long")
    whole = F.coalesce(F.floor(F.try_divide(words, F.col("source_size"))), F.lit(0)).cast("long")
    rest = words - whole * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    taken = (whole * F.col("size") + partial).cast("long")
    passes = F.coalesce(F.ceil(F.try_divide(F.col("taken"), F.col("size"))), F.lit(0)).cast("long")
    a, b = all_given(sources)

    def given(p: Column) -> Column:
        t = when_reached(F.try_divide((F.col("at") + p * F.col("source_size")).cast("double"), F.col("target")), F.col("slope"))
        return F.lit(a) * t - F.lit(b) * t * t

    each_pass = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), given)).otherwise(F.array().cast("array<double>"))
    out = placed.withColumn("taken", taken).withColumn("passes", passes).withColumn("positions", each_pass)
    return out.select("doc_id", "size", "source_size", "target", "taken", "passes", "positions", F.get("positions", F.lit(0)).alias("position"), "order")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it, in the order of the curriculum: a row for each pass, sorted by the pass's
    position over all partitions.

    A row comes taken / size times, rounded, so the one document a source's last pass cuts stays whole or goes. Rows the mix
    doesn't reach go; columns stay as they are; rows that repeat take the places of one of their kind each; an empty table gives
    no rows. Positions count words, so equal ranges of them hold about equal amounts of text, and rows go to their range without
    a sample."""
    times = F.round(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    placed = _placed(docs, weights, most, SEED).select(F.col("order").alias("__lf_order"), F.slice("positions", 1, times).alias("__lf_at")).where(F.size("__lf_at") > 0)
    plan = Written(placed.groupBy("__lf_order").agg(F.sort_array(F.collect_list("__lf_at")).alias("__lf_at")), "mix").df
    joined = docs.withColumn("__lf_own", _order(SEED)).join(small(plan), F.col("__lf_own") == F.col("__lf_order"))
    # a row that repeats takes the places of one of its kind; all others have one entry
    nth = F.row_number().over(W.partitionBy("__lf_own").orderBy(F.lit(1)))
    one = joined.where(F.size("__lf_at") == 1).withColumn("__lf_n", F.lit(1))
    some = joined.where(F.size("__lf_at") > 1).withColumn("__lf_n", nth)
    each = one.unionAll(some).withColumn("__lf_position", F.explode(F.get("__lf_at", F.col("__lf_n") - 1)))
    last = plan.agg(F.max(F.array_max(F.flatten("__lf_at")))).first()[0] or 0.0
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(last // RANGE_WORDS))
    where = F.least(F.floor(F.col("__lf_position") / F.lit(last + 1.0) * ranges), F.lit(ranges - 1)).cast("int")
    return each.repartitionById(ranges, where).sortWithinPartitions("__lf_position", "__lf_own").select(*docs.columns)
