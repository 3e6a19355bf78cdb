"""Attribute-table queries over a layer's JSON properties: paging, names, kinds, profiles and name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require

#: Limits of the attribute table and of profiles.
PAGE_MAX, CATEGORIES_MAX, CATEGORIES_SHOWN, BINS, NUMERIC_SHARE = 5000, 5000, 200, 40, 0.98


def attribute(key: str, props: str = "props") -> Column:
    """The text of one attribute; JSON null and absence are null."""
    return F.get_json_object(props, "$['" + key.replace("'", "\\'") + "']")


def number(c: Column) -> Column:
    return c.try_cast("double")


def page(layer: DataFrame, key: str | None = None, *, offset: int = 0, limit: int = 200, descending: bool = False, id_column: str = "id") -> DataFrame:
    """Rows in a total order: by number, then text, nulls last in both directions, then id upwards; without a key, by id.

    limit is held to 1..PAGE_MAX; a negative offset is refused. Only a page leaves the sort."""
    require(offset >= 0, f"offset must be 0 or more, not {offset}; start at 0")
    limit = min(max(limit, 1), PAGE_MAX)
    if key is None:
        order = [F.col(id_column).desc() if descending else F.col(id_column).asc()]
    else:
        way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
        order = [way(number(attribute(key))), way(attribute(key)), F.col(id_column).asc()]
    return layer.orderBy(*order).offset(offset).limit(limit)


def names(layer: DataFrame) -> DataFrame:
    """(name) of every attribute that any row has; all rows are read."""
    return layer.select(F.explode(F.json_object_keys("props")).alias("name")).distinct()


def kind(layer: DataFrame, key: str) -> DataFrame:
    """One row: n (non-null values), n_numeric and kind, numeric where NUMERIC_SHARE of the values cast."""
    v = attribute(key)
    out = layer.agg(F.count(v).alias("n"), F.count(number(v)).alias("n_numeric"))
    return out.withColumn("kind", F.when((F.col("n") > 0) & (F.col("n_numeric") >= NUMERIC_SHARE * F.col("n")), "numeric").otherwise("category"))


def categories(layer: DataFrame, key: str, shown: int = CATEGORIES_SHOWN, most: int = CATEGORIES_MAX) -> DataFrame:
    """(value, n, n_distinct, remaining): the most frequent values, ties by value. Above `most` distinct values the profile is
    refused: one row without a value, remaining = n_distinct."""
    counts = layer.select(attribute(key).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("n_distinct"))
    refused = total.where(F.col("n_distinct") > most).select(F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), "n_distinct", F.col("n_distinct").alias("remaining"))
    top = counts.orderBy(F.desc("n"), "value").limit(shown)
    kept = top.join(F.broadcast(total.where(F.col("n_distinct") <= most)), how="inner")
    return kept.select("value", "n", "n_distinct", F.greatest(F.lit(0).cast("long"), F.col("n_distinct") - shown).alias("remaining")).unionAll(refused)


def histogram(layer: DataFrame, value: Column, bins: int = BINS) -> DataFrame:
    """(bin, lo, hi, n, missing), empty bins too; the last bin is closed; a constant column has one bin; null and what
    doesn't cast are missing."""
    v = number(value)
    stats = layer.agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), (F.count("*") - F.count(v)).alias("missing"))
    stats = stats.withColumn("bins", F.when(F.col("vmin") == F.col("vmax"), 1).otherwise(bins))
    one = F.broadcast(stats.where("vmin IS NOT NULL"))  # one row
    width = (F.col("vmax") - F.col("vmin")) / F.col("bins")
    spot = F.when(F.col("vmin") == F.col("vmax"), 0).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("vmin")) / F.nullif(width, F.lit(0.0))).cast("int")))
    counted = layer.select(v.alias("v")).where("v IS NOT NULL").join(one).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    frame = one.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "vmin", "missing", width.alias("width"))
    return frame.join(counted, "bin", "left").select(
        F.col("bin"), (F.col("vmin") + F.col("bin") * F.col("width")).alias("lo"), (F.col("vmin") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), "missing",
    )


def summary(layer: DataFrame, key: str, kind_of: str | None = None) -> DataFrame:
    """The profile of a column by its kind; one pass finds the kind where it isn't given."""
    kind_of = kind_of or kind(layer, key).first()["kind"]
    if kind_of == "numeric":
        out = histogram(layer, attribute(key))
        require(not out.isEmpty(), f"column {key!r} holds no number; ask for its categories instead")
        return out
    return categories(layer, key)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of lower-cased text, padded by two spaces before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets."""
    return F.size(F.array_intersect(trigrams(a), trigrams(b))) / F.size(F.array_union(trigrams(a), trigrams(b)))


def search(registry: DataFrame, name: str, query: str, *, at_least: float = 0.3, limit: int = 20, id_column: str = "id", where: Column | None = None) -> DataFrame:
    """The registry rows whose name is similar to the query or contains it, best first, with column score."""
    score = F.round(similarity(F.col(name), F.lit(query)), 6)
    found = registry.where(where) if where is not None else registry
    found = found.withColumn("score", score).where((F.col("score") >= at_least) | F.col(name).ilike("%" + query.replace("%", r"\%").replace("_", r"\_") + "%"))
    return found.orderBy(F.desc("score"), id_column).limit(limit)


def overlaps_box(bbox: str, box: tuple[float, float, float, float]) -> Column:
    """Inclusive overlap of a bbox struct with (xmin, ymin, xmax, ymax); false for null boxes; pushed down to Parquet."""
    b = F.col(bbox)
    return b.isNotNull() & (b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1])


def dataset_page(registry: DataFrame, *, kind_of: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live registry rows, newest first, then by name, with the total count beside."""
    live = registry.where("deleted_at IS NULL")
    live = live.where(F.col("kind") == kind_of) if kind_of else live
    total = live.agg(F.count("*").alias("total"))
    return live.orderBy(F.desc("updated_at"), "name", "id").offset(offset).limit(limit).join(F.broadcast(total))
