"""Readers: delimited points, GeoJSON, layers; names, kinds, schemas, checks of what was read."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions import wkb
from ..layers import in_frame

#: Names of the axes of geographic, projected and vertical systems (as ISO 19111 writes them), the symbol of each axis, and
#: words that headers of measured values use.
AXIS_NAMES = {"x": ("longitude", "easting"), "y": ("latitude", "northing"), "z": ("elevation", "height", "depth", "value")}
#: Limits of an archive, longest name, and names that file systems keep for devices.
ENTRIES_MAX, BYTES_MAX, RATIO_MAX, NAME_MAX = 10_000, 2 << 30, 100, 120
DEVICES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def _likeness(header: str, axis: str) -> float:
    """How much a header looks like an axis: its symbol alone is best, then a whole name, then the beginning of one, of three
    letters or more; further words in the header count against it."""
    words = re.findall(r"[a-z]+", header.lower())
    best = 0.0
    for w in words:
        if w == axis:
            best = max(best, 4.0)
        for name in AXIS_NAMES[axis]:
            if w == name:
                best = max(best, 3.0)
            elif len(w) >= 3 and name.startswith(w):
                best = max(best, 2.0)
    return best - 0.1 * (len(words) - 1) if best else 0.0


def propose_mapping(columns: list[str]) -> dict[str, str | None]:
    """The column that looks most like x, y and z each, the first of equals; a suggestion that nothing applies by itself."""
    out = {}
    for axis in AXIS_NAMES:
        scores = [_likeness(c, axis) for c in columns]
        out[axis] = columns[scores.index(max(scores))] if scores and max(scores) > 0 else None
    return out


def resolve_srid(override: int | None, declared: int | None, sidecar: str | None = None) -> int:
    """An override, else what the file declares, else its .prj; there is no guess."""
    if override or declared:
        return override or declared
    m = re.search(r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', sidecar or "")
    require(m is not None, "the file declares no coordinate system; give its EPSG code")
    return int(m[1])


def read_xyz(spark: SparkSession, path: str, *, x: str, y: str, z: str | None = None, srid: int, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(x, y, z, props) of a delimited file with a header: every column is read as text, so no scan guesses types. Rows whose x
    or y is no number go (see skipped); a bad z is null; the other columns become JSON."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).csv(path)
    for c in filter(None, (x, y, z)):
        require(c in raw.columns, f"column {c!r} is not in the file; it has {', '.join(raw.columns)}")
    rest = [c for c in raw.columns if c not in (x, y, z)]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")
    out = raw.select(number(x).alias("x"), number(y).alias("y"), (number(z) if z else F.lit(None).cast("double")).alias("z"), props.alias("props"))
    return in_frame(out.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"), srid)


def skipped(raw: DataFrame, x: str, y: str) -> DataFrame:
    """One row: how many rows read_xyz leaves out."""
    return raw.agg(F.count_if(F.col(x).try_cast("double").isNull() | F.col(y).try_cast("double").isNull()).alias("skipped"))


def read_geojson(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """(id, geometry, props) of FeatureCollections, one file each; features without geometry go."""
    text = spark.read.option("wholetext", True).text(path)
    features = text.select(F.explode(F.from_json("value", "features array<struct<id:string,geometry:string,properties:string>>")["features"]).alias("f")).select("f.*")

    def run(batches):
        for b in batches:
            b["geometry"] = [wkb.from_geojson(json.loads(g)) for g in b["geometry"]]
            yield b

    kept = features.where("geometry IS NOT NULL").select("id", "geometry", F.coalesce("properties", F.lit("{}")).alias("props"))
    return in_frame(kept.mapInPandas(run, "id string, geometry binary, props string"), srid)


def normalise(layer: DataFrame) -> DataFrame:
    """Without null geometries, outer rings counter-clockwise and holes clockwise, Z dropped."""
    import numpy as np

    from ..operators.polygons import area, each

    def turn(kind, c):
        if kind == "Polygon":
            return kind, [np.asarray(r) if (area(np.asarray(r)) > 0) == (i == 0) else np.asarray(r)[::-1] for i, r in enumerate(c)]
        return (kind, [turn("Polygon", p)[1] for p in c]) if kind == "MultiPolygon" else (kind, c)

    return each(layer.where("geometry IS NOT NULL"), turn)


def suspect_axis_order(points: DataFrame, srid: int) -> DataFrame:
    """One row (swapped): whether longitudes and latitudes look exchanged."""
    a = points.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y"))
    return a.select(F.coalesce(F.lit(srid == 4326) & (F.col("x") <= 90) & (F.col("y") > 90), F.lit(False)).alias("swapped"))


def geometry_kind(layer: DataFrame) -> DataFrame:
    """One row: point, linestring, polygon, or mixed."""
    kinds = layer.agg(F.collect_set(wkb.kind_column(F.col("geometry"))).alias("k"))
    return kinds.select(F.when(F.size("k") == 1, F.col("k")[0]).otherwise("mixed").alias("kind"))


def attribute_schema(layer: DataFrame) -> DataFrame:
    """(name, type, nullable) of every attribute, over all rows; numbers of both sorts are number, mixtures string."""
    n = layer.agg(F.count("*").alias("rows"))
    each = layer.select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "v"), "props")
    kind = F.when(F.col("v").isNull(), None).when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").rlike(r"^-?[0-9]+$"), "integer").when(F.col("v").try_cast("double").isNotNull(), "number").otherwise("string")
    seen = each.select("name", kind.alias("k")).groupBy("name").agg(F.collect_set("k").alias("ks"), F.count("k").alias("present"))
    one = F.when(F.size("ks") == 1, F.col("ks")[0]).when(F.array_except("ks", F.array(F.lit("integer"), F.lit("number"))) == F.array().cast("array<string>"), "number").otherwise("string")
    return seen.join(F.broadcast(n)).select("name", one.alias("type"), (F.col("present") < F.col("rows")).alias("nullable"))


def sanitize_name(name: str, fallback: str = "layer") -> str:
    """Compatibility-composed, letters, digits, space, dot, dash and underscore only, no device names, at most NAME_MAX long."""
    out = re.sub(r"[^\w .\-]", "_", unicodedata.normalize("NFKC", name).replace("\\", "/").rsplit("/", 1)[-1]).strip(" .")[:NAME_MAX]
    return fallback if not out or out.split(".")[0].lower() in DEVICES else out


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, checksum) of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"))


def parse_uri(uri: str, scheme: str) -> tuple[str, str]:
    m = re.fullmatch(rf"{scheme}://([^/]+)/(.+)", uri)
    require(m is not None, f"{uri!r} is not of the form {scheme}://name/path")
    return m[1], m[2]


def safe_extract(archive: str, destination: str) -> list[str]:
    """Files of a zip without links, paths that lead out, or more than the limits."""
    with zipfile.ZipFile(archive) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        require(len(infos) <= ENTRIES_MAX, f"the archive has {len(infos)} entries, and {ENTRIES_MAX} is the most")
        require(sum(i.file_size for i in infos) <= BYTES_MAX, f"the archive unpacks to more than {BYTES_MAX} bytes")
        root, out = os.path.realpath(destination), []
        for i in infos:
            require((i.external_attr >> 16) & 0o170000 != 0o120000, f"{i.filename!r} is a link")
            require(i.file_size <= RATIO_MAX * max(1, i.compress_size), f"{i.filename!r} unpacks to more than {RATIO_MAX} times its size")
            to = os.path.realpath(os.path.join(root, i.filename))
            require(to.startswith(root + os.sep), f"{i.filename!r} leads out of the archive")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with z.open(i) as src, open(to, "wb") as dst:
                while chunk := src.read(1 << 20):
                    dst.write(chunk)
            out.append(to)
        return out


def preview(df: DataFrame, rows: int = 20) -> dict:
    return {"columns": df.dtypes, "mapping": propose_mapping(df.columns), "rows": [r.asDict() for r in df.limit(rows).collect()]}


def read_layer(spark: SparkSession, path: str, *, where: Column | None = None, limit: int | None = None, srid: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    df = df.limit(limit) if limit is not None else df
    return in_frame(df, srid) if srid else df


def read_control(layer: DataFrame, attribute: str) -> DataFrame:
    """(id, x, y, value) of point features whose attribute is a number."""
    from ..operators.attributes import attribute as text

    p = layer.where(wkb.kind_column(F.col("geometry")) == "point").select("id", wkb.xy(F.col("geometry")).alias("p"), text(attribute).try_cast("double").alias("value"))
    return p.where("value IS NOT NULL AND NOT isnan(value)").select("id", "p.x", "p.y", "value")


def as_pandas(df: DataFrame, rows: int) -> pd.DataFrame:
    return df.limit(rows).toPandas()
