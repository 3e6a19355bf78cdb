"""Layers at rest: Hilbert-clustered Parquet in versions behind a manifest, exports, and their checks."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.geometry import hilbert_index
from ..operators.registry import apply_edits
from ..scratch import create_once

#: Bytes of a row group, and the length of shapefile names.
GROUP_BYTES, SHAPE_NAME = 128 << 20, 10


class VersionConflict(RuntimeError):
    """Somebody else wrote this version first."""


class LayerStore:
    """<root>/<folder>/*.parquet and <root>/manifest-<N>.json, which names its folder; the highest manifest is the layer. A
    writer that dies leaves only a folder that no manifest names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(root))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def write(self, layer: DataFrame, base_version: int | None = None, note: dict | None = None) -> int:
        """Writes the layer, which has a bbox struct, as the next version: rows in Hilbert order of their box's centre, so that
        each file and row group covers little ground and readers skip the rest by its statistics."""
        now = self.version()
        if base_version is not None and base_version != now:
            raise VersionConflict(f"the layer is at version {now}, not {base_version}; reload it and edit again")
        b = layer.agg(F.count("*").alias("n"), *[f(f"bbox.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))]).first()
        require(b["n"] > 0, "the layer is empty; there is nothing to write")
        box = tuple(float(b[c]) for c in ("xmin", "ymin", "xmax", "ymax"))
        folder = f"v{now + 1}-{uuid.uuid4().hex}"
        key = hilbert_index((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2, box)
        sorted_ = layer.withColumn("__h", key).repartitionByRange("__h", "id").sortWithinPartitions("__h", "id").drop("__h")
        sorted_.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/{folder}")
        body = json.dumps({"version": now + 1, "folder": folder, "rows": b["n"], "bbox": box, **(note or {})}).encode()
        if not create_once(self.spark, f"{self.root}/manifest-{now + 1}.json", body):
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise VersionConflict(f"version {now + 1} was written by somebody else; reload the layer and edit again")
        return now + 1

    def manifest(self, version: int | None = None) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{version or self.version()}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, version: int | None = None) -> str:
        return f"{self.root}/{self.manifest(version)['folder']}"

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def save_edits(self, edits: DataFrame, base_version: int) -> int:
        return self.write(apply_edits(self.read(base_version), edits), base_version, {"operation": "edit", "input": base_version})


def with_bbox(points: DataFrame, grow: float = 0.0) -> DataFrame:
    box = F.struct((F.col("x") - grow).alias("xmin"), (F.col("y") - grow).alias("ymin"), (F.col("x") + grow).alias("xmax"), (F.col("y") + grow).alias("ymax"))
    return points.withColumn("bbox", box)


def row_group_bounds(path: str) -> list[dict]:
    """The box of every row group of a local Parquet folder, from its footers."""
    import glob

    import pyarrow.parquet as pq

    out = []
    for f in sorted(glob.glob(f"{path.removeprefix('file://')}/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            out.append({"file": f, "group": g, "xmin": stats["bbox.xmin"].min, "ymin": stats["bbox.ymin"].min, "xmax": stats["bbox.xmax"].max, "ymax": stats["bbox.ymax"].max})
    return out


def shapefile_field_names(names: list[str]) -> dict[str, str]:
    """Names of at most ten characters; where they would clash, a number takes the end."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for n in names:
        short, i = n[:SHAPE_NAME], 1
        while short.lower() in taken:
            short = f"{n[: SHAPE_NAME - len(str(i)) - 1]}_{i}"
            i += 1
        taken.add(short.lower())
        out[n] = short
    return out


def plan_export(schema: list[tuple[str, str, bool]], kind: str, fmt: str, rows: int) -> list[dict]:
    """What an export would lose: (code, blocking, detail) before anything is written."""
    found = []
    if fmt == "shapefile":
        renamed = {a: b for a, b in shapefile_field_names([n for n, _, _ in schema]).items() if a != b}
        if renamed:
            found.append({"code": "names_shortened", "blocking": False, "detail": renamed})
        if kind == "mixed":
            found.append({"code": "mixed_geometry", "blocking": True, "detail": "a shapefile holds one kind; split the layer"})
        if any(nullable and t in ("integer", "number", "boolean") for _, t, nullable in schema):
            found.append({"code": "nulls_lost", "blocking": False, "detail": [n for n, t, k in schema if k and t != "string"]})
        if rows * 200 > 2 << 30:
            found.append({"code": "too_large", "blocking": True, "detail": "a shapefile ends at 2 GB; choose GeoParquet"})
    if fmt == "csv" and kind != "point":
        found.append({"code": "geometry_as_text", "blocking": False, "detail": "geometries become well-known text"})
    return found


def blocking(warnings: list[dict]) -> list[dict]:
    return [w for w in warnings if w["blocking"]]


def write_csv(points: DataFrame, path: str, columns: list[str]) -> None:
    points.select("x", "y", *columns).write.option("header", True).csv(path)


def geojson_lines(points: DataFrame, properties: list[str]) -> DataFrame:
    """(value): a GeoJSON feature on each line, built by Column functions."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson(points: DataFrame, path: str, properties: list[str]) -> None:
    geojson_lines(points, properties).write.text(path)
