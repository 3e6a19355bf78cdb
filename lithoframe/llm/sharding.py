"""Size-tiered compaction of a document store: small immutable shards in, target-sized shards and a versioned manifest out.

A store is a folder of Parquet shards and of manifests manifest-<version>.json. A manifest lists the shards that make up
the store (path, rows, bytes, tier); the highest version is the store. A version is committed by creating its file whole,
which fails where another writer has created it first; nothing that a manifest names is ever changed, and a job that dies
before its commit leaves only files that no manifest names. Shards are deleted by vacuum alone, which leaves those of the
versions that readers may still use."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import create_once
from .common import scratch_path

#: Bytes that a shard should have, shards of a tier that are merged at a time at least, and the ratio of tiers' sizes.
TARGET_BYTES, FAN_IN, RATIO = 64 << 20, 4, 4
#: Merges that run side by side, arrivals that a load is dealt into, and versions that stay readable while it runs.
MERGES_AT_A_TIME, ARRIVALS, READABLE = 16, 4, 2
#: A load's small shards are SMALL times smaller than the target, and its target at least PARTS times smaller than the load, down to
#: LEAST_BYTES; commits that lose a race are tried TRIES times.
SMALL, PARTS, LEAST_BYTES, TRIES = 16, 8, 1 << 16, 8


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        if fan_in < 2 or target_bytes < 1:
            raise ValueError(f"fan_in must be 2 or more and target_bytes 1 or more, not {fan_in} and {target_bytes}")
        self.spark, self.path, self.target, self.fan_in = spark, path, target_bytes, fan_in
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(sc._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the newest; version 0 is the empty store."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if not version:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version:08d}.json"))
        try:
            reader = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return json.loads(reader.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict]) -> dict:
        """Makes version base + 1 of these shards; raises Conflict where it exists already."""
        made = {"version": base + 1, "shards": sorted(shards, key=lambda s: s["path"])}
        if not create_once(self.spark, f"{self.path}/manifest-{base + 1:08d}.json", json.dumps(made).encode()):
            raise Conflict(f"version {base + 1} of {self.path} was committed by another writer; read it and try again")
        return made

    def _written(self, folders: list[str]) -> list[dict]:
        """The shards in folders that hold rows: paths and bytes from the file system, rows by one count over their footers.
        Files without rows, as empty tasks leave them, are deleted."""
        found = [(folder, s) for folder in folders for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        if not found:
            return []
        name = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0)
        counted = self.spark.read.schema("__lf_none int").parquet(*[f"{folder}/{s.getPath().getName()}" for folder, s in found]).groupBy(name.alias("name")).count()
        rows = {r["name"]: r["count"] for r in counted.collect()}
        out = []
        for folder, s in found:
            path = f"{folder}/{s.getPath().getName()}"
            if not rows.get("/".join(path.split("/")[-2:])):
                self._fs.delete(s.getPath(), False)
                continue
            out.append({"path": path, "rows": rows["/".join(path.split("/")[-2:])], "bytes": s.getLen(), "tier": self.tier(s.getLen())})
        return out

    def tier(self, size: int) -> int:
        """0 for the target and above; each tier below is RATIO times smaller."""
        return 0 if size >= self.target * 3 // 4 else math.floor(math.log(self.target / max(1, size), RATIO)) + 1

    def write(self, arrivals: DataFrame, rows: int = 0) -> list[dict]:
        """The rows as small immutable shards of at most `rows` rows (0: one for each task), which no version names yet: nothing is
        shuffled or sorted."""
        folder = f"{self.path}/{fresh('arrival')}"
        arrivals.write.option("maxRecordsPerFile", rows).parquet(folder)
        return self._written([folder])

    def append(self, arrivals: DataFrame) -> dict:
        """Commits the rows as small shards."""
        return self.add(self.write(arrivals))

    def _tried(self, change) -> dict:
        """Commits what change makes of the newest manifest's shards, again on the next version where another writer was first."""
        for k in range(TRIES):
            base = self.manifest()
            shards = change(base["shards"])
            if shards is None:
                return base
            try:
                return self.commit(base["version"], shards)
            except Conflict:
                if k + 1 == TRIES:
                    raise

    def add(self, shards: list[dict]) -> dict:
        """Commits written shards after those of the newest version."""
        return self._tried(lambda have: have + shards) if shards else self.manifest()

    def plan(self, shards: Iterable[dict], final: bool = False) -> list[list[dict]]:
        """Groups of shards to merge: from the smallest tier on, fan_in or more of a tier, packed up to the target. With
        final, whatever is below the target is packed, across tiers."""
        below = sorted((s for s in shards if s["tier"] > 0), key=lambda s: (-s["tier"], s["bytes"], s["path"]))
        pools: list[list[dict]] = [below] if final else [[s for s in below if s["tier"] == t] for t in sorted({s["tier"] for s in below}, reverse=True)]
        groups = []
        for pool in pools:
            run: list[dict] = []
            size = 0
            for s in pool:
                if run and size + s["bytes"] > self.target * 5 // 4:
                    groups.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            groups.append(run)
        return [g for g in groups if len(g) >= (2 if final else self.fan_in) or (len(g) > 1 and sum(s["bytes"] for s in g) >= self.target * 3 // 4)]

    def compact(self, final: bool = False, schema=None) -> dict:
        """Merges similar-sized shards once and commits; a store that needs no merge stays at its version. One task reads
        the shards of a group and writes their merger, so rows move once and no shuffle holds them."""
        base = self.manifest()
        groups = self.plan(base["shards"], final)
        if not groups:
            return base
        schema = schema or self.schema(base)

        def merge(group: list[dict]) -> str:
            # a job of its own for each merge: a union of single-partition reads may come out as one partition
            folder = f"{self.path}/{fresh('merged')}"
            self.spark.read.schema(schema).parquet(*[s["path"] for s in group]).coalesce(1).write.parquet(folder)
            return folder

        with ThreadPoolExecutor(MERGES_AT_A_TIME) as pool:
            new = self._written(list(pool.map(merge, groups)))
        gone = {s["path"] for g in groups for s in g}

        def swapped(have: list[dict]) -> list[dict] | None:
            """The newest shards with the mergers in place of what they hold; none where another writer has merged some of it."""
            return [s for s in have if s["path"] not in gone] + new if gone <= {s["path"] for s in have} else None

        return self._tried(swapped)

    def schema(self, manifest: dict):
        return self.spark.read.parquet(manifest["shards"][0]["path"]).schema

    def vacuum(self, keep_from: int) -> int:
        """Deletes the shards that only versions below keep_from name; the number deleted."""
        keep = {s["path"] for v in self.versions() if v >= keep_from for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in self.versions() if v < keep_from for s in self.manifest(v)["shards"]} - keep
        for p in gone:
            self._fs.delete(self._path(p), False)
        for v in self.versions():
            if v < keep_from:
                self._fs.delete(self._path(f"{self.path}/manifest-{v:08d}.json"), False)
        return len(gone)

    def read(self, schema, version: int | None = None) -> DataFrame:
        shards = self.manifest(version)["shards"]
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])


def fresh(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


def load_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) of docs."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return r["n"], r["b"] or 0


def shard_documents(docs: DataFrame, path: str | None = None, target_bytes: int | None = None, arrivals: int = ARRIVALS) -> tuple[Store, dict]:
    """A store of all rows of docs, and its manifest.

    One pass writes docs as shards SMALL times smaller than the target. They arrive in `arrivals` commits, one after another; after
    each, tiers that hold enough shards are merged until none does, and at the end what is left below the target is packed. Shards
    that only versions before the last READABLE ones name are deleted. The target is TARGET_BYTES, or for a load of less than PARTS
    such shards that part of its text.

    Rows keep every column, nulls, empty texts, repeats and texts of any length. Shards of equal size merge in the order of
    their paths. An empty table gives a store without rows."""
    rows, size = load_size(docs)
    target = target_bytes or max(LEAST_BYTES, min(TARGET_BYTES, size // PARTS))
    store = Store(docs.sparkSession, path or scratch_path(docs.sparkSession, "store"), target)
    # half a byte of Parquet for a byte of text, as compression has it; a shard that comes out larger or smaller has its own tier
    written = store.write(docs, max(1, rows * target // SMALL // max(1, size // 2)))
    step = max(1, -(-len(written) // arrivals))
    now = store.manifest()

    def packed(final: bool) -> dict:
        made = store.manifest()
        while (nxt := store.compact(final, schema=docs.schema))["version"] != made["version"]:
            made = nxt
            store.vacuum(made["version"] + 1 - READABLE)
        return made

    for first in range(0, len(written), step):
        store.add(written[first : first + step])
        now = packed(False)
    return store, packed(True) if written else now


def shard_digest(docs: DataFrame, target_bytes: int | None = None) -> DataFrame:
    """doc_id, shard, shard_rows, shard_bytes, version, text_sha256 of every row of the compacted store, read back from its
    shards; no row for an empty table. Columns other than doc_id and text are kept in the shards, whatever their names, and not
    read back."""
    store, now = shard_documents(docs, target_bytes=target_bytes)
    spark, schema = docs.sparkSession, docs.select("doc_id", "text").schema
    rows = store.read(schema)
    if not now["shards"]:
        none = rows.select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("shard_bytes"))
        return none.select("*", F.lit(now["version"]).cast("long").alias("version"), F.lit("").alias("text_sha256"))
    # a row for each shard of the store: the manifest, which the driver holds anyway
    listed = spark.createDataFrame([(s["path"].split("/")[-1], s["rows"]) for s in now["shards"]], "shard string, shard_rows long")
    return rows.select(
        "doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"),
        F.lit(now["version"]).cast("long").alias("version"), F.sha2("text", 256).alias("text_sha256"),
    ).join(listed, "shard", "left").select("doc_id", "shard", "shard_rows", "shard_bytes", "version", "text_sha256")
