"""Shares of files as sources: listed, described and fetched, never parsed here.

A share is a folder that every node has mounted. The data source lists it in tasks: the driver only names the files of a batch, and
their checksums are read where the rows are made. A stream of it gives each file when it is new or has changed, once."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import LayerError, require

#: The suffixes of files that can be read as layers, and those that go with a shapefile.
SUFFIXES = (".shp", ".gpkg", ".geojson", ".json", ".csv", ".txt", ".xyz", ".las", ".grd", ".tif")
SIDECARS = (".shx", ".dbf", ".prj", ".cpg", ".qpj", ".sbn", ".sbx")
SCHEMA = "uri string, name string, size_bytes bigint, modified_at timestamp, checksum string, format_hint string"
#: Bytes read at a time, files of one task, and milliseconds after its last change from which a file counts as whole.
CHUNK, FILES, SETTLED = 1 << 20, 64, 1000


class UnknownSource(LayerError):
    """A URI that names nothing within reach."""


class PathTraversal(LayerError):
    """A path that leads out of its share."""


@dataclass(frozen=True)
class Share:
    root: str
    team: str | None = None


def checksum_of(path: str) -> str:
    """sha256 of a file, and for a shapefile of the files that go with it, read by parts."""
    h = hashlib.sha256()
    for part in [path, *sidecars(path)]:
        h.update(os.path.splitext(part)[1].lower().encode() + b"\0")
        with open(part, "rb") as f:
            while chunk := f.read(CHUNK):
                h.update(chunk)
    return h.hexdigest()


def sidecars(path: str) -> list[str]:
    stem, suffix = os.path.splitext(path)
    return [stem + s for s in SIDECARS if os.path.isfile(stem + s)] if suffix.lower() == ".shp" else []


def _changed_at(path: str) -> int:
    """Milliseconds of the last change of a file or what goes with it. The inode's time counts too: a copied file may keep the
    time it was written at elsewhere."""
    return max(max(s.st_mtime_ns, s.st_ctime_ns) for s in map(os.stat, [path, *sidecars(path)])) // 1_000_000


def files_of(root: str, suffixes: tuple[str, ...] = SUFFIXES) -> Iterator[str]:
    """Readable files below a folder, by name, relative to it; links that lead out of it are passed over."""
    top = os.path.realpath(root)
    for folder, folders, names in os.walk(top):
        folders.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() in suffixes and os.path.realpath(path).startswith(top + os.sep):
                yield os.path.relpath(path, top)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class _Listing:
    def __init__(self, options: dict):
        self.root, self.name = options["path"], options.get("share", "share")
        self.suffixes = tuple(options["suffixes"].split(",")) if "suffixes" in options else SUFFIXES

    def deal(self, names: list[str]) -> list[_Files]:
        return [_Files(names[k : k + FILES]) for k in range(0, len(names), FILES)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names if partition else ():  # no files make one task without any
            path = os.path.join(self.root, name)
            try:
                yield describe_file(f"share://{self.name}/{name}", path)
            except FileNotFoundError:
                continue  # gone since it was listed


def describe_file(uri: str, path: str) -> tuple:
    s = os.stat(path)
    return uri, os.path.basename(path), s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), checksum_of(path), os.path.splitext(path)[1].lower().lstrip(".")


class _Batch(_Listing, DataSourceReader):
    def partitions(self) -> list[_Files]:
        return self.deal(list(files_of(self.root, self.suffixes)))


class _Stream(_Listing, DataSourceStreamReader):
    """Offsets are times of change: a batch has the files that changed after its start, up to its end."""

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        settled = int(time.time() * 1000) - SETTLED
        return {"at": max([t for t in self._times().values() if t <= settled], default=-1)}

    def _times(self) -> dict[str, int]:
        return {n: _changed_at(os.path.join(self.root, n)) for n in files_of(self.root, self.suffixes)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return self.deal([n for n, t in self._times().items() if start["at"] < t <= end["at"]])

    def commit(self, end: dict) -> None:
        pass


class ShareSource(DataSource):
    """spark.read or readStream.format("share") with path (the share's folder), share (its name) and suffixes (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "share"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class FileShareConnector:
    """Sources on configured shares, as share://name/path."""

    kind = "fileshare"

    def __init__(self, spark: SparkSession, shares: dict[str, Share]):
        self.spark, self.shares = spark, shares
        spark.dataSource.register(ShareSource)

    def _share(self, uri: str) -> tuple[str, Share, str]:
        if not uri.startswith("share://") or not (name := uri[8:].partition("/")[0]):
            raise UnknownSource(f"{uri!r} is not of the form share://name/path")
        if name not in self.shares:
            raise UnknownSource(f"share {name!r} is not configured; there are {', '.join(sorted(self.shares)) or 'none'}")
        return name, self.shares[name], uri[8:].partition("/")[2]

    def resolve(self, uri: str) -> str:
        """The path of a URI; one that leaves the share, by dots or by a link, is refused."""
        _, share, rest = self._share(uri)
        root = os.path.realpath(share.root)
        path = os.path.realpath(os.path.join(root, rest))
        if path != root and not path.startswith(root + os.sep):
            raise PathTraversal(f"{uri!r} leads out of its share")
        return path

    def team_for(self, uri: str) -> str | None:
        """Who owns what comes from this source."""
        return self._share(uri)[1].team

    def list(self, prefix: str | None = None) -> DataFrame:
        """The readable files under a URI, or the shares themselves, as SCHEMA rows by uri."""
        if prefix is None:
            rows = [(f"share://{n}/", n, None, None, None, "share") for n in sorted(self.shares)]
            return self.spark.createDataFrame(rows, SCHEMA)
        name, share, _ = self._share(prefix)
        path = self.resolve(prefix)
        if os.path.isfile(path):
            return self.spark.createDataFrame([self._row(prefix, path)], SCHEMA)
        rest = os.path.relpath(path, os.path.realpath(share.root))
        found = self.spark.read.format("share").option("share", name if rest == "." else f"{name}/{rest}").load(path)
        return found.orderBy("uri")

    def _row(self, uri: str, path: str) -> tuple:
        return describe_file(uri, path)

    def changes(self, share: str) -> DataFrame:
        """A stream of SCHEMA rows: each file of a share when it is new or has changed."""
        _, s, _ = self._share(f"share://{share}/")
        return self.spark.readStream.format("share").option("share", share).load(os.path.realpath(s.root))

    def describe(self, uri: str) -> dict:
        path = self.resolve(uri)
        if not os.path.isfile(path):
            raise UnknownSource(f"{uri!r} is no file of the share; it may have been moved, pick the source again")
        return dict(zip(("uri", "name", "size_bytes", "modified_at", "checksum", "format_hint"), self._row(uri, path)))

    def has_changed(self, uri: str, known_checksum: str | None) -> bool:
        """Whether a source differs from what was last read; true where that can't be told."""
        return known_checksum is None or self.describe(uri)["checksum"] != known_checksum

    def changed(self, known: DataFrame, prefix: str) -> DataFrame:
        """The listed sources under a prefix whose checksum known (uri, checksum) doesn't have."""
        return self.list(prefix).join(known.where("checksum IS NOT NULL").select("uri", "checksum"), ["uri", "checksum"], "left_anti")

    def fetch(self, uri: str, destination: str) -> str:
        """Copies a file, and what goes with a shapefile, into a folder; the path to open there."""
        path = self.resolve(uri)
        if not os.path.isfile(path):
            raise UnknownSource(f"{uri!r} is no file of the share")
        os.makedirs(destination, exist_ok=True)
        for part in [*sidecars(path), path]:
            shutil.copyfile(part, os.path.join(destination, os.path.basename(part)))
        return os.path.join(destination, os.path.basename(path))


def read_source(connector: FileShareConnector, uri: str, destination: str, **options) -> DataFrame:
    """The layer of a source, fetched into a shared folder first, by the reader of its suffix, which takes the options."""
    from . import readers, shapefile

    suffix = os.path.splitext(uri)[1].lower()
    known = {".shp": shapefile.read_shapefile, ".geojson": readers.read_geojson, ".json": readers.read_geojson, ".csv": readers.read_xyz, ".txt": readers.read_xyz, ".xyz": readers.read_xyz}
    require(suffix in known, f"files of the kind {suffix or 'without suffix'} can't be read; convert it to one of {', '.join(sorted(known))}")
    return known[suffix](connector.spark, connector.fetch(uri, destination), **options)


def sync(connector: FileShareConnector, known: DataFrame, prefix: str) -> DataFrame:
    """(uri, size_bytes, modified_at, checksum, state) of a prefix against what was read of it: new, changed, same or gone."""
    now = connector.list(prefix).select("uri", "size_bytes", "modified_at", F.col("checksum").alias("now"))
    met = now.join(known.select("uri", F.col("checksum").alias("then")), "uri", "full")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return met.select("uri", "size_bytes", "modified_at", F.col("now").alias("checksum"), state.alias("state"))
