"""Shapefiles: read into layers by Arrow batches, written from layers, zipped.

A shapefile ends at 2 GB by its format, so one task reads one file whole; many files are read side by side. Attributes
are decoded by the given encoding, else by what .cpg says, else as UTF-8; none is guessed."""

from __future__ import annotations

import codecs
import json
import os
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions import projections, wkb
from ..layers import frame_of, in_frame
from ..operators.polygons import area
from .readers import attribute_schema, resolve_srid
from .store import shapefile_field_names

#: Fixed values of the format: codes of shapes (with Z or M the XY part is the same), bytes of a header, a file, a text field.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
HEADER, FILE_MAX, TEXT_MAX = 100, (2 << 30) - 1, 254
#: Rows of a batch that a reader passes on.
ROWS = 10_000


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return bool(((b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > x).sum() % 2)


def _polygon(rings: list[np.ndarray]) -> tuple[str, list]:
    """Clockwise rings are outer ones; another belongs to the smallest outer ring around it, and is outer itself if there is
    none. Outer rings come out counter-clockwise."""
    outer = [r[::-1] for r in rings if area(r) < 0]
    parts, sizes = [[r] for r in outer], [area(r) for r in outer]
    for hole in (r for r in rings if area(r) >= 0):
        around = [i for i, r in enumerate(outer) if _inside(r, *hole[0]) or _inside(r, *((hole[0] + hole[1]) / 2))]
        if around:
            parts[min(around, key=sizes.__getitem__)].append(hole[::-1])
        else:
            parts.append([hole])
    return ("Polygon", parts[0]) if len(parts) == 1 else ("MultiPolygon", parts)


def _shape(b: memoryview) -> bytes | None:
    code = struct.unpack_from("<i", b)[0]
    if code == 0:
        return None
    kind = SHAPES.get(code % 10)
    require(kind is not None and code < 30, f"shapes of type {code} can't be read")
    if kind == "Point":
        return wkb.encode("Point", struct.unpack_from("<dd", b, 4))
    if kind == "MultiPoint":
        (n,) = struct.unpack_from("<i", b, 36)
        return wkb.encode("MultiPoint", np.frombuffer(b, "<f8", 2 * n, 40).reshape(n, 2).tolist())
    parts, n = struct.unpack_from("<ii", b, 36)
    cuts = [*struct.unpack_from(f"<{parts}i", b, 44), n]
    xy = np.frombuffer(b, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    runs = [xy[i:j] for i, j in zip(cuts, cuts[1:])]
    if kind == "Polygon":
        return wkb.encode(*_polygon(runs))
    return wkb.encode("LineString", runs[0]) if len(runs) == 1 else wkb.encode("MultiLineString", runs)


def _shapes(data: bytes) -> Iterator[bytes | None]:
    require(len(data) >= HEADER and struct.unpack_from(">i", data)[0] == 9994, "the file is no shapefile")
    b, at = memoryview(data), HEADER
    end = min(len(data), 2 * struct.unpack_from(">i", data, 24)[0])
    while at + 8 <= end:
        size = 2 * struct.unpack_from(">i", b, at + 4)[0]
        require(at + 8 + size <= len(data), "the shapefile ends inside a record")
        yield _shape(b[at + 8 : at + 8 + size])
        at += 8 + size


def _value(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding).rstrip(" \0")
    if kind in "NF":
        text = text.strip()
        if not text or set(text) == {"*"}:
            return None
        return int(text) if text.lstrip("+-").isdigit() else float(text)
    if kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text.strip().lower())
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if text.strip("0 ") else None
    return text or None


def _records(data: bytes, encoding: str) -> Iterator[dict | None]:
    """Attributes of each record; None for one that is marked as deleted."""
    rows, start, width = struct.unpack_from("<IHH", data, 4)
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        name, kind, size = data[at : at + 11].split(b"\0")[0].decode(encoding), chr(data[at + 11]), data[at + 16]
        fields.append((name, kind, place, place + size))
        at, place = at + 32, place + size
    for r in range(rows):
        row = data[start + r * width : start + (r + 1) * width]
        yield None if row[:1] == b"*" else {name: _value(row[a:b], kind, encoding) for name, kind, a, b in fields}


def read_shapefile(spark: SparkSession, path: str, srid: int | None = None, encoding: str | None = None) -> DataFrame:
    """(file, id, geometry, props) of the shapefiles of a folder, or of the one that path names; id counts records from 1.

    The frame is the given one, or the only one that the .prj files declare. Records marked as deleted go; null shapes stay
    as null geometries; without .dbf, props are empty."""
    folder, name = (os.path.dirname(path), os.path.basename(path)[:-4]) if path.lower().endswith(".shp") else (path, "*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.{{shp,dbf,prj,cpg,SHP,DBF,PRJ,CPG}}").load(folder)
    stem, kind = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parts = files.select(stem.alias("file"), kind.alias("kind"), "path", "content")
    declared = [r[0] for r in parts.where("kind = 'prj'").select(F.decode("content", "UTF-8").alias("text")).distinct().limit(2).collect()] if srid is None else []
    require(len(declared) < 2, "the files declare several coordinate systems; read them one by one, or give an EPSG code")
    srid = resolve_srid(srid, projections.epsg_from_user_input(declared[0]) if declared else None, declared[0] if declared else None)
    content = lambda k: F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k)
    whole = parts.where("kind <> 'prj'").groupBy("file").agg(content("shp"), content("dbf"), content("cpg")).where("shp IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, shp, dbf, cpg in batch.itertuples(index=False):
                use = encoding or (bytes(cpg).decode("ascii").strip() if cpg is not None else "UTF-8")
                use = f"cp{use}" if use.isdigit() else use
                codecs.lookup(use)
                shapes = _shapes(bytes(shp))
                rows = _records(bytes(dbf), use) if dbf is not None else None
                held = []
                for i, g in enumerate(shapes, 1):
                    props = next(rows) if rows is not None else {}
                    if props is not None:
                        held.append((file, i, g, json.dumps(props, ensure_ascii=False)))
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=["file", "id", "geometry", "props"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "id", "geometry", "props"])

    return in_frame(whole.mapInPandas(run, "file string, id long, geometry binary, props string"), srid)


def _packed(kind: str, coords) -> tuple[bytes, np.ndarray]:
    """(content of a record, its points)."""
    if kind == "Point":
        return struct.pack("<idd", 1, *coords), np.array([coords])
    if kind == "MultiPoint":
        xy = np.array(coords, float)
        return struct.pack("<i4di", 8, *xy.min(axis=0), *xy.max(axis=0), len(xy)) + xy.astype("<f8").tobytes(), xy
    if kind.endswith("Polygon"):
        polygons = coords if kind.startswith("Multi") else [coords]
        # outer rings go clockwise, holes the other way
        runs = [np.asarray(r) if (area(np.asarray(r)) < 0) == (i == 0) else np.asarray(r)[::-1] for p in polygons for i, r in enumerate(p)]
    else:
        runs = [np.asarray(r) for r in (coords if kind.startswith("Multi") else [coords])]
    xy = np.concatenate(runs)
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]]).astype("<i4")
    return struct.pack("<i4dii", 5 if kind.endswith("Polygon") else 3, *xy.min(axis=0), *xy.max(axis=0), len(runs), len(xy)) + starts.tobytes() + xy.astype("<f8").tobytes(), xy


def _cell(v, kind: str, width: int, name: str) -> bytes:
    if v is None:
        return b"?" if kind == "L" else b" " * width
    if kind == "L":
        return b"T" if v in (True, "true") else b"F"
    raw = (str(int(v)) if kind == "N" else repr(float(v)) if kind == "F" else v if isinstance(v, str) else json.dumps(v)).encode()
    require(len(raw) <= width, f"a value of {name!r} takes {len(raw)} bytes, and {width} is the most; choose GeoParquet")
    return raw.rjust(width) if kind in "NF" else raw.ljust(width)


def write_shapefile(layer: DataFrame, directory: str, stem: str = "layer", srid: int | None = None) -> list[str]:
    """Writes (geometry, props) as .shp, .shx, .dbf, .prj and .cpg into a local folder; the files' paths.

    The driver streams partitions one after another, so it holds one at a time. The layer has one kind of geometry (multiples
    count as their kind); names longer than ten letters are shortened as shapefile_field_names does; attributes are typed by
    their contents over all rows; a value or a file that the format can't hold is an error."""
    srid = srid or frame_of(layer)
    require(srid is not None, "the layer's frame is unknown; give srid")
    types = {r["name"]: r["type"] for r in attribute_schema(layer).collect()}
    short = shapefile_field_names(sorted(types))
    form = {"boolean": ("L", 1), "integer": ("N", 20), "number": ("F", 24)}
    fields = [(n, short[n], *form.get(types[n], ("C", TEXT_MAX))) for n in sorted(types)]
    os.makedirs(directory, exist_ok=True)
    paths = [f"{directory}/{stem}.{e}" for e in ("shp", "shx", "dbf", "prj", "cpg")]
    code, count, at, low, high = 0, 0, HEADER, np.full(2, np.inf), np.full(2, -np.inf)
    with open(paths[0], "wb") as shp, open(paths[1], "wb") as shx, open(paths[2], "wb") as dbf:
        shp.write(bytes(HEADER)), shx.write(bytes(HEADER))
        head = 33 + 32 * len(fields)
        dbf.write(bytes(head))
        for row in layer.select("geometry", "props").toLocalIterator():
            body = struct.pack("<i", 0)
            if row["geometry"] is not None:
                body, xy = _packed(*wkb.decode(bytes(row["geometry"])))
                own = struct.unpack_from("<i", body)[0]
                require(code in (0, own), f"a shapefile holds one kind of geometry, and the layer has {SHAPES.get(code)} and {SHAPES[own]}; split it")
                code, low, high = own, np.minimum(low, xy.min(axis=0)), np.maximum(high, xy.max(axis=0))
            count += 1
            shp.write(struct.pack(">ii", count, len(body) // 2) + body)
            shx.write(struct.pack(">ii", at // 2, len(body) // 2))
            at += 8 + len(body)
            require(at <= FILE_MAX, "a shapefile ends at 2 GB; choose GeoParquet")
            props = json.loads(row["props"] or "{}")
            dbf.write(b" " + b"".join(_cell(props.get(n), k, w, n) for n, _, k, w in fields))
        dbf.write(b"\x1a")
        box = (*low, *high) if code else (0.0,) * 4
        for f, size in ((shp, at), (shx, HEADER + 8 * count)):
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii8d", 1000, code, *box, 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(struct.pack("<B3BIHH20x", 3, 126, 1, 1, count, head, 1 + sum(w for *_, w in fields)))
        for _, n, k, w in fields:
            dbf.write(n.encode()[:10].ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, 15 if k == "F" else 0]) + bytes(14))
        dbf.write(b"\r")
    for path, text in ((paths[3], projections.crs_definition(srid)), (paths[4], "UTF-8")):
        with open(path, "w") as f:
            f.write(text)
    return paths


def zip_shapefile(directory: str, archive: str, stem: str = "layer") -> list[str]:
    """An archive of the parts of one shapefile; their names."""
    names = sorted(n for n in os.listdir(directory) if os.path.splitext(n)[0] == stem and n != os.path.basename(archive))
    require(any(n.endswith(".shp") for n in names), f"{directory} holds no {stem}.shp")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(f"{directory}/{n}", n)
    return names
