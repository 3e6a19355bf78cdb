"""Well-known binary: points, linestrings, polygons and their multiples, two-dimensional, by NumPy; and Column readers of points."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
CODES = {n: c for c, n in NAMES.items()}


def encode(kind: str, coords) -> bytes:
    """coords: (x, y); [n, 2]; a list of rings; or a list of those for multiples."""
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "Point":
        return head + struct.pack("<dd", *coords)
    if kind == "LineString":
        a = np.asarray(coords, "<f8")
        return head + struct.pack("<I", len(a)) + a.tobytes()
    if kind == "Polygon":
        rings = [np.asarray(r, "<f8") for r in coords]
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in rings)
    return head + struct.pack("<I", len(coords)) + b"".join(encode(kind[5:], c) for c in coords)


def decode(data: bytes) -> tuple[str, object]:
    """(kind, coords) as encode takes them; Z and M are dropped."""
    return _read(memoryview(data), 0)[:2]


def _read(b: memoryview, at: int):
    order = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    plain = code & 0xFFFF
    extra = (1 if code & 0x80000000 or plain // 1000 in (1, 3) else 0) + (1 if code & 0x40000000 or plain // 1000 in (2, 3) else 0)
    kind, width = NAMES[plain % 1000], 2 + extra

    def run(n: int, at: int):
        return np.frombuffer(b, order + "f8", n * width, at).reshape(n, width)[:, :2], at + 8 * n * width

    if kind == "Point":
        a, at = run(1, at)
        return kind, (float(a[0, 0]), float(a[0, 1])), at
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    if kind == "LineString":
        a, at = run(n, at)
        return kind, a, at
    out = []
    for _ in range(n):
        if kind == "Polygon":
            (m,) = struct.unpack_from(order + "I", b, at)
            a, at = run(m, at + 4)
            out.append(a)
        else:
            _, c, at = _read(b, at)
            out.append(c)
    return kind, out, at


def kind_column(wkb: Column) -> Column:
    """point, linestring or polygon of little-endian geometries, multiples with their singles."""
    code = F.conv(F.hex(F.substring(wkb, 2, 1)), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, ("point", "linestring", "polygon"))), (code - 1) % 3 + 1)


def points_to_wkb(x: Column, y: Column) -> Column:
    @pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(a) or np.isnan(b) else encode("Point", (a, b)) for a, b in zip(x, y)])

    return run(x.cast("double"), y.cast("double"))


def xy(wkb: Column) -> Column:
    """Struct (x, y) of points, null for others."""
    @pandas_udf("x double, y double")
    def run(g: pd.Series) -> pd.DataFrame:
        got = [decode(v) if v is not None else (None, None) for v in g]
        return pd.DataFrame([c if k == "Point" else (None, None) for k, c in got], columns=["x", "y"])

    return run(wkb)


def wkt(kind: str, coords) -> str:
    pair = lambda p: f"{p[0]:.15g} {p[1]:.15g}"
    ring = lambda r: "(" + ", ".join(pair(p) for p in r) + ")"
    if kind == "Point":
        return f"POINT ({pair(coords)})"
    body = ring(coords) if kind == "LineString" else "(" + ", ".join(ring(r) for r in coords) + ")"
    if kind.startswith("Multi"):
        body = "(" + ", ".join(wkt(kind[5:], c).split(" ", 1)[1] for c in coords) + ")"
    return f"{kind.upper()} {body}"


def geojson(kind: str, coords) -> dict:
    plain = lambda c: c.tolist() if isinstance(c, np.ndarray) else [plain(x) for x in c] if isinstance(c, (list, tuple)) else c
    return {"type": kind, "coordinates": plain(coords)}


def from_geojson(g: dict) -> bytes:
    return encode(g["type"], g["coordinates"])
