"""Vector tiles: features cut to a tile, put on its whole-number grid and encoded, one tile for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wkb
from .geometry import tile_bounds

#: Units across a tile, and units around it that are kept.
EXTENT, BUFFER = 4096, 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        return _varint(number << 3) + _varint(body)
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def commands(kind: str, coords) -> list[int]:
    """Command integers of a geometry on the grid: move, line and close with differences."""
    cursor, out = [0, 0], []

    def run(points: np.ndarray, close: bool) -> None:
        p = np.rint(points).astype(int)
        p = p[np.concatenate(([True], (np.diff(p, axis=0) != 0).any(axis=1)))] if len(p) > 1 else p
        if close and len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if close and len(p) < 3:
            return
        steps = []
        for q in p:
            steps.append((_zigzag(int(q[0]) - cursor[0]), _zigzag(int(q[1]) - cursor[1])))
            cursor[:] = [int(q[0]), int(q[1])]
        out.extend([1 << 3 | 1, *steps[0]])
        if len(steps) > 1:
            out.extend([(len(steps) - 1) << 3 | 2, *(v for s in steps[1:] for v in s)])
        if close:
            out.append(1 << 3 | 7)

    if kind == "Point":
        run(np.array([coords], float), False)
    elif kind == "LineString":
        run(np.asarray(coords), False)
    elif kind == "Polygon":
        for r in coords:
            run(np.asarray(r), True)
    else:
        for c in coords:
            at = list(cursor)
            sub = commands(kind[5:], c) if at == [0, 0] else None
            if sub is None:
                run(np.array([c], float), False) if kind == "MultiPoint" else [run(np.asarray(r), kind == "MultiPolygon") for r in (c if kind == "MultiPolygon" else [c])]
            else:
                out.extend(sub)
                last = np.asarray(c if kind == "MultiPoint" else (c[-1] if kind == "MultiPolygon" else c)).reshape(-1, 2)
                q = np.rint(last[-2] if kind == "MultiPolygon" else last[-1]).astype(int)
                cursor[:] = [int(q[0]), int(q[1])]
    return out


def encode_layer(name: str, features: list[tuple[int, str, object, dict]]) -> bytes:
    """A tile of one layer; no features give no bytes."""
    if not features:
        return b""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = b""
    for i, kind, coords, props in features:
        tags = []
        for k, v in props.items():
            if v is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values))]
        geometry = commands(kind, coords)
        if geometry:
            code = {"Point": 1, "LineString": 2, "Polygon": 3}[kind.removeprefix("Multi")]
            body += _field(2, _field(1, int(i)) + _field(2, b"".join(map(_varint, tags))) + _field(3, code) + _field(4, b"".join(map(_varint, geometry))))
    if not body:
        return b""
    packed = b"".join(_field(3, k.encode()) for k in keys)
    for t, v in values:
        one = _field(7, int(v)) if t == "bool" else _field(1, v.encode()) if t == "str" else _varint(3 << 3 | 1) + np.array(v, "<f8").tobytes()
        packed += _field(4, one)
    return _field(3, _field(15, 2) + _field(1, name.encode()) + body + packed + _field(5, EXTENT))


def render_points(layer: DataFrame, z: int, properties: list[str], name: str = "layer") -> DataFrame:
    """(tx, ty, n, tile): the tiles of zoom z that points (id, mx, my in Web-Mercator) fall in, with the points in their
    margins; a tile's features meet in one task, as a tile is one file."""
    tile_bounds(z, 0, 0)
    n = 1 << z
    half = 20037508.342789244
    size = 2 * half / n
    margin = size * BUFFER / EXTENT
    span = lambda c, s: F.sequence(*[F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((s * c + half + d) / size))).cast("int") for d in (-margin, margin)])
    each = layer.withColumn("tx", F.explode(span(F.col("mx"), 1))).withColumn("ty", F.explode(span(F.col("my"), -1)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, _, _, y1 = tile_bounds(z, int(key[0]), int(key[1]))
        rows = pdf.sort_values("id")
        at = np.stack([(rows["mx"] - x0) / size * EXTENT, (y1 - rows["my"]) / size * EXTENT], axis=1)
        plain = lambda v: v.item() if hasattr(v, "item") else v
        features = [(i, "Point", tuple(p), {c: plain(v) for c, v in zip(properties, values)}) for i, p, values in zip(rows["id"], at, rows[properties].itertuples(index=False))]
        return pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "n": [len(features)], "tile": [encode_layer(name, features)]})

    return each.groupBy("tx", "ty").applyInPandas(run, "tx int, ty int, n int, tile binary")


def geojson_collection(layer: DataFrame, limit: int = 5000) -> DataFrame:
    """(feature): GeoJSON features of (id, geometry, props) up to a limit; should_use_geojson tells whether that is all."""

    def run(batches):
        import json

        for b in batches:
            out = [json.dumps({"type": "Feature", "id": str(i), "geometry": wkb.geojson(*wkb.decode(g)), "properties": json.loads(p or "{}")}) for i, g, p in zip(b["id"], b["geometry"], b["props"])]
            yield pd.DataFrame({"feature": out})

    return layer.select("id", "geometry", "props").orderBy("id").limit(limit).mapInPandas(run, "feature string")


def should_use_geojson(count: int | None, most: int = 5000) -> bool:
    return count is not None and count < most
