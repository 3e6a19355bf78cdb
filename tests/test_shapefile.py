"""Shapefiles written and read again, and bytes made by hand."""

import json
import struct
import zipfile

import numpy as np
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.layers import frame_of, in_frame
from lithoframe.sources import shapefile as S

SQUARE = np.array([[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], float)
HOLE = np.array([[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]], float)


def layer(spark, rows, srid=2277):
    data = [(None if s is None else bytearray(wkb.encode(*s)), json.dumps(p, ensure_ascii=False)) for s, p in rows]
    return in_frame(spark.createDataFrame(data, "geometry binary, props string").coalesce(1), srid)


def flat(kind, c):
    return kind, np.round(np.concatenate([np.ravel(v) for v in np.array(c, dtype=object).ravel()] if kind == "Point" else [np.ravel(r) for r in _runs(kind, c)]), 9).tolist()


def _runs(kind, c):
    return [c] if kind in ("LineString", "MultiPoint") else c if kind in ("Polygon", "MultiLineString") else [r for p in c for r in p]


@pytest.mark.parametrize("rows", [
    [(("Point", (1.5, -2.0)), {"name": "Ölfeld", "depth_in_feet": 1, "depth_in_metres": 0.1, "ok": True}), (None, {"name": None, "ok": False}), (("Point", (3.0, 4.0)), {"depth_in_feet": -7})],
    [(("LineString", SQUARE), {"a": 1}), (("MultiLineString", [SQUARE, HOLE]), {"a": 2})],
    [(("Polygon", [SQUARE, HOLE]), {"a": "x"}), (("MultiPolygon", [[SQUARE, HOLE], [SQUARE + 20]]), {"a": "é"}), (("Polygon", [SQUARE]), {})],
    [(("MultiPoint", [(1.0, 2.0), (3.0, 4.0)]), {"n": 123456789012})],
])
def test_round_trip(spark, tmp_path, rows):
    S.write_shapefile(layer(spark, rows), str(tmp_path / "w"))
    back = S.read_shapefile(spark, str(tmp_path / "w"))
    assert frame_of(back) == 2277
    got = sorted(back.collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(1, len(rows) + 1)) and {r.file for r in got} == {"layer"}
    for r, (shape, props) in zip(got, rows):
        assert (r.geometry is None) == (shape is None)
        if shape is not None:
            assert flat(*wkb.decode(bytes(r.geometry))) == flat(*shape)
        read = {k: v for k, v in json.loads(r.props).items() if v is not None}
        names = S.shapefile_field_names(sorted({k for _, p in rows for k in p}))
        assert read == {names[k]: v for k, v in props.items() if v is not None}
    S.zip_shapefile(str(tmp_path / "w"), str(tmp_path / "w" / "layer.zip"))
    assert len(zipfile.ZipFile(tmp_path / "w" / "layer.zip").namelist()) == 5


def test_refusals_and_encodings(spark, tmp_path):
    point = layer(spark, [(("Point", (1.0, 2.0)), {"n": "é"})])
    d = tmp_path / "e"
    S.write_shapefile(point, str(d))
    (d / "layer.prj").unlink()
    with pytest.raises(LayerError, match="EPSG"):
        S.read_shapefile(spark, str(d))
    raw = (d / "layer.dbf").read_bytes()
    (d / "layer.dbf").write_bytes(raw.replace("é ".encode(), b"\xe9  "))
    (d / "layer.cpg").write_text("ISO-8859-1")
    assert [json.loads(r.props) for r in S.read_shapefile(spark, str(d / "layer.shp"), 4326).collect()] == [{"n": "é"}]
    (d / "layer.cpg").unlink()
    with pytest.raises(Exception, match="utf-8"):
        S.read_shapefile(spark, str(d), 4326).collect()
    with pytest.raises(LayerError, match="one kind"):
        S.write_shapefile(layer(spark, [(("Point", (1.0, 2.0)), {}), (("LineString", SQUARE), {})]), str(tmp_path / "m"))
    with pytest.raises(LayerError, match="254"):
        S.write_shapefile(layer(spark, [(("Point", (1.0, 2.0)), {"long": "x" * 300})]), str(tmp_path / "l"))


def test_bytes_by_hand_with_z_and_a_deleted_record(spark, tmp_path):
    body = lambda x: struct.pack("<idddd", 11, x, 2.0, 3.0, 0.0)
    records = b"".join(struct.pack(">ii", i, 18) + body(float(i)) for i in (1, 2))
    (tmp_path / "a.shp").write_bytes(struct.pack(">i20xi", 9994, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 11, *[0.0] * 8) + records)
    field = b"D".ljust(11, b"\0") + b"D" + bytes(4) + bytes([8, 0]) + bytes(14)
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 1, 1, 1, 2, 65, 9) + field + b"\r" + b"*20200101" + b" 20210203")
    got = S.read_shapefile(spark, str(tmp_path), 4326).collect()
    assert [(r.id, wkb.decode(bytes(r.geometry)), json.loads(r.props)) for r in got] == [(2, ("Point", (2.0, 2.0)), {"D": "2021-02-03"})]
