"""Shares: what is listed, what is refused, what is fetched, and a stream that gives each change once."""

import json
import os
import time

import pytest

from lithoframe.sources import connectors as C


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def share(spark, tmp_path):
    root = tmp_path / "picks"
    put(root / "a" / "wells.csv", "x,y,z\n1,2,3\n4,5,6\n")
    put(root / "b.SHP", "shape")
    put(root / "b.dbf", "table")
    put(root / "notes.docx", "no layer")
    put(root / "c" / "p.geojson", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    put(tmp_path / "secret.csv", "x,y\n1,2\n")
    os.symlink(tmp_path / "secret.csv", root / "link.csv")
    return C.FileShareConnector(spark, {"picks": C.Share(str(root), "team-7"), "empty": C.Share(str(tmp_path / "none"))})


def test_listing(share, tmp_path):
    assert [r.uri for r in share.list().collect()] == ["share://empty/", "share://picks/"]
    got = {r.uri: r for r in share.list("share://picks/").collect()}
    assert list(got) == ["share://picks/a/wells.csv", "share://picks/b.SHP", "share://picks/c/p.geojson"]
    wells = got["share://picks/a/wells.csv"]
    assert (wells.name, wells.size_bytes, wells.format_hint) == ("wells.csv", 18, "csv") and wells.checksum == share.describe(wells.uri)["checksum"]
    assert [r.uri for r in share.list("share://picks/c").collect()] == ["share://picks/c/p.geojson"]
    assert [r.name for r in share.list("share://picks/a/wells.csv").collect()] == ["wells.csv"]
    assert share.list("share://empty/").count() == 0 and share.team_for("share://picks/x") == "team-7"


def test_refusals(share):
    for uri in ("http://picks/a", "share://", "share://other/a.csv"):
        with pytest.raises(C.UnknownSource):
            share.describe(uri)
    for uri in ("share://picks/../secret.csv", "share://picks/link.csv", "share://picks/a/../../secret.csv"):
        with pytest.raises(C.PathTraversal):
            share.describe(uri)
    for act in (share.describe, lambda u: share.fetch(u, "/tmp/none")):
        with pytest.raises(C.UnknownSource):
            act("share://picks/a/gone.csv")


def test_fetch_takes_what_belongs_to_a_shapefile(share, tmp_path):
    assert share.fetch("share://picks/b.SHP", str(tmp_path / "got")) == str(tmp_path / "got" / "b.SHP")
    assert sorted(os.listdir(tmp_path / "got")) == ["b.SHP", "b.dbf"]
    layer = C.read_source(share, "share://picks/a/wells.csv", str(tmp_path / "wells"), x="x", y="y", z="z", srid=3857)
    assert sorted((r.x, r.y) for r in layer.collect()) == [(1.0, 2.0), (4.0, 5.0)]
    assert C.read_source(share, "share://picks/c/p.geojson", str(tmp_path / "json")).count() == 1
    with pytest.raises(C.LayerError):
        C.read_source(share, "share://picks/notes.docx", str(tmp_path / "doc"))


def test_changes_are_told(share, spark, tmp_path):
    uri, shape = "share://picks/a/wells.csv", "share://picks/b.SHP"
    known = spark.createDataFrame([(r.uri, r.checksum) for r in share.list("share://picks/").collect()] + [("share://picks/old.csv", "1")], "uri string, checksum string")
    sums = {r.uri: r.checksum for r in known.collect()}
    assert not share.has_changed(uri, sums[uri]) and share.has_changed(uri, None) and share.changed(known, "share://picks/").count() == 0
    put(tmp_path / "picks" / "b.dbf", "another table")
    put(tmp_path / "picks" / "new.xyz", "1 2 3")
    assert share.has_changed(shape, sums[shape])  # what goes with a shapefile counts
    states = {r.uri.split("/")[-1]: r.state for r in C.sync(share, known, "share://picks/").collect()}
    assert states == {"wells.csv": "same", "b.SHP": "changed", "p.geojson": "same", "new.xyz": "new", "old.csv": "gone"}
    assert sorted(r.uri for r in share.changed(known, "share://picks/").collect()) == [shape, "share://picks/new.xyz"]


def test_a_stream_gives_each_change_once(share, spark, tmp_path):
    def run():
        time.sleep(C.SETTLED / 1000 + 0.1)
        q = share.changes("picks").select("uri", "checksum").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination(120)
        return [r.uri.split("/")[-1] for r in spark.read.schema("uri string, checksum string").parquet(str(tmp_path / "out")).collect()]

    assert sorted(run()) == ["b.SHP", "p.geojson", "wells.csv"]
    assert len(run()) == 3
    put(tmp_path / "picks" / "a" / "wells.csv", "x,y,z\n9,9,9\n")
    assert sorted(run()) == ["b.SHP", "p.geojson", "wells.csv", "wells.csv"]
    assert len(run()) == 4
