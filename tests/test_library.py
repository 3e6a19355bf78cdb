"""Closed forms, refusals, files and streams."""

import json
import math
import shutil

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoframe.errors import LayerError
from lithoframe.functions import geometry as G
from lithoframe.functions import style, wkb
from lithoframe.layers import in_frame, points, table
from lithoframe.operators import aggregate, attributes, contours, grids, neighbours, polygons, registry, solvers, spatial, statistics, variogram
from lithoframe.sources import readers, store
from lithoframe.streaming import windows


def test_wkb_round_trip():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], float)
    for kind, c in (("Point", (1.0, 2.0)), ("LineString", square), ("Polygon", [square, square[::-1] / 4]), ("MultiPoint", [(1.0, 2.0), (3.0, 4.0)]), ("MultiPolygon", [[square], [square + 9]])):
        k, got = wkb.decode(wkb.encode(kind, c))
        assert k == kind and np.allclose(np.concatenate([np.ravel(x) for x in got]) if isinstance(got, list) else got, np.concatenate([np.ravel(x) for x in c]) if isinstance(c, list) else c)
    assert wkb.wkt("Point", (1.0, 2.5)) == "POINT (1 2.5)"


def test_hulls_and_clips():
    p = np.random.default_rng(1).random((200, 2))
    h = polygons.hull(p)
    assert polygons.area(h) > 0 and all(polygons.area(np.array([a, b, q, a])) >= -1e-12 for a, b in zip(h, h[1:]) for q in p)
    c = polygons.concave(p, 0.2)
    assert 0 < polygons.area(c) < polygons.area(h)
    x, y, r = polygons.pole(polygons.circle(3, 4, 2, 64), 0.01)
    assert math.hypot(x - 3, y - 4) < 0.1 and abs(r - 2) < 0.05


def test_cone_bands_within_half_a_percent(spark):
    i = F.col("id")
    x, y = (F.pmod(i, F.lit(201)) - 100) * 10.0, (F.floor(i / 201) - 100) * -10.0
    cone = spark.range(201 * 201).select(F.pmod(i, F.lit(201)).cast("int").alias("col"), F.floor(i / 201).cast("int").alias("row"), x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("value"))
    got = {r.lower: r.area for r in contours.bands(cone, [200.0, 400.0, 600.0]).collect()}
    for lo, hi in ((200.0, 400.0), (400.0, 600.0)):
        want = math.pi * (hi * hi - lo * lo)
        assert abs(got[lo] - want) / want < 0.005


@given(st.lists(st.floats(-1e6, 1e6), min_size=40, max_size=80, unique=True), st.integers(2, 6))
@settings(max_examples=30, deadline=None)
def test_jenks_cuts_rise(values, n):
    v = np.sort(np.array(values))
    cuts = statistics.jenks_cuts(v, n)
    assert len(cuts) == n - 1 and all(a < b for a, b in zip(cuts, cuts[1:]))


@given(st.floats(-1e5, 1e5), st.floats(1e-3, 1e5), st.integers(2, 9))
@settings(max_examples=100, deadline=None)
def test_pretty_breaks_lie_inside(lo, span, n):
    b = statistics.pretty_breaks(lo, lo + span, n)
    assert len(b) == n - 1 and all(lo < v < lo + span for v in b) and all(x < y for x, y in zip(b, b[1:]))


def test_kriging_is_exact_and_minimum_curvature_bends_least():
    xy = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10]])
    m = variogram.Model("spherical", 0.0, 1.0, 30.0)
    z = np.array([1.0, 2, 3, 4])
    got, v = solvers.solve_kriging(xy, z, np.array([0.001, 0.0]), m)
    assert abs(got - 1) < 0.01 and v < 0.01
    s, n = solvers.minimum_curvature_array(11, 11, xy, np.array([0.0, 10, 20, 30]))
    gx, gy = np.meshgrid(np.arange(11), np.arange(11))
    assert n < 5000 and np.abs(s - (gx + 2 * gy)).max() < 0.2


def test_variogram_models_and_columns_agree(spark):
    for kind in variogram.MODELS:
        m = variogram.Model(kind, 0.1, 2.0, 50.0, 1.5)
        got = [r.g for r in spark.range(20).select(m.gamma_column(F.col("id") * 4.0).alias("g")).collect()]
        assert np.allclose(got, m.gamma(np.arange(20) * 4.0)) and got[0] == 0
    with pytest.raises(LayerError):
        variogram.Model("matern", 0.0, 1.0, 1.0, 0.7)


def test_refusals(spark, sf_dir):
    p = points(spark, sf_dir)
    for f in (
        lambda: attributes.page(p, offset=-1), lambda: aggregate.Stat("sum", "s"), lambda: aggregate.aggregate("hexbin", []), lambda: spatial.clip(p, None), lambda: spatial.buffer_boxes(p, 0),
        lambda: grids.check_grid_size(10_000, 10_000, 1.0), lambda: aggregate.aggregate_points(p, 0.0, []), lambda: style.parse_hex("red"), lambda: contours.auto_levels(1.0, 1.0), lambda: readers.resolve_srid(None, None),
    ):
        with pytest.raises(LayerError):
            f()
    with pytest.raises(ValueError):
        spatial.pairs(in_frame(spatial.as_boxes(p), 2277), in_frame(spatial.as_boxes(p), 32613))


def test_json_numbers_only(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":"2"}',), ('{"a":true}',), ('{"a":null}',), ("{}",), ('{"a":1.5}',)], "props string")
    assert [r.v for r in df.select(aggregate.json_number("a").alias("v")).collect()] == [1.0, None, None, None, None, 1.5]


def test_store_versions_pruning_and_conflicts(spark, sf_dir, tmp_path):
    layer = store.with_bbox(points(spark, sf_dir).withColumn("props", F.lit("{}")), 5.0)
    s = store.LayerStore(spark, f"file://{tmp_path}/layer")
    assert s.write(layer, 0) == 1
    edits = spark.createDataFrame([(1, 1, False, "x"), (2, 1, True, None), (2, 2, False, "y"), (3, 1, True, None)], "id long, seq int, deleted boolean, seg string")
    assert s.save_edits(edits, 1) == 2
    with pytest.raises(store.VersionConflict):
        s.save_edits(edits, 1)
    now = {r.id: r.seg for r in s.read().select("id", "seg").collect()}
    assert now[1] == "x" and now[2] == "y" and 3 not in now and len(now) == layer.count() - 1 and s.read(1).count() == layer.count()
    with pytest.raises(LayerError):
        registry.apply_edits(layer, spark.createDataFrame([(-5, 1, True)], "id long, seq int, deleted boolean"))
    bounds = store.row_group_bounds(s.folder(1))
    assert bounds and all(b["xmin"] <= b["xmax"] for b in bounds)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = s.read().where(attributes.overlaps_box("bbox", (0.0, 0.0, 9.0, 9.0)))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(bbox.xmin" in plan


def test_readers_and_writers(spark, sf_dir, tmp_path):
    (tmp_path / "p.csv").write_text("lon,lat,porosity,name\n1,2,0.3,a\nx,2,0.3,b\n3,4,N/A,c\n")
    got = readers.read_xyz(spark, str(tmp_path / "p.csv"), x="lon", y="lat", z="porosity", srid=4326).collect()
    assert [(r.x, r.y, r.z, json.loads(r.props)) for r in got] == [(1.0, 2.0, 0.3, {"name": "a"}), (3.0, 4.0, None, {"name": "c"})]
    assert readers.propose_mapping(["Lon", "LAT", "name"]) == {"x": "Lon", "y": "LAT", "z": None}
    p = points(spark, sf_dir).limit(20)
    store.write_geojson(p.coalesce(1), str(tmp_path / "g"), ["v", "seg"])
    body = [json.loads(line) for f in (tmp_path / "g").glob("part-*") for line in f.read_text().splitlines()]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [*body, {"type": "Feature", "id": 1, "geometry": None, "properties": {}}]}))
    layer = readers.read_geojson(spark, str(tmp_path / "c.geojson"))
    back = readers.read_control(layer, "v").collect()
    assert {(int(r.id), r.x, r.y, r.value) for r in back} == {(r.id, r.x, r.y, r.v) for r in p.collect()}
    assert readers.geometry_kind(layer).first().kind == "point"
    assert {r.name: r.type for r in readers.attribute_schema(layer).collect()} == {"v": "number", "seg": "string"}
    assert readers.sanitize_name("../con.shp") == "layer" and readers.sanitize_name("Wells é/№1*.csv") == "No1_.csv"
    assert store.shapefile_field_names(["porosity_average", "porosity_avg_2", "permeability_md"]) == {"porosity_average": "porosity_a", "porosity_avg_2": "porosity_1", "permeability_md": "permeabili"}
    assert store.blocking(store.plan_export([("a", "number", True)], "mixed", "shapefile", 5))


def test_archives_are_held_to_limits(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/b.txt", "hello")
    assert len(readers.safe_extract(str(tmp_path / "ok.zip"), str(tmp_path / "out"))) == 1
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../../evil.txt", "x")
    with pytest.raises(LayerError):
        readers.safe_extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_streams_match_batches(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in")
    stream = windows.stream_events(spark, str(tmp_path / "in"), events.schema)
    q = windows.tumbling(stream, late="2 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("tumbled").collect()} == want
    seen = []
    for _ in range(2):
        windows.refresh(stream, str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    assert seen == [events.count()]


def test_palettes_and_labels(spark):
    stops = style.read_palette("0 0 0 0 50 255 255 255\n50 255 255 255 100 255 0 0\n", "cpt")
    assert stops == [(0.0, "#000000"), (0.5, "#ffffff"), (1.0, "#ff0000")]
    assert style.read_palette(style.write_palette(stops, "json"), "json") == stops and style.read_palette(style.write_palette(stops, "cpt"), "cpt") == stops
    got = spark.range(1).select(style.sample_ramp(stops, 3).alias("r"), style.sample_ramp(stops, 1).alias("m")).first()
    assert got.r == ["#000000", "#ffffff", "#ff0000"] and got.m == ["#ffffff"]
    assert style.class_label([1.0, 2.5], 1, "ft") == "1 – 2.5 ft" and style.pretty_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    layers = style.compile_symbology({"type": "graduated", "field": "v", "breaks": [1, 2], "colors": ["#a", "#b", "#c"]}, "src")
    assert layers[0]["color"][:3] == ["step", ["to-number", ["get", "v"]], "#a"]
    text = spark.createDataFrame([("http://t/x?token=abc&y=1 <b>\n",)], "s string")
    assert text.select(style.clean(style.redact_urls(F.col("s"))).alias("s")).first().s == "http://t/x?token=***&amp;y=1 &lt;b&gt;"


def test_knn_finishes_far_queries(spark):
    p = spark.range(50).select("id", (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"))
    q = spark.createDataFrame([(1, 1e6, 1e6), (2, 3.0, 0.0)], "query_id long, x double, y double")
    got = {(r.query_id, r["rank"]): r.id for r in neighbours.knn(q, p, 3).collect()}
    assert got == {(1, 1): 49, (1, 2): 48, (1, 3): 47, (2, 1): 3, (2, 2): 2, (2, 3): 4}


def test_hilbert_neighbours_are_adjacent(spark):
    cells = spark.range(256).select((F.pmod("id", F.lit(16)) * 1.0).alias("x"), (F.floor(F.col("id") / 16) * 1.0).alias("y"))
    rows = sorted((r.h, r.x, r.y) for r in cells.select("x", "y", G.hilbert_index(F.col("x"), F.col("y"), (0.0, 0.0, 15.0, 15.0), 4).alias("h")).collect())
    assert [r[0] for r in rows] == list(range(256)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_resolution_policies_and_catalogue(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 3.0, 5.0), (2, 1.0, 7.0)], "g int, area double, v double")
    for policy, want in (("largest", {1: 5.0, 2: 7.0}), ("common", {1: 5.0, 2: 7.0}), ("sum_numeric", {1: 10.0, 2: 7.0})):
        assert {r.g: r.v for r in aggregate.resolve_attributes(df, "g", ["v"], F.col("area"), policy).collect()} == want
    assert len(aggregate.operations()) == 15


def test_tiles_are_decodable_by_hand():
    from lithoframe.functions import mvt

    assert mvt.encode_layer("a", []) == b""
    assert mvt.commands("Point", (25, 17)) == [9, 50, 34]
    assert mvt.commands("LineString", [(2, 2), (2, 10), (10, 10)]) == [9, 4, 4, 18, 0, 16, 16, 0]
    assert mvt.commands("Polygon", [[(3, 6), (8, 12), (20, 34), (3, 6)]]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert mvt.commands("MultiPoint", [(5, 7), (3, 2)]) == [9, 10, 14, 9, 3, 9]
    tile = mvt.encode_layer("pts", [(1, "Point", (25, 17), {"k": "v", "n": 1.5})])
    assert tile[0] == 0x1A and b"pts" in tile and b"v" in tile


def test_trends_recover_what_made_the_data(spark):
    from lithoframe.operators import trend

    r = np.random.default_rng(2)
    x = r.random((300, 2)) + 0.5
    for name, theta in (("linear", [1.0, 2.0, -1.0]), ("loglinear", [0.1, 0.5, 0.2]), ("cobb_douglas", [0.3, 0.6, 0.2])):
        f = trend.preset(name, 2)
        y = f.f(x, np.array(theta)) + r.normal(size=300) * 0.01
        got, cov = trend.gls(x, y, f)
        assert np.allclose(got, theta, atol=0.05) and not trend.unidentified(f, got, cov) and (trend.trend_variance(x, f, got, cov) > 0).all()
    assert trend.turning(x, trend.Form("hump", ("a",), lambda x, t: -((x[:, 0] - 1) ** 2), (0.0,)), np.array([0.0])) == [0]
    with pytest.raises(ValueError):
        trend.parse_expression("__import__('os').system('x')", {"x": F.lit(1.0)})


def test_reml_finds_the_range():
    from lithoframe.operators import trend

    r = np.random.default_rng(4)
    xy = r.random((250, 2)) * 100
    true = variogram.Model("exponential", 0.05, 1.0, 30.0)
    c = true.covariance(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]))
    z = np.linalg.cholesky(c + 1e-9 * np.eye(250)) @ r.normal(size=250)
    got = trend.fit_reml(xy, z, np.ones((250, 1)), variogram.Model("exponential", 0.2, 0.5, 10.0))
    assert 12 < got.range < 80 and 0.3 < got.sill < 3


def test_documents(spark):
    from datetime import date

    from lithoframe.operators import documents as D

    assert len(D.short_code()) == 6 and D.filename("My Layer (1)", "csv", date(2024, 1, 2)) == "my_layer_1_20240102.csv"
    assert D.normalise_layers([{"id": 1}]) == [{"id": 1, "visible": True, "opacity": 1.0}]
    for bad in (lambda: D.normalise_layers([{"id": 1}, {"id": 1}]), lambda: D.normalise_view({"bbox": [1, 1, 0, 2]}), lambda: D.normalise_view({"zoom": 99})):
        with pytest.raises(LayerError):
            bad()
    f = D.Flags()
    f.add("few_points", "warning", "there are few points", n=3)
    assert f.frame(spark).first().details == {"n": "3"} and D.caption({"title": "A", "date": 2024}) == "A · 2024"


def test_lineage_goes_to_its_end(spark):
    chain = [(i, i + 1) for i in range(20)] + [(20, 4), (0, 5)]
    got = {r.id: r.depth for r in registry.lineage_depth(spark.createDataFrame(chain, "input long, output long"), spark.range(1)).collect()}
    assert got == {i: i if i < 5 else i - 4 for i in range(21)}


def test_union_erases_by_all_boxes_of_the_other_layer(spark):
    r = np.random.default_rng(11)
    lo, side = r.integers(0, 24, (2, 15, 2)), r.integers(1, 9, (2, 15, 2))
    sets = [[(i, *map(float, (*a, *(a + w)))) for i, (a, w) in enumerate(zip(lo[k], side[k]))] for k in (0, 1)]
    sets[0].append((99, *sets[0][0][1:]))
    left, right = (spark.createDataFrame(b, f"{n} long, xmin double, ymin double, xmax double, ymax double") for n, b in zip("lr", sets))
    area, want = F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), {}

    def raster(b):
        m = np.zeros((40, 40), bool)
        m[int(b[1]) : int(b[3]), int(b[2]) : int(b[4])] = True
        return m

    cover = [np.any([raster(b) for b in s], axis=0) for s in sets]
    for k, part in ((0, "left"), (1, "right")):
        want |= {(part, b[0] if k == 0 else None, b[0] if k else None): int((raster(b) & ~cover[1 - k]).sum()) for b in sets[k]}
    want |= {("both", a[0], b[0]): int((raster(a) & raster(b)).sum()) for a in sets[0] for b in sets[1]}
    for cell in (None, 3.0):
        got = {(x.part, x.l, x.r): x.a for x in spatial.union_layers(left, right, cell=cell).groupBy("part", "l", "r").agg(area.alias("a")).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_trends_take_all_rows(spark, tmp_path, monkeypatch):
    from lithoframe.operators import trend
    from lithoframe.plans import edit_queries

    k = F.col("id")
    spark.range(1, 701).select(k.alias("p_partkey"), (k % 50 + 1).cast("int").alias("p_size"), (k * k / 7.0 + k % 50).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    i = np.arange(1, 701)
    b1, b0 = np.polyfit(i % 50 + 1, i * i / 7.0 + i % 50, 1)
    got = {r.name: r.value for r in edit_queries._trend(spark, str(tmp_path)).collect()}
    assert abs(got["b0"] - b0) < 1e-3 and abs(got["b1"] - b1) < 1e-3
    spark.range(1, 301).select(k.alias("c_custkey"), (k * 1.0).alias("c_acctbal"), (k % 25).cast("int").alias("c_nationkey"), F.lit("A").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    met = []
    monkeypatch.setattr(trend, "fit_reml", lambda xy, r, design, start, rounds: met.append((len(xy), len(r), len(design), r[0])) or start)
    edit_queries._reml(spark, str(tmp_path))
    assert met == [(300, 300, 300, 1.0 - 150.5)]


def test_every_line_is_densified(spark, sf_dir):
    from lithoframe import catalog

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").toPandas().sort_values(["o_custkey", "o_orderkey"])
    want = {}
    for line, keys in o.groupby("o_custkey")["o_orderkey"]:
        y = keys.to_numpy() % 37 * 10.0
        length = np.hypot(100.0, np.diff(y)).sum()
        if length > 0:
            want[line] = math.ceil(length / 75.0)
    got = {r.line_id: r["count"] for r in catalog.queries()["densify_line"](spark, sf_dir).groupBy("line_id").count().collect()}
    assert got == want


def test_every_event_is_a_job(spark, sf_dir):
    from lithoframe import catalog

    e = table(spark, sf_dir, "events").toPandas().sort_values("event_id")
    e["key"] = e["user_id"].astype(str) + "/" + e["ts"].dt.strftime("%Y-%m-%d")
    known = set(e.key[e.event_type != "error"])
    want = e[(e.event_type == "error") & ~e.key.isin(known)].groupby("key").event_id.min().to_dict()
    got = {r.key: r.id for r in catalog.queries()["job_enqueue"](spark, sf_dir).collect()}
    assert got == want and max(got.values()) > 900


def test_minimum_curvature_reaches_its_tolerance_or_says_so():
    r = np.random.default_rng(3)
    at = r.uniform(0, 79, (60, 2))
    z = 3.0 + 0.5 * at[:, 0] - 0.25 * at[:, 1]
    s, _ = solvers.minimum_curvature_array(80, 80, at, z)
    plane = 3.0 + 0.5 * np.arange(80)[None, :] - 0.25 * np.arange(80)[:, None]
    assert np.abs(s - plane).max() < 0.05
    wall = {(row, 39, "e") for row in range(80)}
    own = at[(at[:, 0] < 39) | (at[:, 0] > 40)]  # a control between two nodes that a wall parts would draw on both
    cut, _ = solvers.minimum_curvature_array(80, 80, own, np.where(own[:, 0] < 39.5, 0.0, 10.0), blocked=wall, tolerance=1e-8)
    assert np.abs(cut[:, :40]).max() < 0.1 and np.abs(cut[:, 40:] - 10).max() < 0.1
    with pytest.raises(LayerError):
        solvers.minimum_curvature_array(80, 80, at, np.sin(at[:, 0]), iterations=2)


def test_points_in_many_masks_go_by_cells(spark):
    from lithoframe.operators import spatial

    pts = spark.createDataFrame([(i, float(i % 30), float(i // 30)) for i in range(900)], "id long, x double, y double")
    boxes = spark.createDataFrame([(float(3 * i), 4.0, 3.0 * i + 1, 9.0) for i in range(10)], "xmin double, ymin double, xmax double, ymax double")
    want = sorted(i for i in range(900) if not (i % 3 <= 1 and 4 <= i // 30 <= 9))
    for cell in (None, 2.0):
        assert sorted(r.id for r in spatial.erase_points(pts, boxes, cell=cell).collect()) == want


def test_variogram_sums_equal_all_pairs(spark):
    from lithoframe.operators import variogram

    r = np.random.default_rng(9)
    x, y, v = r.uniform(0, 100, 2300), r.uniform(0, 60, 2300), r.normal(size=2300)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v))], "id long, x double, y double, v double")
    i, j = np.triu_indices(2300, 1)
    h, d = np.hypot(x[i] - x[j], y[i] - y[j]), (v[i] - v[j]) ** 2
    turn = np.mod(np.degrees(np.arctan2(x[i] - x[j], y[i] - y[j])) - 30, 180)
    for azimuth, near in ((None, h < 25), (30.0, (h < 25) & (np.minimum(turn, 180 - turn) <= 22.5))):
        got = {g.lag_bin: g for g in variogram.experimental(df, lags=5, max_lag=25.0, azimuth=azimuth).collect()}
        for b in range(5):
            own = near & (np.floor(h / 5) == b)
            assert got[b].n_pairs == own.sum() and abs(got[b].lag - h[own].mean()) < 1e-9 and abs(got[b].gamma - d[own].mean() / 2) < 1e-9


def test_variogram_takes_every_point(spark):
    """More points than the old sample of 20,000, of which half lie in one corner, so that their tile is dealt to several blocks."""
    from lithoframe.operators import variogram

    r = np.random.default_rng(10)
    n = 24_000
    x, y, v = r.integers(0, 1000, n) * 1.0, r.integers(0, 1000, n) * 1.0, r.normal(size=n)
    x[::2], y[::2] = x[::2] / 10, y[::2] / 10
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "v": v}))
    count, far, d2 = np.zeros(3, int), np.zeros(3), np.zeros(3)
    for i in range(0, n, 500):
        h = np.hypot(np.subtract.outer(x[i : i + 500], x), np.subtract.outer(y[i : i + 500], y))
        keep = (h < 9) & (np.arange(n) > np.arange(i, i + len(h))[:, None])
        at, d = np.floor(h[keep] / 3).astype(int), np.subtract.outer(v[i : i + 500], v)[keep]
        count, far, d2 = count + np.bincount(at, minlength=3), far + np.bincount(at, h[keep], 3), d2 + np.bincount(at, d * d, 3)
    got = {g.lag_bin: g for g in variogram.experimental(df, lags=3, max_lag=9.0).collect()}
    assert [got[b].n_pairs for b in range(3)] == list(count)
    assert all(abs(got[b].lag - far[b] / count[b]) < 1e-9 and abs(got[b].gamma - d2[b] / count[b] / 2) < 1e-9 for b in range(3))


def test_voronoi_of_clusters_equals_half_planes(spark):
    """Clusters with empty ground between them, a place held twice, and points outside the window; each cell against all others."""
    r = np.random.default_rng(12)
    xy = np.concatenate([r.normal((c * 400, c % 2 * 300), 5, (350, 2)) for c in range(5)] + [r.uniform(-200, 1800, (40, 2)), np.array([[700.0, 50.0], [700.0, 50.0]])])
    window = np.array([[-100.0, -100.0], [1600.0, -100.0], [1600.0, 500.0], [-100.0, 500.0], [-100.0, -100.0]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    for at in (window, None):
        got = {g.id: polygons.area(np.asarray(wkb.decode(bytes(g.geometry))[1][0])) for g in polygons.voronoi(df, at).collect()}
        assert not {len(xy) - 1, len(xy) - 2} & set(got)
        lo, hi = xy.min(axis=0), xy.max(axis=0)
        pad = 0.1 * (hi - lo).max()
        box = at if at is not None else np.array([lo - pad, [hi[0] + pad, lo[1] - pad], hi + pad, [lo[0] - pad, hi[1] + pad], lo - pad])
        for i in [*range(0, len(xy) - 2, 37), *range(1750, 1790)]:
            ring, m, c = box[None, :-1], np.array([4]), xy[i]
            for q in xy[np.argsort(np.hypot(*(xy - c).T), kind="stable")[1:]]:
                ring, m = polygons._clip_many(ring, m, (c + q)[None] / 2, (q - c)[None])
            want = polygons.area(np.concatenate((ring[0, : m[0]], ring[0, :1]))) if m[0] else 0.0
            assert abs(got.get(i, 0.0) - want) <= 1e-6 * max(want, 1)
        if at is None:
            assert sum(got.values()) < abs(polygons.area(box)) * (1 + 1e-9)


def test_voronoi_takes_more_points_than_one_task(spark, monkeypatch):
    monkeypatch.setattr(polygons, "POINTS_MAX", 100)
    df = spark.range(2500).selectExpr("id", "double(id % 50) + 0.001 * (id * 7919 % 97) AS x", "double(floor(id / 50)) + 0.001 * (id * 104729 % 89) AS y")
    got = [polygons.area(np.asarray(wkb.decode(bytes(g.geometry))[1][0])) for g in polygons.voronoi(df).collect()]
    w, h, *lo = df.selectExpr("max(x)-min(x)", "max(y)-min(y)").first()
    pad = 0.1 * max(w, h)
    assert len(got) == 2500 and min(got) > 0 and sum(got) == pytest.approx((w + 2 * pad) * (h + 2 * pad), rel=1e-9)
