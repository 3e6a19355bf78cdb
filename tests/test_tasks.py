"""Jobs from the control to a contour map: what they write, what they note, and how they end."""

import json

import numpy as np
import pandas as pd
import pytest

from lithoframe.errors import LayerError
from lithoframe.functions import wkb
from lithoframe.operators import ledger as L
from lithoframe.operators.tasks import Tasks, levels_for


@pytest.fixture
def tasks(spark, tmp_path):
    return Tasks(spark, L.Ledger(spark, f"file://{tmp_path}/ledger"), f"file://{tmp_path}/data")


def control(spark):
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 1000, (2, 120))
    return spark.createDataFrame(pd.DataFrame({"id": range(120), "x": x, "y": y, "z": x / 10 + y / 20}))


def done(tasks, actor, operation, inputs, **p):
    job = tasks.run(tasks.submit(actor, operation, inputs, **p).id)
    assert job.fields["state"] == "succeeded", job.fields
    return job.fields


def test_from_control_to_bands(spark, tasks):
    c = tasks.register("ann", "tops", control(spark), 32614)
    grid = done(tasks, "ann", "interpolate", [c.id], method="idw", value="z", size=50.0, name="top of sand")["output_id"]
    about = tasks.describe(grid, "ann")
    assert about["data_kind"] == "grid" and about["grid"]["affine"][0] == 50.0 and about["method"] == "idw" and about["bounds"][0] < 0 < 1000 < about["bounds"][2]
    lines = done(tasks, "ann", "contour", [grid], interval=20.0)
    assert json.loads(lines["result"])["levels"] == [20.0 * k for k in range(1, len(json.loads(lines["result"])["levels"]) + 1)]
    drawn = tasks.read(lines["output_id"], "ann")
    assert set(drawn.columns) == {"value", "is_index", "length", "geometry"} and drawn.count() >= 3
    bands = done(tasks, "ann", "bands", [grid], levels=[40.0, 80.0], min_area=0.0)
    area = tasks.read(bands["output_id"], "ann").agg({"area": "sum"}).first()[0]
    g = about["grid"]
    assert area == pytest.approx((g["nx"] - 1) * (g["ny"] - 1) * 2500.0)
    square = np.array([[200, 200], [700, 200], [700, 700], [200, 700], [200, 200]], float)
    mask = tasks.register("ann", "lease", spark.createDataFrame([(1, bytearray(wkb.encode("Polygon", [square])))], "id long, geometry binary"), 32614)
    cut = done(tasks, "ann", "clip_grid", [grid, mask.id])
    assert 0.5 < json.loads(cut["result"])["clipped_fraction"] < 0.9 and tasks.read(cut["output_id"], "ann").count() == 100
    anchor = tasks.read(done(tasks, "ann", "label_anchors", [mask.id])["output_id"], "ann").first()
    assert (anchor.x, anchor.y) == (450.0, 450.0)
    hull = tasks.read(done(tasks, "ann", "aggregate", [mask.id], op="convex_hull")["output_id"], "ann")
    assert hull.count() == 1
    line = tasks.ledger.state("lineage").where(f"fields['output_id'] = '{grid}'").first()
    assert line.fields["operation"] == "interpolate" and json.loads(line.fields["inputs"]) == [{"id": c.id, "version": 1}]
    assert [r.fields["name"] for r in tasks.search("top of", "ann").collect()][0] == "top of sand" and tasks.search("top", "bob").count() == 0


def test_variograms_give_a_result_and_no_dataset(spark, tasks):
    c = tasks.register("ann", "tops", control(spark), 32614)
    f = done(tasks, "ann", "fit_variogram", [c.id], value="z", max_lag=400.0, test_direction=True)
    out = json.loads(f["result"])
    assert out["range"] > 0 and 0 < out["p_value"] <= 1 and "output_id" not in f and tasks.ledger.state("dataset").count() == 1


def test_submitting_twice_refusals_and_failures(spark, tasks):
    c = tasks.register("ann", "tops", control(spark), 32614)
    one, two = (tasks.submit("ann", "interpolate", [c.id], method="idw", value="z", size=100.0) for _ in range(2))
    assert one.id == two.id and tasks.submit("ann", "interpolate", [c.id], method="idw", value="z", size=200.0).id != one.id
    with pytest.raises(L.Refused):
        tasks.submit("bob", "interpolate", [c.id], method="idw")
    for bad in (lambda: tasks.submit("ann", "paint", [c.id]), lambda: tasks.submit("ann", "interpolate", [c.id]), lambda: tasks.submit("ann", "clip_grid", [c.id]), lambda: tasks.submit("ann", "contour", ["none"])):
        with pytest.raises(LayerError):
            bad()
    failed = tasks.run(tasks.submit("ann", "contour", [c.id]).id)
    assert failed.fields["state"] == "failed" and failed.fields["error_kind"] == "input" and "no grid" in failed.fields["error"]
    tasks.ledger.request_cancel(one.id, "ann")
    with pytest.raises(LayerError):
        tasks.ledger.step(one.id, "w", "running")
    late = tasks.submit("ann", "interpolate", [c.id], method="nearest", value="z", size=100.0)
    tasks.ledger.report_progress(late.id, "w", 0.0)
    tasks.ledger.request_cancel(late.id, "ann")
    assert tasks.run(late.id).fields["state"] == "cancelled" and tasks.ledger.state("dataset").count() == 1


def test_levels(spark):
    s = spark.createDataFrame([(0.5,), (9.5,), (None,)], "value double")
    assert levels_for(s, [3, 1]) == [1.0, 3.0] and levels_for(s, interval=2.5) == [2.5, 5.0, 7.5] and levels_for(s, target=4) == [2.5, 5.0, 7.5]
    for bad in (lambda: levels_for(s, interval=50.0), lambda: levels_for(s, interval=1e-9), lambda: levels_for(s.where("value > 99"))):
        with pytest.raises(LayerError):
            bad()
