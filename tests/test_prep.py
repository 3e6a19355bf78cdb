"""Control validation and the anisotropy test on planted fields."""

import numpy as np
import pandas as pd
import pytest

from lithoframe.errors import LayerError
from lithoframe.operators import prep, variogram


def table(spark, x, y, v, **more):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": x, "y": y, "v": v, **more}))


def plain_clusters(xy, tolerance):
    label = list(range(len(xy)))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= tolerance
    for _ in range(len(xy)):
        new = [min(label[j] for j in np.flatnonzero(d[i])) for i in range(len(xy))]
        if new == label:
            break
        label = new
    return label


@pytest.mark.parametrize("seed,tolerance", [(1, 0.5), (2, 1.5), (3, 3.0)])
def test_clusters_are_chains_of_near_places(spark, seed, tolerance):
    r = np.random.default_rng(seed)
    xy = np.concatenate((r.uniform(-20, 20, (150, 2)), r.integers(-6, 6, (150, 2)) * 1.5, np.zeros((40, 2))))
    got = {p.id: p.cluster for p in prep.clusters(table(spark, *xy.T, xy[:, 0]), tolerance).collect()}
    want = plain_clusters(xy, tolerance)
    groups = lambda labels: sorted(sorted(i for i in range(len(xy)) if labels[i] == k) for k in set(labels))
    assert groups([got[i] for i in range(len(xy))]) == groups(want)


def test_validate_drops_merges_and_refuses(spark):
    r = np.random.default_rng(4)
    xy = r.uniform(0, 100, (60, 2))
    x, y = np.concatenate((xy[:, 0], xy[:5, 0] + 0.01, [1.0, np.nan, 3.0])), np.concatenate((xy[:, 1], xy[:5, 1], [1.0, 2.0, 3.0]))
    v = np.concatenate((xy[:, 0], xy[:5, 0] + 2, [np.nan, 1.0, np.inf]))
    df = table(spark, x, y, v, k=np.where(np.arange(len(x)) == 7, np.nan, 1.0))
    got, flags = prep.validate(df, tolerance=0.05)
    assert flags == [prep.Flag("ROWS_DROPPED", 3), prep.Flag("DUPLICATES_RESOLVED", 5, 0.05)] and got.count() == 60
    assert {round(p.v - p.x, 3) for p in got.where("n > 1").collect()} == {0.995}
    first, _ = prep.validate(df, tolerance=0.05, duplicates="first")
    assert sorted(p.id for p in first.collect()) == list(range(60)) and first.columns == df.columns
    assert prep.validate(df, tolerance=0.05, covariates=("k",))[0].count() == 59
    for bad in (dict(duplicates="error", tolerance=0.05), dict(duplicates="middle"), dict(least=61, tolerance=0.05)):
        with pytest.raises(LayerError):
            prep.validate(df, **bad)
    line = table(spark, np.arange(50) * 0.1 + 1e6, np.arange(50) * 0.3 - 7e5, np.arange(50.0))
    flat = table(spark, xy[:, 0], xy[:, 1], np.ones(60))
    for df in (line, flat, line.where("id < 0")):
        with pytest.raises(LayerError):
            prep.validate(df)
    bent = table(spark, np.arange(50) * 0.1 + 1e6, np.arange(50) * 0.3 - 7e5 + (np.arange(50) == 3) * 0.01, np.arange(50.0))
    assert prep.validate(bent, tolerance=0.0)[0].count() == 50


def test_default_tolerance(spark):
    x, y = (a.ravel() * 10.0 for a in np.meshgrid(np.arange(8), np.arange(8)))
    assert prep.default_dedup_tolerance(table(spark, np.append(x, x[:9]), np.append(y, y[:9]), np.append(y, y[:9]))) == pytest.approx(5.0)
    assert prep.default_dedup_tolerance(table(spark, [1.0, 1.0], [2.0, 2.0], [0.0, 1.0])) == 0.0 == prep.default_dedup_tolerance(table(spark, [1.0], [2.0], [0.0]))


def field(seed, stretch, azimuth, n=500):
    """A smooth field with long waves along the azimuth and short ones across."""
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 1000, (n, 2))
    a = np.radians(azimuth)
    along, across = xy @ [np.sin(a), np.cos(a)], xy @ [np.cos(a), -np.sin(a)]
    v = sum(np.cos(along * u / stretch + across * w + p) for u, w, p in zip(r.normal(0, 0.012, 60), r.normal(0, 0.012, 60), r.uniform(0, 7, 60)))
    return xy[:, 0], xy[:, 1], v


@pytest.mark.parametrize("azimuth", [45.0, 135.0])
def test_a_planted_azimuth_is_found(spark, azimuth):
    got = variogram.anisotropy_test(table(spark, *field(3, 5.0, azimuth)), max_lag=400.0)
    assert got.use and got.p_value == 0.01 and got.ratio > 1.8
    assert min(abs(got.azimuth - azimuth), 180 - abs(got.azimuth - azimuth)) <= 22.5


def test_fields_without_direction_seldom_pass(spark):
    r = np.random.default_rng(8)
    ps = [variogram.anisotropy_test(table(spark, *r.uniform(0, 1000, (2, 250)), r.normal(size=250)), max_lag=400.0, shuffles=39, seed=k).p_value for k in range(6)]
    assert sum(p <= 0.05 for p in ps) <= 1 and max(ps) > 0.3
    few = variogram.anisotropy_test(table(spark, *r.uniform(0, 1000, (2, 12)), r.normal(size=12)), shuffles=5)
    assert few.p_value == 1.0 and not few.use
