"""Overlay of polygons: area identities, membership of random places, and layers against pairwise areas."""

import numpy as np
import pytest

from lithoframe.functions import wkb
from lithoframe.operators import overlay as O
from lithoframe.operators.polygons import area

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)


def size(made):
    return 0.0 if made is None else sum(area(r) for r in O.rings_of(*made))


def within(rings, x, y):
    return sum(O._around(r, x, y) for r in rings) % 2 == 1


def star(r, points, at=(0.0, 0.0)):
    t = np.sort(r.uniform(0, 2 * np.pi, points))
    while np.diff(t, append=t[0] + 2 * np.pi).max() >= np.pi:  # else sides may cross
        t = np.sort(r.uniform(0, 2 * np.pi, points))
    d = r.uniform(2, 10, points)
    p = np.stack([at[0] + d * np.cos(t), at[1] + d * np.sin(t)], 1)
    return np.concatenate((p, p[:1]))


def test_squares_holes_and_touching_corners():
    half, hole = SQUARE + [5, 0], SQUARE[::-1] / 2 + 2
    assert size(O.overlay([[SQUARE], [half]], O.both)) == 50 and size(O.overlay([[SQUARE], [half]], O.any_of)) == 150
    kind, rings = O.overlay([[SQUARE], [hole]], O.first_only)
    assert kind == "Polygon" and len(rings) == 2 and area(rings[1]) == -25
    assert O.overlay([[SQUARE], [SQUARE + [10, 0]]], O.both) is None and O.overlay([[SQUARE], [SQUARE]], O.first_only) is None
    kind, rings = O.overlay([[SQUARE], [SQUARE + [10, 0]]], O.any_of)
    assert kind == "Polygon" and len(rings[0]) == 5
    kind, parts = O.overlay([[SQUARE], [SQUARE + 10]], O.any_of)
    assert kind == "MultiPolygon" and [len(p[0]) for p in parts] == [5, 5]
    assert size(O.overlay([[SQUARE + 1e6], [half + 1e6]], O.both)) == pytest.approx(50)
    assert O.overlay([[]], O.any_of) is None


@pytest.mark.parametrize("seed", range(30))
def test_areas_add_up_and_places_agree(seed):
    r = np.random.default_rng(seed)
    a, b = [star(r, int(r.integers(3, 40)))], [star(r, int(r.integers(3, 40)), r.uniform(-6, 6, 2))]
    if seed % 3 == 0:
        a.append(a[0][::-1] * 0.2)
        b = [np.round(x) for x in b]
    made = {n: O.overlay([a, b], k) for n, k in (("and", O.both), ("or", O.any_of), ("not", O.first_only))}
    whole = size(O.overlay([a], O.any_of))
    assert size(made["and"]) + size(made["not"]) == pytest.approx(whole, abs=1e-8)
    assert size(made["or"]) == pytest.approx(whole + size(O.overlay([b], O.any_of)) - size(made["and"]), abs=1e-8)
    rings = {n: O.rings_of(*m) if m else [] for n, m in made.items()}
    for x, y in r.uniform(-16, 16, (300, 2)):
        p, q = within(a, x, y), within(b, x, y)
        assert (within(rings["and"], x, y), within(rings["or"], x, y), within(rings["not"], x, y)) == (p and q, p or q, p and not q)


def test_layers(spark):
    r = np.random.default_rng(8)
    shapes = {s: [star(r, 9, r.uniform(0, 60, 2)) for _ in range(25)] for s in "lr"}
    layer = lambda s: spark.createDataFrame([(i, i % 3, bytearray(wkb.encode("Polygon", [p]))) for i, p in enumerate(shapes[s])] + [(99, 0, None)], "id long, g int, geometry binary")
    read = lambda g: size(wkb.decode(bytes(g)))
    got = {(x.id, x.right_id): read(x.geometry) for x in O.intersect_polygons(layer("l"), layer("r")).collect()}
    want = {(i, j): size(O.overlay([[p], [q]], O.both)) for i, p in enumerate(shapes["l"]) for j, q in enumerate(shapes["r"])}
    assert got == pytest.approx({k: v for k, v in want.items() if v})
    left = {x.id: read(x.geometry) for x in O.erase_polygons(layer("l"), layer("r")).collect()}
    assert left == pytest.approx({i: v for i, p in enumerate(shapes["l"]) if (v := size(O.overlay([[p], *([q] for q in shapes["r"])], O.first_only)))})
    united = {x.g: read(x.geometry) for x in O.dissolve_polygons(layer("l"), "g").collect()}
    assert united == pytest.approx({g: size(O.overlay([[p] for p in shapes["l"][g::3]], O.any_of)) for g in range(3)})
    mask = wkb.encode("Polygon", [SQUARE * 3])
    inside, outside = ({x.id: read(x.geometry) for x in O.clip_polygons(layer("l"), mask, inv).collect()} for inv in (False, True))
    assert all(inside.get(i, 0) + outside.get(i, 0) == pytest.approx(area(p)) for i, p in enumerate(shapes["l"]))


def test_repeated_and_null_keys_are_cut_each(spark):
    layer = lambda rows: spark.createDataFrame([(i, bytearray(wkb.encode("Polygon", [p]))) for i, p in rows], "id long, geometry binary")
    left, mask = layer([(None, SQUARE), (1, SQUARE + [100, 0]), (1, SQUARE + [200, 0])]), layer([(7, SQUARE + 5), (7, SQUARE + [205, 0])])
    got = sorted((str(r.id), size(wkb.decode(bytes(r.geometry)))) for r in O.erase_polygons(left, mask).collect())
    assert got == [("1", 50.0), ("1", 100.0), ("None", 75.0)]
    got = sorted((str(r.id), size(wkb.decode(bytes(r.geometry)))) for r in O.clip_layer(left, mask).collect())
    assert got == [("1", 50.0), ("None", 25.0)]


def test_union_of_layers_and_the_catalogue(spark):
    from lithoframe.operators.aggregate import aggregate

    r = np.random.default_rng(3)
    shapes = {s: [star(r, 9, r.uniform(0, 40, 2)) for _ in range(8)] for s in "lr"}
    layer = lambda s: spark.createDataFrame([(i, i % 2 if i else None, bytearray(wkb.encode("Polygon", [p]))) for i, p in enumerate(shapes[s])], "id long, g int, geometry binary")
    read = lambda g: size(wkb.decode(bytes(g)))
    out = aggregate("union", [layer("l"), layer("r")]).collect()
    inter = sum(size(O.overlay([[p], [q]], O.both)) for p in shapes["l"] for q in shapes["r"])
    only = sum(size(O.overlay([[p], *([q] for q in shapes[b])], O.first_only)) for a, b in ("lr", "rl") for p in shapes[a])
    assert sum(read(x.geometry) for x in out) == pytest.approx(inter + only)
    assert {(x.id is None, x.right_id is None) for x in out} == {(False, False), (False, True), (True, False)}
    united = {x.g: read(x.geometry) for x in aggregate("dissolve", [layer("l")], by="g").collect()}
    assert united[None] == pytest.approx(area(shapes["l"][0])) and set(united) == {None, 0, 1}
    erased = sum(read(x.geometry) for x in aggregate("erase", [layer("l"), layer("r")]).collect())
    clipped = sum(read(x.geometry) for x in aggregate("clip", [layer("l"), layer("r")]).collect())
    assert erased + clipped == pytest.approx(sum(area(p) for p in shapes["l"]))


def test_batches_and_strips_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(4)
    masks = [bytearray(wkb.encode("Polygon", [star(r, 7, r.uniform(-20, 20, 2))])) for _ in range(40)]
    big = wkb.encode("Polygon", [SQUARE * 4 - 20])
    read = lambda g: size(wkb.decode(bytes(g)))
    want = [read(O._against(big, masks, k)) for k in (O.first_only, O.inside_mask)]
    monkeypatch.setattr(O, "BATCH_EDGES", 20)
    assert [read(O._against(big, masks, k)) for k in (O.first_only, O.inside_mask)] == pytest.approx(want) and sum(want) == pytest.approx(1600)
    assert O._against(wkb.encode("Polygon", [SQUARE]), [wkb.encode("Polygon", [SQUARE * 2 - 1])], O.first_only) is None
    rows = spark.createDataFrame([(1, m) for m in masks * 12], "g int, geometry binary")
    (got,) = O.dissolve_polygons(rows, "g").collect()
    assert read(got.geometry) == pytest.approx(read(O._over(masks, O.any_of)))


@pytest.mark.parametrize("seed", range(20))
def test_convex_pairs_equal_the_kernel(seed):
    from lithoframe.operators.polygons import hull

    r = np.random.default_rng(seed)
    a, b = (hull(r.uniform(-5, 5, (12, 2)) + r.uniform(-6, 6, 2) * (seed % 3)) for _ in range(2))
    b = a * 0.5 if seed == 5 else a + [10, 0] if seed == 6 else a if seed == 7 else b
    p, q = (wkb.encode("Polygon", [x]) for x in (a, b))
    got = O._common(p, q)
    assert (0.0 if got is None else size(wkb.decode(got))) == pytest.approx(size(O.overlay([[a], [b]], O.both)), abs=1e-9)
