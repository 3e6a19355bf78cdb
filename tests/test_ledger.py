"""The registry's writes: what is refused, what is kept, and who wins a race."""

import random
import threading
from datetime import UTC, datetime, timedelta

import pytest

from lithoframe.errors import LayerError
from lithoframe.operators import ledger as L


@pytest.fixture
def book(spark, tmp_path):
    at = [datetime(2024, 1, 1, tzinfo=UTC)]

    def clock():
        at[0] += timedelta(seconds=1)
        return at[0]

    return L.Ledger(spark, f"file://{tmp_path}/ledger", clock)


def test_fold_equals_replaying(spark):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        state, dead = {}, False
        for v in range(1, r.randint(2, 9)):
            op = "create" if v == 1 else r.choice(["update", "update", "delete"])
            fields = {f"f{r.randrange(3)}": r.choice(["a", "b", None]) for _ in range(2)} if op != "delete" else {}
            rows.append(("dataset", f"d{k}", v, datetime(2024, 1, v), f"u{k % 4 + v}", op, fields))
            if not dead and op == "delete":
                dead = True
            elif not dead:
                state |= fields
        want[f"d{k}"] = (f"u{k % 4 + 1}", v, dead, {a: b for a, b in state.items() if b is not None})
    entries = spark.createDataFrame(rows + rows[:5], L.ENTRY).repartition(3)
    assert {x.id: (x.owner, x.version, x.deleted, x.fields) for x in L.fold(entries).collect()} == want
    assert L.fold(spark.createDataFrame([], L.ENTRY)).count() == 0


def test_datasets_projects_and_who_may(book):
    p = book.create_project("ann", "delta", "Delta", 32614, vertical_unit="ft")
    assert p.fields["unit"] == "m"
    for bad in (lambda: book.create_project("bob", "delta", "Again", 32614), lambda: book.create_project("bob", "geo", "Geo", 4326), lambda: book.create("dataset", "ann", {"name": "x"}), lambda: book.create("thing", "ann", {})):
        with pytest.raises(LayerError):
            bad()
    d = book.create("dataset", "ann", {"name": "tops", "data_kind": "points", "srid": 32614, "project_id": p.id, "object_key": "k/1"})
    assert book.resolve(d.id, "ann") == ("k/1", 1)
    for act in (lambda: book.resolve(d.id, "bob"), lambda: book.update("dataset", d.id, "bob", {"name": "mine"}), lambda: book.grant("bob", "dataset", d.id, "bob", "owner"), lambda: book.publish(d.id, "ann", "org"), lambda: book.publish(d.id, "ann", "team-9")):
        with pytest.raises(L.Refused):
            act()
    g = book.grant("ann", "dataset", d.id, "bob", "editor")
    with pytest.raises(LayerError):
        book.grant("ann", "dataset", d.id, "bob", "viewer")
    assert [(x.grantee, x.role) for x in book.grants("dataset", d.id).collect()] == [("bob", "editor")]
    two = book.update("dataset", d.id, "bob", {"name": "tops 2", "object_key": "k/2"})
    assert (two.version, book.resolve(d.id, "bob"), two.owner) == (2, ("k/2", 2), "ann")
    with pytest.raises(L.Stale):
        book.update("dataset", d.id, "ann", {"name": "old"}, seen=1)
    book.revoke("ann", g.id)
    with pytest.raises(L.Refused):
        book.update("dataset", d.id, "bob", {"name": "no"})
    book.publish(d.id, "ann", "org", may_publish=True)
    assert book.resolve(d.id, "carl")[0] == "k/2"
    assert [x.name for x in book.listed("dataset").collect()] == ["tops 2"] and book.delete_project(p.id, "ann") == 1
    book.delete("dataset", d.id, "ann")
    with pytest.raises(LayerError):
        book.get("dataset", d.id)
    assert book.state("dataset").count() == 0 and book.state("dataset", deleted=True).count() == 1
    assert [(x.op, x.actor) for x in book.history("dataset", d.id).collect()] == [("create", "ann"), ("update", "bob"), ("update", "ann"), ("delete", "ann")]


def test_layers_and_basemaps(book):
    one, two = (book.create("layer", "ann", {"name": n, "dataset_id": "d"}) for n in ("a", "b"))
    copy = book.duplicate_layer(one.id, "ann")
    assert copy.fields["name"] == "a (copy)" and copy.fields["dataset_id"] == "d"
    b = book.create_basemap("ann", "base", [one.id, two.id])
    saved = book.save_map_as_basemap("ann", "saved", [one.id, copy.id], active=one.id)
    assert sorted((x.position, x.layer_id) for x in book.basemap_layers().where(f"basemap_id = '{b.id}'").collect()) == [(0, one.id), (1, two.id)]
    assert [x.layer_id for x in book.basemap_layers().where(f"basemap_id = '{saved.id}'").collect()] == [copy.id]
    for ids in ([], [one.id, one.id], [one.id, "nowhere"]):
        with pytest.raises(LayerError):
            book.create_basemap("ann", "bad", ids)
    with pytest.raises(LayerError):
        book.delete("layer", one.id, "ann")
    book.set_basemap_layers(b.id, "ann", [two.id])
    assert book.delete("layer", one.id, "ann").deleted


def test_jobs_go_forward_only(book):
    job = book.create("job", "ann", {"operation": "contour"})
    phases = L.Phases(book, job.id, "worker", {"read": 1, "trace": 3})
    assert float(phases.report("trace", 0.5).fields["fraction"]) == 0.625
    assert float(phases.report("read", 0.5).fields["fraction"]) == 0.625  # never back
    book.request_cancel(job.id, "ann")
    with pytest.raises(L.Refused):
        phases.report("trace", 0.9)
    assert book.step(job.id, "worker", "cancelled").fields["state"] == "cancelled"
    for act in (lambda: book.mark_failed(job.id, "worker", "late"), lambda: book.request_cancel(job.id, "ann")):
        with pytest.raises(LayerError):
            act()
    waits = book.create("job", "ann", {"operation": "clip"})
    assert book.request_cancel(waits.id, "ann").fields["state"] == "cancelled"
    fails = book.create("job", "ann", {"operation": "clip"})
    book.report_progress(fails.id, "worker", 0.1)
    assert book.mark_failed(fails.id, "worker", "no control", "input").fields["error_kind"] == "input"


def test_preferences_states_and_lineage(book):
    book.prefer("org", basemap="b1")
    book.prefer("ann", basemap="b2", units="ft")
    book.prefer("ann", basemap=None)
    assert book.preferences("ann", "t1") == {"org": {"basemap": "b1"}, "teams": {"t1": {}}, "user": {"units": "ft"}}
    d = book.create("dataset", "ann", {"name": "n", "data_kind": "grid", "srid": 3857})
    assert "synced_at" in book.mark_state(d.id, "ann", "ready", synced=True).fields
    line = book.record_lineage("ann", "out", "contour", [d.id, "gone"], interval=10)
    assert line.fields["inputs"] == f'[{{"id": "{d.id}", "version": 2}}, {{"id": "gone", "version": null}}]' and line.fields["parameters"] == '{"interval": 10}'


def test_of_several_writers_one_wins(book):
    d = book.create("dataset", "ann", {"name": "n", "data_kind": "grid", "srid": 3857})
    won, gate = [], threading.Barrier(4)

    def write(k):
        gate.wait()
        try:
            book.update("dataset", d.id, "ann", {"name": f"w{k}"}, seen=1)
            won.append(k)
        except L.Stale:
            pass

    ts = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert len(won) == 1 and book.get("dataset", d.id).fields["name"] == f"w{won[0]}"
