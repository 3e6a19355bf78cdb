"""The registry's writes: datasets, projects, layers, basemaps, grants, jobs and the rest as a ledger of entries, and their state as a
fold over it.

An entry is a file of its own, named by kind, id and version, which only one writer can create; so a change is made on the version
its author has seen, or refused. Nothing is ever overwritten: what was, who changed it and when stays to be read. State is an aggregate
over all entries, one group for each object."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import LayerError, require
from ..functions.projections import axis_units
from ..scratch import create_once

ENTRY = "kind string, id string, version bigint, at timestamp, actor string, op string, fields map<string,string>"
#: What each kind needs to be made, and what of it must differ among the live objects of the kind.
KINDS = {
    "dataset": (("name", "data_kind", "srid"), ()), "project": (("slug", "name", "srid"), ("slug",)), "layer": (("name", "dataset_id"), ()), "basemap": (("name", "layer_ids"), ()),
    "session": (("name",), ()), "grant": (("object_kind", "object_id", "grantee", "role"), ("object_kind", "object_id", "grantee")), "palette": (("name",), ()), "render": (("image_key",), ()),
    "job": (("operation",), ()), "preference": ((), ()), "lineage": (("output_id", "operation"), ()),
}
ROLES, BASEMAP_LAYERS = ("viewer", "editor", "owner"), 30
#: States a job may go to from each.
JOB_STEPS = {"queued": ("running", "cancelled"), "running": ("running", "succeeded", "failed", "cancelled"), "succeeded": (), "failed": (), "cancelled": ()}


class Stale(LayerError):
    """Somebody else has changed the object since it was read."""


class Refused(LayerError):
    """The actor may not do this."""


def fold(entries: DataFrame) -> DataFrame:
    """(kind, id, owner, created_at, updated_at, version, deleted, fields) of ENTRY rows: each field's latest value, fields set to null
    left out. Entries after a deletion change nothing but are counted as versions; repeated entries are one."""
    e = entries.dropDuplicates(["kind", "id", "version"])
    head = e.groupBy("kind", "id").agg(
        F.min_by("actor", "version").alias("owner"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max("version").alias("version"),
        F.min(F.when(F.col("op") == "delete", F.col("version"))).alias("dead"),
    )
    each = e.select("kind", "id", "version", F.explode("fields").alias("key", "value")).join(head.select("kind", "id", "dead"), ["kind", "id"]).where("dead IS NULL OR version < dead")
    last = each.groupBy("kind", "id", "key").agg(F.max_by("value", "version").alias("value")).where("value IS NOT NULL")
    fields = last.groupBy("kind", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
    none = F.create_map().cast("map<string,string>")
    return head.join(fields, ["kind", "id"], "left").select("kind", "id", "owner", "created_at", "updated_at", "version", F.col("dead").isNotNull().alias("deleted"), F.coalesce("fields", none).alias("fields"))


def analysis_unit(srid: int) -> str:
    """The unit of a frame that may be worked in; geographic ones are refused, as distances in degrees mean nothing."""
    return axis_units(srid)


class Ledger:
    def __init__(self, spark: SparkSession, path: str, clock=lambda: datetime.now(UTC)):
        self.spark, self.path, self.clock = spark, path, clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    # reading

    def entries(self, kind: str | None = None, id: str | None = None) -> DataFrame:
        """The entries of all, of a kind, or of one object. Folders are by kind and id, so only what is asked for is listed."""
        where = "/".join([self.path, *([kind] if kind else []), *([id] if kind and id else [])])
        if not self._fs.exists(self._path(where)):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(where)

    def state(self, kind: str, deleted: bool = False) -> DataFrame:
        out = fold(self.entries(kind))
        return out if deleted else out.where("NOT deleted")

    def listed(self, kind: str, limit: int = 100, owner: str | None = None) -> DataFrame:
        """The live objects of a kind by name, then id."""
        out = self.state(kind)
        out = out if owner is None else out.where(F.col("owner") == owner)
        return out.withColumn("name", F.col("fields")["name"]).orderBy("name", "id").limit(limit)

    def get(self, kind: str, id: str) -> Row:
        row = fold(self.entries(kind, id)).where("NOT deleted").first()
        require(row is not None, f"there is no {kind} {id}")
        return row

    def history(self, kind: str, id: str) -> DataFrame:
        return self.entries(kind, id).orderBy("version")

    # writing

    def _add(self, kind: str, id: str, version: int, actor: str, op: str, fields: dict) -> Row:
        require(re.fullmatch(r"[A-Za-z0-9_.-]+", id) is not None, f"{id!r} is no id")
        fields = {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in fields.items()}
        entry = {"kind": kind, "id": id, "version": version, "at": self.clock().isoformat(), "actor": actor, "op": op, "fields": fields}
        folder = f"{self.path}/{kind}/{id}"
        self._fs.mkdirs(self._path(folder))
        if not create_once(self.spark, f"{folder}/{version:08d}.json", json.dumps(entry).encode()):
            raise Stale(f"{kind} {id} has a version {version} by somebody else; reload it and try again")
        return fold(self.entries(kind, id)).first()

    def create(self, kind: str, actor: str, fields: dict, id: str | None = None) -> Row:
        require(kind in KINDS, f"{kind!r} is not one of {', '.join(KINDS)}")
        needs, unique = KINDS[kind]
        missing = [n for n in needs if not fields.get(n)]
        require(not missing, f"a {kind} needs {', '.join(missing)}")
        if unique:
            same = self.state(kind)
            for n in unique:
                same = same.where(F.col("fields")[n] == str(fields[n]))
            require(same.isEmpty(), f"there is a {kind} with the same {' and '.join(unique)}")
        return self._add(kind, id or uuid.uuid4().hex, 1, actor, "create", fields)

    def update(self, kind: str, id: str, actor: str, fields: dict, seen: int | None = None) -> Row:
        """Sets fields, or with None takes them away; seen is the version that the author has read."""
        now = self.get(kind, id)
        self.may(actor, kind, id, "editor", now)
        return self._add(kind, id, (now["version"] if seen is None else seen) + 1, actor, "update", fields)

    def delete(self, kind: str, id: str, actor: str) -> Row:
        """A tombstone; readers pass the object over. A layer that a live basemap uses stays."""
        now = self.get(kind, id)
        self.may(actor, kind, id, "owner", now)
        if kind == "layer":
            used = self.basemaps_using(id).limit(3).collect()
            require(not used, f"layer {id} is used by {', '.join(b['fields'].get('name', b['id']) for b in used)}; take it out there first")
        return self._add(kind, id, now["version"] + 1, actor, "delete", {})

    def may(self, actor: str, kind: str, id: str, role: str, row: Row | None = None) -> None:
        """Refuses an actor who neither owns the object nor has a grant of the role or a stronger one."""
        row = row or self.get(kind, id)
        if actor == row["owner"]:
            return
        f = F.col("fields")
        held = self.state("grant").where((f["object_kind"] == kind) & (f["object_id"] == id) & (f["grantee"] == actor)).select(f["role"].alias("role")).collect()
        if not any(ROLES.index(h["role"]) >= ROLES.index(role) for h in held):
            raise Refused(f"{actor} may not act as {role} of {kind} {id}")

    # datasets and projects

    def create_project(self, actor: str, slug: str, name: str, srid: int, **more) -> Row:
        return self.create("project", actor, {"slug": slug, "name": name, "srid": srid, "unit": analysis_unit(srid), **more})

    def delete_project(self, id: str, actor: str) -> int:
        """Deletes a project, and tells how many live datasets are left without one."""
        self.delete("project", id, actor)
        return self.state("dataset").where(F.col("fields")["project_id"] == id).count()

    def resolve(self, id: str, actor: str, what: str = "object_key") -> tuple[str, int]:
        """(key, version) of a dataset's object for one who may see it."""
        row = self.get("dataset", id)
        if row["fields"].get("visibility") != "org":
            self.may(actor, "dataset", id, "viewer", row)
        require(what in row["fields"], f"dataset {id} has no {what}")
        return row["fields"][what], row["version"]

    def publish(self, id: str, actor: str, visibility: str, teams: tuple[str, ...] = (), may_publish: bool = False) -> Row:
        """Sets who sees a dataset: private, a team of the actor's, or org for those who may publish."""
        if visibility not in ("private", "org") and visibility not in teams:
            raise Refused(f"{actor} is not in team {visibility}")
        if visibility == "org" and not may_publish:
            raise Refused(f"{actor} may not publish to the organisation")
        return self.update("dataset", id, actor, {"visibility": visibility})

    # layers and basemaps

    def duplicate_layer(self, id: str, actor: str, name: str | None = None) -> Row:
        row = self.get("layer", id)
        self.may(actor, "layer", id, "viewer", row)
        return self.create("layer", actor, dict(row["fields"]) | {"name": name or f"{row['fields']['name']} (copy)", "copy_of": id})

    def _layers(self, ids: list[str]) -> list[str]:
        require(0 < len(ids) <= BASEMAP_LAYERS and len(set(ids)) == len(ids), f"a basemap has 1 to {BASEMAP_LAYERS} different layers, not {len(ids)}")
        known = {r["id"] for r in self.state("layer").where(F.col("id").isin(ids)).select("id").collect()}
        require(set(ids) <= known, f"there are no layers {', '.join(sorted(set(ids) - known))}")
        return ids

    def create_basemap(self, actor: str, name: str, layer_ids: list[str], **more) -> Row:
        """Layers from the bottom up."""
        return self.create("basemap", actor, {"name": name, "layer_ids": self._layers(layer_ids), **more})

    def set_basemap_layers(self, id: str, actor: str, layer_ids: list[str], seen: int | None = None) -> Row:
        return self.update("basemap", id, actor, {"layer_ids": self._layers(layer_ids)}, seen)

    def save_map_as_basemap(self, actor: str, name: str, layer_ids: list[str], active: str | None = None, include_active: bool = False) -> Row:
        return self.create_basemap(actor, name, [k for k in layer_ids if include_active or k != active])

    def basemap_layers(self) -> DataFrame:
        """(basemap_id, position, layer_id) of all live basemaps, from the bottom up."""
        ids = F.from_json(F.col("fields")["layer_ids"], "array<string>")
        return self.state("basemap").select(F.col("id").alias("basemap_id"), F.posexplode(ids).alias("position", "layer_id"))

    def basemaps_using(self, layer_id: str) -> DataFrame:
        return self.state("basemap").where(F.array_contains(F.from_json(F.col("fields")["layer_ids"], "array<string>"), layer_id))

    # grants and preferences

    def grant(self, actor: str, kind: str, id: str, grantee: str, role: str) -> Row:
        require(role in ROLES, f"role {role!r} is not one of {', '.join(ROLES)}")
        self.may(actor, kind, id, "owner")
        return self.create("grant", actor, {"object_kind": kind, "object_id": id, "grantee": grantee, "role": role})

    def grants(self, kind: str, id: str) -> DataFrame:
        f = F.col("fields")
        return self.state("grant").where((f["object_kind"] == kind) & (f["object_id"] == id)).select("id", f["grantee"].alias("grantee"), f["role"].alias("role"))

    def revoke(self, actor: str, grant_id: str) -> Row:
        row = self.get("grant", grant_id)
        self.may(actor, row["fields"]["object_kind"], row["fields"]["object_id"], "owner")
        return self._add("grant", grant_id, row["version"] + 1, actor, "delete", {})

    def prefer(self, actor: str, **choices) -> Row:
        """Sets preferences of an actor, or with None takes them away."""
        have = fold(self.entries("preference", actor)).first()
        return self.create("preference", actor, choices, actor) if have is None else self.update("preference", actor, actor, choices)

    def preferences(self, actor: str, *teams: str) -> dict[str, dict]:
        """What the organisation, the teams and the actor have set, each for itself."""
        rows = {r["id"]: dict(r["fields"]) for r in self.state("preference").where(F.col("id").isin("org", actor, *teams)).collect()}
        return {"org": rows.get("org", {}), "teams": {t: rows.get(t, {}) for t in teams}, "user": rows.get(actor, {})}

    # jobs, refreshes and lineage

    def step(self, id: str, actor: str, state: str, **fields) -> Row:
        """Takes a job to a state that may follow its own."""
        now = self.get("job", id)
        was = now["fields"].get("state", "queued")
        require(state in JOB_STEPS[was], f"job {id} is {was}; it can't become {state}")
        return self._add("job", id, now["version"] + 1, actor, "update", {"state": state, **fields})

    def report_progress(self, id: str, actor: str, fraction: float, message: str | None = None) -> Row:
        """Progress from 0 to 1 that never goes back; a job that was asked to stop raises Refused here."""
        now = self.get("job", id)
        if now["fields"].get("cancel") == "true":
            raise Refused(f"job {id} was asked to stop")
        done = max(min(max(fraction, 0.0), 1.0), float(now["fields"].get("fraction", 0)))
        return self.step(id, actor, "running", fraction=done, message=message)

    def mark_failed(self, id: str, actor: str, error: str, kind: str = "error") -> Row:
        return self.step(id, actor, "failed", error=error, error_kind=kind)

    def request_cancel(self, id: str, actor: str) -> Row:
        """A job that waits ends at once; one that runs is told at its next report."""
        now = self.get("job", id)
        self.may(actor, "job", id, "owner", now)
        if now["fields"].get("state", "queued") == "queued":
            return self.step(id, actor, "cancelled")
        require(now["fields"]["state"] == "running", f"job {id} is {now['fields']['state']} already")
        return self._add("job", id, now["version"] + 1, actor, "update", {"cancel": "true"})

    def mark_state(self, dataset_id: str, actor: str, state: str, synced: bool = False) -> Row:
        return self.update("dataset", dataset_id, actor, {"state": state} | ({"synced_at": self.clock().isoformat()} if synced else {}))

    def record_lineage(self, actor: str, output_id: str, operation: str, inputs: list[str] = (), **parameters) -> Row:
        """How a dataset came about: the operation, its parameters, and the inputs with the versions they had."""
        versions = {r["id"]: r["version"] for r in self.state("dataset", deleted=True).where(F.col("id").isin(list(inputs))).collect()} if inputs else {}
        return self.create("lineage", actor, {"output_id": output_id, "operation": operation, "parameters": parameters, "inputs": [{"id": i, "version": versions.get(i)} for i in inputs]})


class Phases:
    """Weighted phases of a job as one fraction that its ledger is told."""

    def __init__(self, ledger: Ledger, job_id: str, actor: str, weights: dict[str, float]):
        require(bool(weights) and all(w > 0 for w in weights.values()), "phases need weights above 0")
        self.ledger, self.job_id, self.actor, self.weights = ledger, job_id, actor, weights

    def report(self, phase: str, share: float = 0.0, message: str | None = None) -> Row:
        require(phase in self.weights, f"phase {phase!r} is not one of {', '.join(self.weights)}")
        names = list(self.weights)
        before = sum(self.weights[n] for n in names[: names.index(phase)])
        fraction = (before + self.weights[phase] * min(max(share, 0.0), 1.0)) / sum(self.weights.values())
        return self.ledger.report_progress(self.job_id, self.actor, fraction, message or phase)
