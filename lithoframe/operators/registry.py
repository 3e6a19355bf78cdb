"""Versioned layers and their registry: edits, refreshes, lineage, visibility, permissions, quotas, preferences."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..scratch import cut

#: Roles by rank, and what visibility alone gives.
ROLES = ("none", "viewer", "editor", "owner")


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, whole, by aggregation: no sort of a key's versions."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def apply_edits(base: DataFrame, edits: DataFrame, *, key: str = "id", check: bool = True) -> DataFrame:
    """The next version of a layer. edits: key, seq, deleted, and columns of base to set; null leaves a value. The last edit of
    a key wins, so a later change undoes a deletion; untouched rows stay as they are. Unknown keys and an empty result are
    errors."""
    fields = [c for c in edits.columns if c not in (key, "seq", "deleted")]
    last = latest(edits, key, "seq")
    if check:
        stray = last.join(base.select(key), key, "left_anti")
        n = stray.count()
        require(n == 0, f"{n} edits name features that this version lacks; reload the layer and edit again")
    set_ = last.withColumnsRenamed({c: f"__new_{c}" for c in fields}).drop("seq")
    out = base.join(set_, key, "left").where("NOT coalesce(deleted, false)")
    out = out.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in fields if c in base.columns}).select(*base.columns)
    if check:
        require(not out.isEmpty(), "these edits delete every feature; delete the layer instead")
    return out


def sync_due(sources: DataFrame, now: Column, hours: float, *, synced: str = "synced_at") -> DataFrame:
    """Sources that were never synced, or hours ago or longer."""
    return sources.where(F.col(synced).isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(synced).cast("timestamp")) >= hours * 3600))


def changed(listing: DataFrame, known: DataFrame, *, key: str = "id", checksum: str = "checksum", force: bool = False) -> DataFrame:
    """Listed sources whose checksum the registry doesn't have; all with force."""
    return listing if force else listing.join(known.select(key, checksum), [key, checksum], "left_anti")


def derived_from(lineage: DataFrame, dataset_id: int, *, inputs: str = "inputs") -> DataFrame:
    return lineage.where(F.array_contains(inputs, F.lit(dataset_id)))


def lineage_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth): the fewest steps (input -> output) from the roots. Each round joins only what the last one reached for the
    first time, so cycles end; the walk goes on until a round reaches nothing new."""
    seen = roots.select("id", F.lit(0).alias("depth"))
    front = seen
    for i in count(1):
        new = front.join(edges, front["id"] == edges["input"]).select(F.col("output").alias("id")).distinct()
        front = cut(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(i).alias("depth")))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
        if i % 16 == 0:  # a deep lineage's plan stays short
            seen = cut(seen)


def visible(objects: DataFrame, principal: int, teams: DataFrame, grants: DataFrame) -> DataFrame:
    """Objects a principal may see: own, public to the organisation, of a team of theirs, or granted to them or a team.

    objects: id, owner, visibility (private, team, org), team. teams: principal, team. grants: id, principal, team."""
    mine = teams.where(F.col("principal") == principal).select("team").distinct()
    own = F.broadcast(mine)  # the teams of one person
    to_me = grants.where(F.col("principal") == principal).select("id").unionAll(grants.join(own, "team", "left_semi").select("id")).distinct().select("id", F.lit(True).alias("__granted"))
    mark = objects.join(own.select("team", F.lit(True).alias("__team")), "team", "left").join(to_me, "id", "left")
    ok = (F.col("owner") == principal) | (F.col("visibility") == "org") | ((F.col("visibility") == "team") & F.coalesce("__team", F.lit(False))) | F.coalesce("__granted", F.lit(False))
    return mark.where(ok).select(*objects.columns)


def permission(objects: DataFrame, principal: int, grants: DataFrame) -> DataFrame:
    """(id, level): the greatest of owner, the best grant and what visibility gives, as a rank in ROLES."""
    best = grants.where(F.col("principal") == principal).groupBy("id").agg(F.max("rank").alias("r"))
    level = F.greatest(F.when(F.col("owner") == principal, 3).otherwise(0), F.coalesce("r", F.lit(0)), F.when(F.col("visibility") == "org", 1).otherwise(0))
    return objects.join(best, "id", "left").select("id", level.alias("level"))


def quota_usage(jobs: DataFrame, user: int, team: Column, now: Column) -> DataFrame:
    """One row of conditional counts and today's seconds, in one pass."""
    mine, running, queued = F.col("user") == user, F.col("state") == "running", F.col("state") == "queued"
    today = F.date_trunc("day", F.col("created_at")) == F.date_trunc("day", now)
    return jobs.agg(
        F.count_if(mine & running).alias("running"), F.count_if(mine & queued).alias("queued"), F.count_if(team & running).alias("team_running"),
        F.count_if(mine & today).alias("today"), F.round(F.coalesce(F.sum(F.when(mine & today, F.col("seconds"))), F.lit(0.0)), 3).alias("seconds_today"),
    )


#: Most jobs of a user that run, that wait, and that run in a team.
QUOTA = {"running": 2, "queued": 10, "team_running": 6, "seconds_today": 7200.0}


def check_concurrency(usage: dict, policy: dict = QUOTA) -> None:
    for name, most in policy.items():
        require(usage[name] < most, f"{name.replace('_', ' ')} is {usage[name]}, and {most} is the most; wait for a job to end or cancel one")


def check_point_count(df: DataFrame, most: int = 2_000_000) -> None:
    n = df.limit(most + 1).count()
    require(n <= most, f"there are more than {most} control points; thin them first")


def default_choice(people: DataFrame, *tiers: DataFrame, key: str = "principal") -> DataFrame:
    """(key, choice): the first tier (key, choice) that has one; a tier without key holds for all."""
    out = people.select(key)
    for i, t in enumerate(tiers):
        t = t.withColumnRenamed("choice", f"__c{i}")
        out = out.join(t, key, "left") if key in t.columns else out.join(F.broadcast(t.limit(1)), how="left")
    return out.select(key, F.coalesce(*[F.col(f"__c{i}") for i in range(len(tiers))]).alias("choice"))


def reconcile(have: DataFrame, want: DataFrame, on: list[str]) -> DataFrame:
    """Rows to add and to remove (column change) so that have becomes want."""
    added = want.select(*on).distinct().join(have, on, "left_anti").withColumn("change", F.lit("added"))
    removed = have.select(*on).distinct().join(want, on, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionAll(removed)


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def enqueue(jobs: DataFrame, new: DataFrame, window_seconds: float, now: Column) -> DataFrame:
    """New jobs whose idempotency key no job of the window has; of equal keys among them, the first id."""
    recent = jobs.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")) < window_seconds)
    first = new.groupBy("key").agg(F.min_by(F.struct(*[c for c in new.columns if c != "key"]), "id").alias("s")).select("key", "s.*")
    return first.join(recent.select("key"), "key", "left_anti")


def idempotency_key(kind: str, principal: str, parameters: dict) -> str:
    body = json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256("\x1f".join((kind, principal, body)).encode()).hexdigest()


def normalise_groups(groups: str | Column) -> Column:
    """Trimmed, distinct, sorted group names without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(groups, lambda g: F.trim(g)), lambda g: g != "")))


def session_layers(sessions: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, n_layers, hidden): a session's layers that the reader sees, and how many they don't."""
    each = sessions.select("id", F.posexplode("layers").alias("z", "layer"))
    seen = each.join(layers.select(F.col("id").alias("layer"), F.lit(1).alias("__v")), "layer", "left")
    return seen.groupBy("id").agg(F.count("__v").alias("n_layers"), (F.count("*") - F.count("__v")).alias("hidden"))


def upgrade(kind: str, document: dict, target: int, steps: dict) -> dict:
    """A document walked through the registered upgrades (kind, version) -> function to the target version."""
    out = dict(document)
    while out.get("version", 1) < target:
        step = steps.get((kind, out.get("version", 1)))
        require(step is not None, f"no upgrade of {kind} leads from version {out.get('version', 1)}; register one")
        out = step(out) | {"version": out.get("version", 1) + 1}
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
