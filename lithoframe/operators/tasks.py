"""Jobs over datasets: each reads its inputs, runs one operation of the library, writes a dataset of its own and notes where it came
from. A job that fails leaves no dataset, only files that none names; the same job asked for twice is one."""

from __future__ import annotations

import json
import math
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import LayerError, require
from ..sources.grids import grid_note, read_grid, write_grid
from . import clipping, contours, polygons, solvers
from .aggregate import Stat, aggregate, operations
from .attributes import search
from .contours import auto_levels
from .grids import Grid, build_grid
from .ledger import Ledger, Phases, Refused
from .registry import idempotency_key
from .variogram import SAMPLE, Model, anisotropy_test, fit_auto

#: Lines of a contour set, and of an interval's levels.
LINES_MAX, LEVELS_MAX = 200_000, 500


def levels_for(surface: DataFrame, levels: list[float] | None = None, interval: float | None = None, target: int = contours.LEVELS) -> list[float]:
    """The levels that are given, else the multiples of the interval, else round ones: a stated level comes first, as matching
    another map beats any rule."""
    r = surface.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    require(r["a"] is not None, "every cell is blank, so there is nothing to contour")
    if levels:
        return sorted(float(v) for v in levels)
    if interval:
        first, last = math.ceil(r["a"] / interval), math.ceil(r["b"] / interval) - 1
        require(0 < last - first + 1 <= LEVELS_MAX, f"an interval of {interval} gives {last - first + 1} levels over {r['a']} to {r['b']}; 1 to {LEVELS_MAX} can be drawn")
        out = [k * interval for k in range(first, last + 1)]
        return out
    return auto_levels(r["a"], r["b"], target)


class Tasks:
    """Jobs of a ledger, their datasets under a shared folder."""

    def __init__(self, spark: SparkSession, ledger: Ledger, root: str):
        self.spark, self.ledger, self.root = spark, ledger, root
        self.known: dict[str, tuple[Callable, int, tuple[str, ...]]] = {
            "interpolate": (self._interpolate, 1, ("method",)), "contour": (self._contour, 1, ()), "bands": (self._bands, 1, ()), "clip_grid": (self._clip, 2, ()),
            "aggregate": (self._aggregate, 0, ("op",)), "label_anchors": (self._anchors, 1, ()), "fit_variogram": (self._variogram, 1, ("value",)),
        }

    # datasets

    def register(self, actor: str, name: str, data: DataFrame, srid: int, grid: Grid | None = None, **fields) -> Row:
        """A dataset of a table or, with a grid, of a surface (row, col, value)."""
        key = f"{self.root}/{self.ledger.clock().strftime('%Y%m%d')}-{idempotency_key(name, actor, {'at': self.ledger.clock().isoformat()})[:24]}"
        if grid is not None:
            note = write_grid(data, grid, key, name=name)
            fields |= {"cells": note["nx"] * note["ny"]}
        else:
            data.write.parquet(key)
            fields |= {"rows": self.spark.read.parquet(key).count()}
        return self.ledger.create("dataset", actor, {"name": name, "data_kind": "grid" if grid is not None else "features", "srid": srid, "object_key": key, **fields})

    def read(self, dataset_id: str, actor: str) -> DataFrame:
        """A dataset for one who may see it: a surface (row, col, x, y, value), or the rows of a table."""
        key, _ = self.ledger.resolve(dataset_id, actor)
        return read_grid(self.spark, key)[0] if self._fields(dataset_id)["data_kind"] == "grid" else self.spark.read.parquet(key)

    def _fields(self, dataset_id: str) -> dict:
        return dict(self.ledger.get("dataset", dataset_id)["fields"])

    def _grid(self, dataset_id: str, actor: str) -> tuple[DataFrame, Grid]:
        require(self._fields(dataset_id)["data_kind"] == "grid", f"dataset {dataset_id} is no grid")
        return read_grid(self.spark, self.ledger.resolve(dataset_id, actor)[0])

    def describe(self, dataset_id: str, actor: str) -> dict:
        """What is noted of a dataset, its columns or its grid, and its bounds where it has x and y."""
        key, version = self.ledger.resolve(dataset_id, actor)
        out = {**self._fields(dataset_id), "version": version}
        if out["data_kind"] == "grid":
            out["grid"] = grid_note(self.spark, key)
        data = self.read(dataset_id, actor)
        out["columns"] = data.dtypes
        if {"x", "y"} <= set(data.columns):
            out["bounds"] = tuple(data.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
        return out

    def search(self, query: str, actor: str, limit: int = 20) -> DataFrame:
        """Live datasets like a name that the actor owns or that all may see, best first."""
        live = self.ledger.state("dataset").withColumn("name", F.col("fields")["name"])
        seen = (F.col("owner") == actor) | (F.coalesce(F.col("fields")["visibility"], F.lit("")) == "org")
        return search(live, "name", query, limit=limit, where=seen)

    # jobs

    def submit(self, actor: str, operation: str, inputs: list[str], **parameters) -> Row:
        """A job, or the one of the same actor, operation, inputs and parameters that waits or runs already."""
        require(operation in self.known, f"operation {operation!r} is not one of {', '.join(self.known)}")
        _, n, needs = self.known[operation]
        require(len(inputs) == n or (n == 0 and inputs), f"{operation} takes {n or 'one or more'} datasets, not {len(inputs)}")
        missing = [k for k in needs if k not in parameters]
        require(not missing, f"{operation} needs {', '.join(missing)}")
        for i in inputs:
            self.ledger.resolve(i, actor)
        key = idempotency_key(operation, actor, {"inputs": inputs, **parameters})
        f = F.col("fields")
        same = self.ledger.state("job").where((f["key"] == key) & F.coalesce(f["state"], F.lit("queued")).isin("queued", "running")).first()
        return same or self.ledger.create("job", actor, {"operation": operation, "inputs": inputs, "parameters": parameters, "key": key, "state": "queued"})

    def run(self, job_id: str, worker: str = "worker") -> Row:
        """Runs a job to its end: succeeded with a dataset or a result, failed with the reason, or cancelled where it was asked to be."""
        job = self.ledger.get("job", job_id)
        actor, f = job["owner"], dict(job["fields"])
        inputs, parameters = json.loads(f["inputs"]), json.loads(f["parameters"])
        phases = Phases(self.ledger, job_id, worker, {"read": 1, "work": 8, "note": 1})
        try:
            phases.report("read")
            result, data, grid, srid, fields = self.known[f["operation"]][0](actor, inputs, **parameters)
            phases.report("work")
            made = self.register(actor, parameters.get("name") or f["operation"], data, srid, grid, **fields) if data is not None else None
            phases.report("note")
            if made is not None:
                self.ledger.record_lineage(worker, made["id"], f["operation"], inputs, **parameters)
            return self.ledger.step(job_id, worker, "succeeded", output_id=made["id"] if made is not None else None, result=result)
        except Refused:
            if self.ledger.get("job", job_id)["fields"].get("cancel") == "true":
                return self.ledger.step(job_id, worker, "cancelled")
            return self.ledger.mark_failed(job_id, worker, traceback.format_exc(limit=1), "refused")
        except LayerError as e:
            return self.ledger.mark_failed(job_id, worker, str(e), "input")
        except Exception as e:
            self.ledger.mark_failed(job_id, worker, f"{type(e).__name__}: {e}"[:2000], "error")
            raise

    # operations: (result, data, grid, srid, fields)

    def _srid(self, inputs: list[str]) -> int:
        frames = {int(self._fields(i)["srid"]) for i in inputs}
        require(len(frames) == 1, f"the datasets are in frames {sorted(frames)}; reproject them first")
        return frames.pop()

    def _control(self, actor: str, dataset_id: str, value: str) -> DataFrame:
        p = self.read(dataset_id, actor)
        require({"x", "y", value} <= set(p.columns), f"control needs columns x, y and {value}")
        p = p if "id" in p.columns else p.withColumn("id", F.monotonically_increasing_id())
        return p.select("id", "x", "y", F.col(value).cast("double").alias("value")).where("x IS NOT NULL AND y IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")

    def _interpolate(self, actor, inputs, method, value="value", size=None, model=None, name=None, **options):
        control, srid = self._control(actor, inputs[0], value), self._srid(inputs)
        g = build_grid(control, size)
        grid = Grid(g.x0, g.y0, g.size, g.nx, g.ny, srid)
        if method == "minimum_curvature":
            surface = solvers.minimum_curvature(self.spark, grid, control, **options).select("row", "col", "value")
        else:
            cells = grid.cells(self.spark)
            made = solvers.interpolate(cells, control, method, model=Model(**model) if model else None, **options)
            surface = cells.join(made.select("cell_id", "value"), "cell_id").select("row", "col", "value")
        return None, surface, grid, srid, {"method": method}

    def _contour(self, actor, inputs, levels=None, interval=None, target=contours.LEVELS, smoothing=0.0, min_length=0.0, name=None):
        surface, _ = self._grid(inputs[0], actor)
        at = levels_for(surface, levels, interval, target)
        lines = contours.lines(surface, at, smoothing=smoothing, min_length=min_length)
        n = lines.limit(LINES_MAX + 1).count()
        require(n <= LINES_MAX, f"{n} lines or more are too many to read; take a larger interval or a least length")
        return {"levels": at}, lines, None, self._srid(inputs), {"interval": contours.interval_of(at)}

    def _bands(self, actor, inputs, levels=None, interval=None, target=contours.LEVELS, smoothing=0.0, min_area=None, name=None):
        surface, _ = self._grid(inputs[0], actor)
        at = levels_for(surface, levels, interval, target)
        return {"levels": at}, contours.bands(surface, at, smoothing=smoothing, min_area=min_area), None, self._srid(inputs), {}

    def _clip(self, actor, inputs, invert=False, name=None):
        surface, grid = self._grid(inputs[0], actor)
        cut = clipping.clip_to_polygons(surface, self.read(inputs[1], actor), invert)
        return clipping.clip_report(cut), cut.select("row", "col", "value"), grid, self._srid(inputs), {}

    def _aggregate(self, actor, inputs, op, name=None, stats=None, **parameters):
        require(op in operations(), f"operation {op!r} is not one of {', '.join(operations())}")
        extra = [[Stat(**s) for s in stats]] if stats else []
        return None, aggregate(op, [self.read(i, actor) for i in inputs], *([parameters.pop("size")] if "size" in parameters else []), *extra, **parameters), None, self._srid(inputs), {}

    def _anchors(self, actor, inputs, tolerance_ratio=0.01, name=None):
        return None, polygons.label_anchors(self.read(inputs[0], actor), tolerance_ratio), None, self._srid(inputs), {}

    def _variogram(self, actor, inputs, value, max_lag=None, kind=None, test_direction=False, name=None):
        p = self._control(actor, inputs[0], value).withColumnRenamed("value", "v")
        m = fit_auto(p, kind, max_lag=max_lag, most=SAMPLE)
        out = {"kind": m.kind, "nugget": m.nugget, "sill": m.sill, "range": m.range}
        if test_direction:
            a = anisotropy_test(p, max_lag=max_lag)
            out |= {"ratio": a.ratio, "azimuth": a.azimuth, "p_value": a.p_value, "use_direction": a.use}
        return out, None, None, None, {}
