"""Grids at rest: Parquet tiles with overviews, and their affine, frame and blank value beside them.

A tile is one row (level, tile_row, tile_col, values), its values in rows from the north. Tiles are sorted by level and place, so a
window of a grid is a filter that reaches the row groups. Each overview has one cell for 2 x 2 of the level below."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators.grids import Grid
from ..scratch import create_once, cut

#: Cells along a tile, and tiles along the last overview.
SIDE, LAST = 256, 1
NAME, VERSION = "grid.json", 1


def _tiles(cells: DataFrame, level: int) -> DataFrame:
    """Cells (row, col, value) as tiles of SIDE x SIDE values; cells that are missing are blank."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full((SIDE, SIDE), np.nan)
        v[pdf["row"] - key[0] * SIDE, pdf["col"] - key[1] * SIDE] = pdf["value"]
        return pd.DataFrame({"level": [level], "tile_row": [key[0]], "tile_col": [key[1]], "values": [v.astype("<f8").tobytes()]})

    at = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    known = cells.where("value IS NOT NULL AND NOT isnan(value)").select("row", "col", F.col("value").cast("double").alias("value"))
    return known.withColumns({"tile_row": at("row"), "tile_col": at("col")}).groupBy("tile_row", "tile_col").applyInPandas(pack, "level int, tile_row int, tile_col int, values binary")


def _halved(tiles: DataFrame) -> DataFrame:
    """The next overview: the mean of the known values of each 2 x 2 cells. Four tiles make one."""

    def shrink(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full((2 * SIDE, 2 * SIDE), np.nan)
        for r, c, b in zip(pdf["tile_row"], pdf["tile_col"], pdf["values"]):
            v[(r % 2) * SIDE :, (c % 2) * SIDE :][:SIDE, :SIDE] = np.frombuffer(b, "<f8").reshape(SIDE, SIDE)
        four = v.reshape(SIDE, 2, SIDE, 2).swapaxes(1, 2).reshape(SIDE, SIDE, 4)
        n = np.isfinite(four).sum(axis=2)
        mean = np.where(n > 0, np.nansum(four, axis=2) / np.maximum(n, 1), np.nan)
        return pd.DataFrame({"level": [int(pdf["level"].iloc[0]) + 1], "tile_row": [key[0]], "tile_col": [key[1]], "values": [mean.astype("<f8").tobytes()]})

    up = [F.floor(F.col(c) / 2).cast("int").alias(f"__{c}") for c in ("tile_row", "tile_col")]
    return tiles.groupBy(*up).applyInPandas(shrink, "level int, tile_row int, tile_col int, values binary")


def write_grid(surface: DataFrame, grid: Grid, path: str, *, name: str | None = None) -> dict:
    """Writes a surface (row, col, value) of a grid into a fresh folder, and returns what is noted of it. The note is created last
    and whole, so a folder without one is no grid."""
    spark = surface.sparkSession
    levels = [cut(_tiles(surface, 0))]
    while math.ceil(max(grid.nx, grid.ny) / 2 ** (len(levels) - 1) / SIDE) > LAST:
        levels.append(cut(_halved(levels[-1])))
    every = levels[0]
    for t in levels[1:]:
        every = every.unionAll(t)
    tiles = -(-grid.nx // SIDE) * -(-grid.ny // SIDE)
    every.repartitionByRange(max(1, tiles // 64), "level", "tile_row", "tile_col").sortWithinPartitions("level", "tile_row", "tile_col").write.parquet(f"{path}/tiles")
    r = levels[0].agg(F.count("*").alias("n")).first()
    note = {"version": VERSION, "name": name, "affine": list(grid.transform()), "nx": grid.nx, "ny": grid.ny, "srid": grid.srid, "blank": "nan", "side": SIDE, "levels": len(levels), "tiles": r["n"]}
    require(create_once(spark, f"{path}/{NAME}", json.dumps(note).encode()), f"{path} has a grid already; write to a fresh folder")
    return note


def grid_note(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(f"{path}/{NAME}", wholetext=True).collect()
    require(len(rows) == 1, f"{path} has no grid")
    return json.loads(rows[0][0])


def grid_of(note: dict, level: int = 0) -> Grid:
    """The grid of a level, from the affine of the whole: its upper left corner stays, its cells are 2^level as wide."""
    a = note["affine"]
    k = 2**level
    return Grid(a[2], a[5], a[0] * k, -(-note["nx"] // k), -(-note["ny"] // k), note["srid"])


def read_grid(spark: SparkSession, path: str, *, window: tuple[float, float, float, float] | None = None, level: int = 0, blank: float | None = None) -> tuple[DataFrame, Grid]:
    """(surface, grid): (row, col, x, y, value) of the cells with a value, of a level, whose centre lies in the window (xmin, ymin,
    xmax, ymax). Only tiles that the window meets are read. blank: a value that stands for none, and NaN always does."""
    note = grid_note(spark, path)
    require(0 <= level < note["levels"], f"level {level} is not one of 0 to {note['levels'] - 1}")
    grid, side = grid_of(note, level), note["side"]
    tiles = spark.read.schema("level int, tile_row int, tile_col int, values binary").parquet(f"{path}/tiles").where(F.col("level") == level)
    if window is not None:
        c0, c1 = ((w - grid.x0) / grid.size - 0.5 for w in (window[0], window[2]))
        r0, r1 = ((grid.y0 - w) / grid.size - 0.5 for w in (window[3], window[1]))
        span = [math.floor(math.ceil(c0) / side), math.floor(math.floor(c1) / side), math.floor(math.ceil(r0) / side), math.floor(math.floor(r1) / side)]
        tiles = tiles.where((F.col("tile_col") >= span[0]) & (F.col("tile_col") <= span[1]) & (F.col("tile_row") >= span[2]) & (F.col("tile_row") <= span[3]))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tr, tc, data in zip(b["tile_row"], b["tile_col"], b["values"]):
                v = np.frombuffer(data, "<f8").reshape(side, side)
                known = np.isfinite(v) if blank is None else np.isfinite(v) & (v != blank)
                r, c = np.nonzero(known)
                row, col = r + tr * side, c + tc * side
                yield pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32), "x": grid.x0 + (col + 0.5) * grid.size, "y": grid.y0 - (row + 0.5) * grid.size, "value": v[r, c]})

    out = tiles.select("tile_row", "tile_col", "values").mapInPandas(unpack, "row int, col int, x double, y double, value double")
    if window is not None:
        out = out.where((F.col("x") >= window[0]) & (F.col("x") <= window[2]) & (F.col("y") >= window[1]) & (F.col("y") <= window[3]))
    return out, grid
