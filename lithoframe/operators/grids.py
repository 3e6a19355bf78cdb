"""Regular grids: round cell sizes, definitions that cover bounds, cell centres, tall surfaces."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.geometry import NICE

#: Cells a grid may have, the value that stands for no data in some grids, and the cells across of a default grid.
CELLS_MAX, BLANK, ACROSS = 16_000_000, 1.70141e38, 200


def nice_cell_size(v: float) -> float:
    require(v > 0, f"a cell size must be above 0, not {v}")
    p = 10.0 ** math.floor(math.log10(v))
    return next(n * p for n in NICE if round(v / p, 12) <= n)


@dataclass(frozen=True)
class Grid:
    """nx by ny cells of a size; (x0, y0) is the upper left corner and row 0 the northernmost."""

    x0: float
    y0: float
    size: float
    nx: int
    ny: int
    srid: int | None = None

    @classmethod
    def covering(cls, box: tuple[float, float, float, float], size: float, margin: int = 0, srid: int | None = None) -> Grid:
        """One cell more than the bounds need, and margin cells around."""
        require(size > 0, f"the cell size must be above 0, not {size}")
        nx, ny = (math.ceil((hi - lo) / size) + 1 + 2 * margin for lo, hi in ((box[0], box[2]), (box[1], box[3])))
        check_grid_size(nx, ny, size)
        return cls(box[0] - (margin + 0.5) * size, box[1] + (ny - margin - 0.5) * size, size, nx, ny, srid)

    def transform(self) -> tuple[float, ...]:
        return (self.size, 0.0, self.x0, 0.0, -self.size, self.y0)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, row, col, x, y): cell centres in rows from the north."""
        i = F.col("id")
        row, col = F.floor(i / self.nx).cast("int"), F.pmod(i, F.lit(self.nx)).cast("int")
        return spark.range(self.nx * self.ny).select(i.alias("cell_id"), row.alias("row"), col.alias("col"), (self.x0 + (col + 0.5) * self.size).alias("x"), (self.y0 - (row + 0.5) * self.size).alias("y"))


def check_grid_size(nx: int, ny: int, size: float) -> None:
    require(nx * ny <= CELLS_MAX, f"{nx} x {ny} = {nx * ny} cells are more than {CELLS_MAX}; a cell size of {nice_cell_size(size * math.sqrt(nx * ny / CELLS_MAX))} fits")


def build_grid(points: DataFrame, size: float | None = None, margin_share: float = 0.05) -> Grid:
    """A grid over the points' bounds with a margin; without a size, a round one that gives about ACROSS cells."""
    b = points.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    require(b["a"] is not None, "there are no points to cover with a grid")
    mx, my = (b["c"] - b["a"]) * margin_share, (b["d"] - b["b"]) * margin_share
    box = (b["a"] - mx, b["b"] - my, b["c"] + mx, b["d"] + my)
    return Grid.covering(box, size or nice_cell_size(max(box[2] - box[0], box[3] - box[1], 1e-9) / ACROSS))


def blanking_to_nan(surface: DataFrame, value: str = "value") -> DataFrame:
    return surface.withColumn(value, F.when(F.col(value) >= BLANK, F.lit(float("nan"))).otherwise(F.col(value)))


def clip_to_box(surface: DataFrame, box: tuple[float, float, float, float], invert: bool = False) -> DataFrame:
    """The surface without value outside the box, or inside it."""
    inside = (F.col("x") >= box[0]) & (F.col("x") <= box[2]) & (F.col("y") >= box[1]) & (F.col("y") <= box[3])
    return surface.withColumn("value", F.when(~inside if invert else inside, F.col("value")))
