"""Edits of rings as arrays of structs (x, y), all Column arithmetic; a closed ring keeps its last vertex equal to its first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vertices of the smallest closed ring, and decimals of coincidence.
RING_MIN, DECIMALS = 4, 7


def closed(ring: Column) -> Column:
    return (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def insert_vertex(ring: Column, after: int, x: Column, y: Column) -> Column:
    """A vertex behind the one of this 0-based ordinal."""
    point = F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.concat(F.slice(ring, F.lit(1), F.lit(after + 1)), point, F.slice(ring, F.lit(after + 2), F.greatest(F.lit(0), F.size(ring) - after - 1)))


def remove_vertex(ring: Column, ordinal: int) -> Column:
    """The ring without a vertex; a ring of the smallest size stays, and a closed ring that loses its first closes anew."""
    rest = F.filter(ring, lambda v, i: i != ordinal)
    first = F.filter(ring, lambda v, i: (i != 0) & (i != F.size(ring) - 1))
    again = F.concat(first, F.slice(first, F.lit(1), F.lit(1)))
    ends = F.lit(ordinal == 0) | (F.size(ring) - 1 == ordinal)
    return F.when(closed(ring) & (F.size(ring) <= RING_MIN), ring).when(closed(ring) & ends, again).otherwise(rest)


def set_vertex(ring: Column, ordinal: int, x: Column, y: Column) -> Column:
    """The ring with a vertex moved; the closing vertex follows the first, and the first the closing one."""
    point = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.size(ring)
    twin = closed(ring) & (F.lit(ordinal == 0) | (n - 1 == ordinal))
    return F.transform(ring, lambda v, i: F.when((i == ordinal) | (twin & ((i == 0) | (i == n - 1))), point).otherwise(v))


def without_repeats(ring: Column) -> Column:
    """The vertices that differ from the one before."""
    return F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))


def coincidence_key(x: Column, y: Column) -> Column:
    """Vertices of equal keys coincide."""
    return F.struct(F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"))


def length(ring: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ring) - 1)), F.lit(0.0), lambda a, i: a + F.when(i < F.size(ring), F.sqrt(F.pow(F.get(ring, i)["x"] - F.get(ring, i - 1)["x"], F.lit(2.0)) + F.pow(F.get(ring, i)["y"] - F.get(ring, i - 1)["y"], F.lit(2.0)))).otherwise(0.0))
