"""Points, segments and uniform spatial bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import total


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(0.0) if z is None else z.cast("double")).alias("z"))


def displace(p: Column, dx: float, dy: float, dz: float = 0.0) -> Column:
    return point(p["x"] + dx, p["y"] + dy, p["z"] + dz)


def distance_squared(a: Column, b: Column, axes: str = "xyz") -> Column:
    return total([(a[k] - b[k]) * (a[k] - b[k]) for k in axes])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def distance_2d(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b, "xy"))


def segment(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def distance_to_segment(s: Column, p: Column) -> Column:
    """To the nearest point of the segment; a segment of no length is a point."""
    a, b = s["a"], s["b"]
    along = total([(p[k] - a[k]) * (b[k] - a[k]) for k in "xyz"])
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.nullif(distance_squared(a, b), F.lit(0.0)))), F.lit(0.0))
    return distance(p, point(*(a[k] + t * (b[k] - a[k]) for k in "xyz")))


@dataclass
class Bins:
    """A grid of equal cells over a box of 2 or 3 axes."""

    axes: Sequence[str]
    low: Sequence[float]
    high: Sequence[float]
    cells: Sequence[int]

    def __post_init__(self) -> None:
        if not len(self.axes) == len(self.low) == len(self.high) == len(self.cells) in (2, 3) or min(self.cells) < 1 or any(a >= b for a, b in zip(self.low, self.high)):
            raise ValueError("2 or 3 axes with positive extents and cells are needed")

    def index(self, *columns: Column) -> Column:
        """Flat cell index, the upper faces belonging to the last cells; -1 outside the box."""
        at, stride, inside = F.lit(0).cast("long"), 1, F.lit(True)
        for c, a, b, n in zip(columns, self.low, self.high, self.cells):
            at = at + F.least(F.floor((c - a) / ((b - a) / n)), F.lit(n - 1)) * stride
            inside = inside & (c >= a) & (c <= b)
            stride *= n
        return F.when(inside, at).otherwise(F.lit(-1).cast("long"))

    def assign(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """df with `bin`; a point outside the box is an error unless not strict."""
        at = self.index(*(F.col(c) for c in self.axes))
        return df.withColumn("bin", F.when(at < 0, F.raise_error(F.lit("point outside the box")).cast("long")).otherwise(at) if strict else at)

    def near(self, entries: DataFrame, queries: DataFrame, tol: float, neighbours: bool = False) -> DataFrame:
        """(query columns prefixed q_, entry columns) of entries within tol of a query. Only the query's own cell is
        searched, unless neighbours: then each query meets all cells that its ball may touch."""
        e = self.assign(entries)
        q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
        at = [F.col(f"q_{c}") for c in self.axes]
        if neighbours:
            spans = []
            for c, a, b, n in zip(at, self.low, self.high, self.cells):
                size = (b - a) / n
                lo, hi = F.greatest(F.floor((c - tol - a) / size), F.lit(0)), F.least(F.floor((c + tol - a) / size), F.lit(n - 1))
                spans.append((lo, hi))
            q = q.withColumn("bin", F.lit(0).cast("long"))
            stride = 1
            for (lo, hi), n in zip(spans, self.cells):
                q = q.withColumn("_k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn("bin", F.col("bin") + F.col("_k") * stride).drop("_k")
                stride *= n
        else:
            q = q.withColumn("bin", self.index(*at))
        d = total([(F.col(c) - x) * (F.col(c) - x) for c, x in zip(self.axes, at)])
        return q.join(e, "bin").filter(d <= tol * tol)

    def first_near(self, entries: DataFrame, queries: DataFrame, tol: float, query_id: str, order: str) -> DataFrame:
        """Of each query the entry found first in the given order: (q_<query_id>, <order>)."""
        return self.near(entries, queries, tol).groupBy(f"q_{query_id}").agg(F.min(order).alias(order))
