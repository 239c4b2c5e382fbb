"""cut, qcut and digitize."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import order_statistics


def _first_edge(c: Column, edges: Sequence[Column], labels: Sequence[str]) -> Column:
    """The label of the first bin whose upper edge is at least the value; the last one otherwise."""
    out = F.lit(None).cast("string")
    out = F.when(c.isNull(), out)
    for e, label in zip(edges[:-1], labels):
        out = out.when(c <= e, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def _labels(n: int, labels: Sequence[str] | None, prefix: str, first: int) -> list[str]:
    if n < 2:
        raise ValueError("at least two bins are needed")
    if labels is not None and len(labels) != n:
        raise ValueError("there must be a label for each bin")
    return list(labels) if labels is not None else [f"{prefix}{i + first}" for i in range(n)]


def cut(df: DataFrame, column: str, bins: int, labels: Sequence[str] | None = None, out: str = "bin") -> DataFrame:
    """Labels of equal-width bins, closed on the right (bin_0, bin_1, ... by default)."""
    labels = _labels(bins, labels, "bin_", 0)
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    edges = [F.col("_lo") + (i + 1) * ((F.col("_hi") - F.col("_lo")) / bins) for i in range(bins)]
    return df.crossJoin(F.broadcast(ends)).withColumn(out, _first_edge(F.col(column), edges, labels)).drop("_lo", "_hi")


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Order statistics at trunc(i / bins * (n - 1)), i from 0 to bins; no interpolation."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        raise ValueError("no values")
    return order_statistics(df, column, [int(i / bins * (n - 1)) for i in range(bins + 1)])


def qcut(df: DataFrame, column: str, bins: int, labels: Sequence[str] | None = None, out: str = "bin") -> DataFrame:
    """Labels of quantile bins, closed on the right (Q1, Q2, ... by default)."""
    labels = _labels(bins, labels, "Q", 1)
    edges = quantile_edges(df, column, bins)
    return df.withColumn(out, _first_edge(F.col(column), [F.lit(e) for e in edges[1:]], labels))


def digitize(c: Column, edges: Sequence[float]) -> Column:
    """Index into ascending edges, closed on the left: 0 below, len - 2 above, len - 1 at the last edge itself."""
    if len(edges) < 2 or any(a > b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must ascend and be at least two")
    out = F.when(c.isNull(), F.lit(None).cast("int")).when(c < edges[0], 0).when(c == edges[-1], len(edges) - 1).when(c > edges[-1], len(edges) - 2)
    for i in range(1, len(edges)):
        out = out.when(c < edges[i], i - 1)
    return out
