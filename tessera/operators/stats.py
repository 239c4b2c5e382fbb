"""Column statistics, covariance and correlation, centring, histogram: each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _need(columns: Sequence[str]) -> None:
    if not columns:
        raise ValueError("at least one column is needed")


def mean(c: str) -> Column:
    return F.avg(c)


def std(c: str, ddof: int = 0) -> Column:
    """Standard deviation with n - ddof; null where there are too few rows."""
    if ddof == 0:
        return F.stddev_pop(c)
    n = F.count(c)
    return F.when(n > ddof, F.sqrt(F.var_pop(c) * n / F.nullif(n - ddof, F.lit(0))))


def minimum(c: str) -> Column:
    """Least value; NaN is skipped."""
    return F.min(F.when(~F.isnan(c), F.col(c)))


def maximum(c: str) -> Column:
    """Largest value; NaN is skipped."""
    return F.max(F.when(~F.isnan(c), F.col(c)))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: column, n, mean, std, min, max, sum; one pass over the data."""
    _need(columns)
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), mean(c).alias("mean"), std(c).alias("std"), minimum(c).alias("min"), maximum(c).alias("max"), F.sum(c).alias("sum")) for c in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def covariance(x: str, y: str, ddof: int = 0) -> Column:
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.covar_pop(x, y) if ddof == 0 else F.when(n > ddof, F.covar_pop(x, y) * n / F.nullif(n - ddof, F.lit(0)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; 0 where a column is constant."""
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0))


def _matrix(df: DataFrame, columns: Sequence[str], cell) -> DataFrame:
    _need(columns)
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cell(i, j).alias("val")) for i, j in cells)).alias("s")).select(F.inline("s"))
    return one.select("i", "j", "val").unionByName(one.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "val"))


def covariance_matrix(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """(i, j, val) of all pairs of columns; the upper triangle is aggregated once and mirrored."""
    return _matrix(df, columns, lambda i, j: covariance(columns[i], columns[j], ddof))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, val); the diagonal is 1, a constant column has 0 elsewhere."""
    return _matrix(df, columns, lambda i, j: F.lit(1.0) if i == j else correlation(columns[i], columns[j]))


def center(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their means; the one-row model is joined by broadcast."""
    _need(columns)
    model = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    return df.crossJoin(F.broadcast(model)).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*model.columns)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; that of a constant column counts as 1."""
    _need(columns)
    model = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(model)).withColumns(z).drop(*model.columns)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal widths, closed on the left, the last on both sides; empty bins are reported.

    A constant column has all values in bin 0; no values at all give an error.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    df = df.filter(F.col(column).isNotNull())
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.expr("if(lo is null, raise_error('no values'), lo)").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).select("lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"))
    at = F.when(F.col("w") == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif("w", F.lit(0.0))).cast("int"), F.lit(bins - 1)))
    n = df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(n), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
