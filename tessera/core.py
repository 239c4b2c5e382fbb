"""Errors, guarded arithmetic, exact order statistics and global prefix sums that need no single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NumericalError(ArithmeticError):
    """A computation that has no result."""


class SingularMatrix(NumericalError):
    """A pivot is exactly zero."""


class NotPositiveDefinite(NumericalError):
    """A Cholesky pivot isn't positive."""


class NotConverged(NumericalError):
    """An iteration ended without its tolerance."""


class NotFitted(RuntimeError):
    """A transform before its fit."""


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE floats: infinities and NaN where ANSI mode would raise."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a) | F.isnan(b), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], small: int = 50_000) -> list[float]:
    """The values at 0-based ranks of the column's ascending non-null values, exactly.

    Approximate percentiles bracket each rank and exact counts confirm the bracket, which shrinks until few enough values
    are left to collect. No sort or window ever holds the column.
    """
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    out = []
    for rank in ranks:
        part, below, width = values, 0, 0.001
        while True:
            n = part.count()
            if not below <= rank < below + n:
                raise ValueError(f"there is no rank {rank} among {n} values")
            if n <= small:
                out.append(sorted(r.v for r in part.collect())[rank - below])
                break
            p = (rank - below) / n
            low, high = part.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, p - width)), F.lit(min(1.0, p + width))), F.lit(10_000))).first()[0]
            under, upto = part.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
            if not below + under <= rank < below + upto:
                width *= 10
                continue
            if low == high:
                out.append(low)
                break
            if upto - under == n:  # only a few distinct values: count them
                for r in sorted(part.groupBy("v").count().collect()):
                    below += r["count"]
                    if rank < below:
                        out.append(r.v)
                        break
                break
            part, below = part.filter((F.col("v") >= low) & (F.col("v") <= high)), below + under
    return out


def bucketed(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """df with `_bucket`: 0.. by approximate quantiles of the column, ascending; equal values share a bucket."""
    marks = df.agg(F.percentile_approx(F.col(column), F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10 * buckets)).alias("q")).first().q or []
    marks = sorted(set(marks))
    edges = F.array(*(F.lit(m) for m in marks)) if marks else F.array()
    inner = F.size(F.filter(edges, lambda e: e < F.col(column))) if marks else F.lit(0)
    return df.withColumn("_bucket", F.coalesce(inner, F.lit(0)))


def prefix_sums(df: DataFrame, order: str, values: dict[str, str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """df with running sums (new name: summed column) over rows in the order of a column, which must be unique.

    Rows are put into quantile buckets; the buckets' totals (a few rows) give each its offset and windows run inside
    buckets, so no task sees all rows.
    """
    df = bucketed(df, order, buckets)
    sums = df.groupBy("_bucket").agg(*(F.sum(c).alias(c) for c in values.values())).collect()
    sums.sort(key=lambda r: r["_bucket"], reverse=descending)
    w = Window.partitionBy("_bucket").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for new, c in values.items():
        offset, before = F.lit(0), sums[0][c] - sums[0][c] if sums else 0
        cases = None
        for r in sums:
            cases = F.when(F.col("_bucket") == r["_bucket"], F.lit(before)) if cases is None else cases.when(F.col("_bucket") == r["_bucket"], F.lit(before))
            before = before + (r[c] or 0)
        out = out.withColumn(new, F.sum(c).over(w) + (offset if cases is None else cases))
    return out.drop("_bucket")


def row_index(df: DataFrame, order: str, name: str = "idx", buckets: int = 64) -> DataFrame:
    """df with a 0-based index in the ascending order of a unique column."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, buckets=buckets).withColumn(name, F.col(name) - 1).drop("_one")
