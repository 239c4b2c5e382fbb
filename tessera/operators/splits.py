"""Train/test splits and cross-validation as columns: exact sizes, deterministic by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import row_index


def test_size(n: int, share: float) -> int:
    """round(n * share), halves away from 0, at least 1 and at most n - 1."""
    return max(1, min(n - 1, int(n * share + 0.5)))


def _ordered(df: DataFrame, row_id: str, seed: int | None) -> DataFrame:
    """df with `_idx`, its 0-based index by id, or by a seeded hash of the id."""
    if seed is None:
        return row_index(df, row_id, "_idx")
    # The hash breaks no ties between equal ids, which ids don't have; 64 bits keep distinct ids apart.
    return row_index(df.withColumn("_order", F.xxhash64(F.lit(seed), F.col(row_id))), "_order", "_idx").drop("_order")


def train_test_split(df: DataFrame, row_id: str, share: float = 0.25, seed: int | None = None, stratify: str | None = None) -> DataFrame:
    """df with `is_test`: the last rows of the order. Stratified, classes (the labels' whole part) follow each other with
    their own test rows last, and a class of one row is for training."""
    n = df.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    if stratify is None:
        return _ordered(df, row_id, seed).withColumn("is_test", F.col("_idx") >= n - test_size(n, share)).drop("_idx")
    cls = F.col(stratify).cast("long")
    sizes = {r["c"]: r["n"] for r in df.groupBy(cls.alias("c")).agg(F.count("*").alias("n")).collect()}
    order = F.col(row_id) if seed is None else F.xxhash64(F.lit(seed), F.col(row_id))
    ranked = df.withColumn("_c", cls).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(order, row_id)))
    case = F.lit(0)
    for c, k in sizes.items():
        case = F.when(F.col("_c") == c, F.lit(0 if k == 1 else k - test_size(k, share) if k > 1 else 0)).otherwise(case)
    single = [c for c, k in sizes.items() if k == 1]
    test = (F.col("_r") > case) & ~F.col("_c").isin(single) if single else F.col("_r") > case
    return ranked.withColumn("is_test", test).drop("_c", "_r")


def fold_of(index: Column, n: int, folds: int) -> Column:
    """Fold of a 0-based index: consecutive folds, the first n % folds with one more row."""
    size, extra = divmod(n, folds)
    big = extra * (size + 1)
    return F.when(index < big, F.floor(index / (size + 1))).otherwise(F.lit(extra) + F.floor((index - big) / max(1, size))).cast("int")


def k_fold(df: DataFrame, row_id: str, folds: int, seed: int | None = None) -> DataFrame:
    """df with `fold`: its rows are that fold's test rows."""
    n = df.count()
    if folds < 2 or n < folds:
        raise ValueError("folds must be at least 2 and at most the rows")
    return _ordered(df, row_id, seed).withColumn("fold", fold_of(F.col("_idx"), n, folds)).drop("_idx")


def stratified_k_fold(df: DataFrame, row_id: str, label: str, folds: int, seed: int | None = None) -> DataFrame:
    """df with `fold`, dealt class by class: ntile has just that rule."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    order = F.col(row_id) if seed is None else F.xxhash64(F.lit(seed), F.col(row_id))
    return df.withColumn("fold", F.ntile(folds).over(Window.partitionBy(label).orderBy(order, row_id)) - 1)


def leave_one_out(df: DataFrame, row_id: str) -> DataFrame:
    """df with `fold`, the row's own index: each fold has one test row, and the others by `fold <> k`."""
    return row_index(df, row_id, "fold")


def shuffle_split(df: DataFrame, row_id: str, splits: int, share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with an array `test_in` of the splits in which a row is tested; each split has the same number of test rows."""
    n = df.count()
    if n < 2 or splits < 1:
        raise ValueError("at least two rows and one split are needed")
    k = test_size(n, share)
    for s in range(splits):
        df = row_index(df.withColumn("_order", F.xxhash64(F.lit(seed + s), F.col(row_id))), "_order", f"_s{s}").drop("_order")
    tests = F.array(*(F.when(F.col(f"_s{s}") >= n - k, s) for s in range(splits)))
    return df.withColumn("test_in", F.array_compact(tests)).drop(*(f"_s{s}" for s in range(splits)))
