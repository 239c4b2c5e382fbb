"""Standard, min-max and robust scalers; a fitted model is one value pair per column, inlined as literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import NotFitted, order_statistics


class _Scaler:
    def __init__(self, columns: Sequence[str]):
        if not columns:
            raise ValueError("at least one column is needed")
        self.columns, self.model = list(columns), None

    def _affine(self) -> dict[str, tuple[float, float, float]]:
        """Of each column: shift, divisor, and what is added in the end; x -> (x - shift) / divisor + end."""
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit comes first")
        return df.withColumns({c: (F.col(c) - a) / b * k + e for c, (a, b, k, e) in self.model.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit comes first")
        return df.withColumns({c: (F.col(c) - e) / k * b + a for c, (a, b, k, e) in self.model.items()})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class StandardScaler(_Scaler):
    """(x - mean) / population deviation; a constant column is divided by 1."""

    def fit(self, df: DataFrame) -> "StandardScaler":
        row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.columns))).first()
        if row.m0 is None:
            raise ValueError("no rows")
        self.model = {c: (row[f"m{i}"], row[f"s{i}"] or 1.0, 1.0, 0.0) for i, c in enumerate(self.columns)}
        return self


class MinMaxScaler(_Scaler):
    """Onto [low, high]; a constant column goes to low."""

    def __init__(self, columns: Sequence[str], low: float = 0.0, high: float = 1.0):
        super().__init__(columns)
        self.low, self.high = low, high

    def fit(self, df: DataFrame) -> "MinMaxScaler":
        row = df.agg(*(F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(self.columns)), *(F.max(c).cast("double").alias(f"b{i}") for i, c in enumerate(self.columns))).first()
        if row.a0 is None:
            raise ValueError("no rows")
        self.model = {c: (row[f"a{i}"], (row[f"b{i}"] - row[f"a{i}"]) or 1.0, self.high - self.low, self.low) for i, c in enumerate(self.columns)}
        return self


class RobustScaler(_Scaler):
    """(x - median) / interquartile range, quartiles at trunc(p * (n - 1)); a column without a range stays as it is."""

    def __init__(self, columns: Sequence[str], low: float = 0.25, high: float = 0.75):
        super().__init__(columns)
        self.low, self.high = low, high

    def fit(self, df: DataFrame) -> "RobustScaler":
        self.model = {}
        for c in self.columns:
            n = df.filter(F.col(c).isNotNull()).count()
            if not n:
                raise ValueError("no rows")
            a, b, q1, q3 = order_statistics(df, c, [(n - 1) // 2, n // 2, int(self.low * (n - 1)), int(self.high * (n - 1))])
            self.model[c] = ((a + b) / 2, q3 - q1, 1.0, 0.0) if q3 != q1 else (0.0, 1.0, 1.0, 0.0)
        return self
