"""Label, ordinal and one-hot encoders numbering categories by first appearance, which a row id defines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import NotFitted, row_index

#: Vocabularies of at most this many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def vocabulary(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(category, code): codes from 0 in the order of the least row id. Nulls have none."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.min(row_id).alias("_first"))
    return row_index(first, "_first", "code").select("category", "code")


class OrdinalEncoder:
    """Codes of one or more columns; an unseen category or code is an error."""

    def __init__(self, columns: Sequence[str], row_id: str):
        if not columns:
            raise ValueError("at least one column is needed")
        self.columns, self.row_id, self.vocabularies, self.sizes = list(columns), row_id, None, {}

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        self.vocabularies = {c: vocabulary(df, c, self.row_id).cache() for c in self.columns}
        self.sizes = {c: v.count() for c, v in self.vocabularies.items()}
        return self

    def _known(self) -> dict[str, DataFrame]:
        if self.vocabularies is None:
            raise NotFitted("fit comes first")
        return {c: F.broadcast(v) if self.sizes[c] <= BROADCAST_ROWS else v for c, v in self.vocabularies.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns replaced by their codes."""
        for c, v in self._known().items():
            codes = v.select(F.col("category").alias(c), F.col("code").alias("_code"))
            unseen = F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("long")
            df = df.join(codes, c, "left").withColumn(c, F.coalesce("_code", unseen)).drop("_code").select(df.columns)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for c, v in self._known().items():
            names = v.select(F.col("code").alias(c), F.col("category").alias("_name"))
            bad = F.raise_error(F.concat(F.lit(f"no such code in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
            df = df.join(names, c, "left").withColumn(c, F.coalesce("_name", bad)).drop("_name").select(df.columns)
        return df


class LabelEncoder(OrdinalEncoder):
    """An ordinal encoder of one column."""

    def __init__(self, column: str, row_id: str):
        super().__init__([column], row_id)


class OneHotEncoder(OrdinalEncoder):
    """0/1 blocks of all columns, one after the other, as an array column; no category is dropped."""

    def transform(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        coded = super().transform(df.withColumns({f"_c_{c}": F.col(c) for c in self.columns}))
        blocks = [one_hot(F.col(c), self.sizes[c]) for c in self.columns]
        coded = coded.withColumn(out, F.concat(*blocks))
        return coded.withColumns({c: F.col(f"_c_{c}") for c in self.columns}).drop(*(f"_c_{c}" for c in self.columns))

    def fit_transform(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        return self.fit(df).transform(df, out)

    def inverse_transform(self, df: DataFrame, encoded: str = "onehot") -> DataFrame:
        """The categories of an array column: the first largest value of each block."""
        if self.vocabularies is None:
            raise NotFitted("fit comes first")
        at, codes = 1, {}
        for c in self.columns:
            block = F.slice(encoded, at, self.sizes[c])
            codes[c] = (F.array_position(block, F.array_max(block)) - 1).cast("long")
            at += self.sizes[c]
        return super().inverse_transform(df.withColumns(codes))


def one_hot(code: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0))
