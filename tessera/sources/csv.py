"""CSV of numbers: comments, skipped rows, a header on request, column choice, a row limit; strict about numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import row_index

SPACE = " \t\n\r\x0b\x0c"


def _fields(line: Column, delimiter: str) -> Column:
    import re

    return F.transform(F.split(line, re.escape(delimiter)), lambda x: F.btrim(F.btrim(x, F.lit(SPACE)), F.lit("\"'")))


def parse_lines(lines: DataFrame, delimiter: str = ",", comment: str = "#", skip_rows: int = 0, skip_header: bool = False, use_cols: Sequence[int] | None = None, max_rows: int = -1) -> DataFrame:
    """(row, vals) of a table (n, value) of numbered lines: blank and comment lines go before rows are skipped; fields
    lose white space and quotes at their ends; a field that isn't a number is an error."""
    text = F.btrim("value", F.lit(SPACE))
    kept = lines.select("n", text.alias("value")).filter((F.col("value") != "") & ~F.startswith("value", F.lit(comment)))
    rows = row_index(kept, "n", "row").withColumn("row", F.col("row") - skip_rows - int(skip_header)).filter("row >= 0")
    if max_rows >= 0:
        rows = rows.filter(F.col("row") < max_rows)
    vals = F.transform(_fields(F.col("value"), delimiter), lambda x: x.cast("double"))
    if use_cols is not None:
        vals = F.array(*(F.get(vals, F.lit(c)) for c in use_cols))
    return rows.select("row", vals.alias("vals"))


def header_of(lines: DataFrame, delimiter: str = ",", comment: str = "#", skip_rows: int = 0) -> list[str]:
    text = F.btrim("value", F.lit(SPACE))
    kept = lines.select("n", text.alias("value")).filter((F.col("value") != "") & ~F.startswith("value", F.lit(comment)))
    rows = kept.orderBy("n").limit(skip_rows + 1).select(_fields(F.col("value"), delimiter).alias("f")).collect()
    if len(rows) <= skip_rows:
        raise ValueError("no header line")
    return rows[skip_rows].f


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value) of one text file: n grows with the place of a line in the file."""
    return spark.read.text(path).select((F.monotonically_increasing_id()).alias("n"), "value")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", comment: str = "#", skip_rows: int = 0, skip_header: bool = False, use_cols: Sequence[int] | None = None, max_rows: int = -1) -> DataFrame:
    """Columns named by the header, else c0, c1, ..., and `row`; a row of another width than the first is an error.

    The plain case goes to Spark's own reader with an explicit schema; comments with skipped rows and limits need the
    lines numbered first.
    """
    lines = numbered_lines(spark, path)
    names = header_of(lines, delimiter, comment, skip_rows) if skip_header else None
    parsed = parse_lines(lines, delimiter, comment, skip_rows, skip_header, use_cols, max_rows)
    first = parsed.filter("row = 0").select(F.size("vals").alias("k")).first()
    if first is None:
        raise ValueError("no rows")
    if names is None:
        names = [f"c{i}" for i in range(max(use_cols) + 1 if use_cols else first.k)]
    names = [names[c] for c in use_cols] if use_cols is not None else names
    fine = F.when(F.size("vals") == len(names), F.col("vals")).otherwise(F.raise_error(F.lit("rows of different widths")).cast("array<double>"))
    return parsed.select("row", fine.alias("vals")).select("row", *(F.get("vals", F.lit(i)).alias(c) for i, c in enumerate(names)))


def to_vectors(df: DataFrame, columns: Sequence[str], out: str = "vals") -> DataFrame:
    return df.select("row", F.array(*(F.col(c).cast("double") for c in columns)).alias(out))


def column_by_index(df: DataFrame, i: int) -> DataFrame:
    names = [c for c in df.columns if c != "row"]
    if not 0 <= i < len(names):
        raise IndexError("no such column")
    return df.select("row", names[i])


def column_by_name(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise IndexError("no such column")
    return df.select("row", name)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], header: bool = True, delimiter: str = ",") -> None:
    """Numbers with six decimals, NaN as NaN; a folder of parts, each with the header, as Spark writes them."""
    shown = [F.when(F.isnan(c), "NaN").otherwise(F.format_string("%.6f", F.col(c).cast("double"))).alias(c) for c in columns]
    df.select(*shown).write.mode("overwrite").csv(path, header=header, sep=delimiter, quote="")


def write_matrix_csv(df: DataFrame, path: str, vector: str, width: int, **more) -> None:
    names = [f"c{i}" for i in range(width)]
    write_csv(df.select(*(F.get(vector, F.lit(i)).alias(c) for i, c in enumerate(names))), path, names, **more)
