"""Fourier transforms of (series, i, val) tables or arrays, and piecewise linear interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_power_of_2(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def _check(n: int) -> None:
    if n < 2 or n & (n - 1):
        raise ValueError("the length must be a power of two of at least 2")


def _transform(real: Column, imag: Column | None, inverse: bool, normalize: bool) -> Column:
    """Arrays of one length at a time, on Arrow's buffers: no Python object per bin."""

    @F.arrow_udf("array<struct<re:double,im:double>>")
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(re), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes_im = pc.fill_null(pc.list_value_length(im), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = re.is_null().to_numpy(zero_copy_only=False)
        ends, ends_im = np.cumsum(sizes), np.cumsum(sizes_im)
        values, values_im = (_numbers(pc.list_flatten(c)) for c in (re, im))
        out = np.empty(int(sizes.sum()), complex)
        for n in np.unique(sizes[~none]):
            _check(int(n))
            rows = np.flatnonzero(~none & (sizes == n))
            at = (ends[rows] - n)[:, None] + np.arange(n)
            z = values[at].astype(complex)
            given = np.flatnonzero(sizes_im[rows])
            if (sizes_im[rows[given]] != n).any():
                raise ValueError("real and imaginary parts have different lengths")
            z[given] += 1j * values_im[(ends_im[rows[given]] - n)[:, None] + np.arange(n)]
            out[at] = np.fft.ifft(z) * (1 if normalize else n) if inverse else np.fft.fft(z)
        bins = pa.StructArray.from_arrays([pa.array(out.real), pa.array(out.imag)], ["re", "im"])
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), bins)

    return run(real, F.array().cast("array<double>") if imag is None else imag)


def _numbers(a: pa.Array) -> np.ndarray:
    return np.asarray(a.to_numpy(zero_copy_only=False), float)


def fft(real: Column) -> Column:
    """All bins of an array of reals, e^(-i theta)."""
    return _transform(real, None, False, False)


def fft_complex(z: Column) -> Column:
    return _transform(F.transform(z, lambda v: v["re"]), F.transform(z, lambda v: v["im"]), False, False)


def ifft(z: Column) -> Column:
    """Not divided by the length."""
    return _transform(F.transform(z, lambda v: v["re"]), F.transform(z, lambda v: v["im"]), True, False)


def ifft_normalized(z: Column) -> Column:
    """Real parts, divided by the length."""
    both = _transform(F.transform(z, lambda v: v["re"]), F.transform(z, lambda v: v["im"]), True, True)
    return F.transform(both, lambda v: v["re"])


def _rotated(a: Column, by: Column) -> Column:
    return F.concat(F.slice(a, by + 1, F.size(a) - by), F.slice(a, F.lit(1), by))


def fftshift(a: Column) -> Column:
    """Rotated left by half the length, rounded down."""
    return _rotated(a, F.floor(F.size(a) / 2).cast("int"))


def ifftshift(a: Column) -> Column:
    """Rotated left by half the length, rounded up."""
    return _rotated(a, F.floor((F.size(a) + 1) / 2).cast("int"))


def magnitude_spectrum(z: Column) -> Column:
    return F.transform(z, lambda v: F.hypot(v["re"], v["im"]))


def power_spectrum(z: Column) -> Column:
    return F.transform(z, lambda v: v["re"] * v["re"] + v["im"] * v["im"])


def series_array(df: DataFrame, series: str, order: str, value: str, out: str = "vals") -> DataFrame:
    """One array per series, in order."""
    return df.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda v: v[value].cast("double")).alias(out))


def dft_bins(df: DataFrame, series: str, order: str, value: str, bins: int) -> DataFrame:
    """(series, k, re, im) of the first bins of series of any length: sums of rows with partial aggregation, for series
    too long for one task. `order` is the 0-based position."""
    n = df.groupBy(series).agg(F.count("*").alias("_n"))
    turned = df.join(n, series).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    angle = F.col("k") * F.col(order) * (-2 * np.pi) / F.col("_n")
    return turned.groupBy(series, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))


def interpolate(queries: DataFrame, knots: DataFrame, x: str = "x", kx: str = "x", ky: str = "y", out: str = "y", group: str | None = None) -> DataFrame:
    """queries with `out`: piecewise linear between knots, clamped at both ends. Knots must have distinct x; they may be
    separate for each value of a column `group`.

    Knots become intervals, and queries meet them by a bucket of x, so the join is an equi-join whatever the sizes.
    """
    cols = [group] if group else []
    k = knots.select(*cols, F.col(kx).cast("double").alias("_a"), F.col(ky).cast("double").alias("_ya"))
    w = Window.partitionBy(*(cols or [F.lit(0)])).orderBy("_a")
    spans = k.withColumn("_b", F.lead("_a").over(w)).withColumn("_yb", F.lead("_ya").over(w)).withColumn("_first", F.lag("_a").over(w).isNull())
    ends = k.agg(F.min("_a").alias("lo"), F.max("_a").alias("hi"), F.count("*").alias("n")).first()
    if not ends.n:
        raise ValueError("no knots")
    buckets = int(max(1, min(ends.n, 1 << 20)))
    width = (ends.hi - ends.lo) / buckets or 1.0
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((c - ends.lo) / width))).cast("long")
    low, high = F.when(F.col("_first"), F.lit(0)).otherwise(at(F.col("_a"))), F.coalesce(at(F.col("_b")), F.lit(buckets - 1))
    spread = spans.withColumn("_k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    q = queries.withColumn("_x", F.col(x).cast("double")).withColumn("_k", at(F.col("_x")))
    inside = (F.col("_first") | (F.col("_x") >= F.col("_a"))) & (F.col("_b").isNull() | (F.col("_x") < F.col("_b")))
    t = (F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    y = F.when(F.col("_b").isNull() | (F.col("_x") <= F.col("_a")), F.col("_ya")).otherwise(F.col("_ya") + t * (F.col("_yb") - F.col("_ya")))
    return q.join(spread, ["_k", *cols]).filter(inside).withColumn(out, y).select(*queries.columns, *([out] if out not in queries.columns else []))


def ohlc(df: DataFrame, ts: str, value: str, width: str) -> DataFrame:
    """(start, open, high, low, close, n) of time windows."""
    g = df.groupBy(F.window(ts, width).alias("w"))
    return g.agg(F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
