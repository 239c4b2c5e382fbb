"""Complex numbers as struct<re,im> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.quaternions import let


def complex_(re, im=0.0) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(c(re).alias("re"), c(im).alias("im"))


def add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def scale(a: Column, s) -> Column:
    return complex_(a["re"] * s, a["im"] * s)


def conj(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


def abs_(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def div(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return let(F.nullif(b["re"] * b["re"] + b["im"] * b["im"], F.lit(0.0)), lambda n: scale(mul(a, conj(b)), 1 / n))


def exp(a: Column) -> Column:
    return complex_(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def log(a: Column) -> Column:
    return complex_(F.ln(abs_(a)), arg(a))


def sqrt(a: Column) -> Column:
    """Principal root; 0 for 0."""
    return F.when((a["re"] == 0) & (a["im"] == 0), complex_(0)).otherwise(let(scale(log(a), 0.5), exp))


def sin(a: Column) -> Column:
    return complex_(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def cos(a: Column) -> Column:
    return complex_(F.cos(a["re"]) * F.cosh(a["im"]), -F.sin(a["re"]) * F.sinh(a["im"]))


def sinh(a: Column) -> Column:
    return complex_(F.sinh(a["re"]) * F.cos(a["im"]), F.cosh(a["re"]) * F.sin(a["im"]))


def cosh(a: Column) -> Column:
    return complex_(F.cosh(a["re"]) * F.cos(a["im"]), F.sinh(a["re"]) * F.sin(a["im"]))


def power(z: Column, w: Column) -> Column:
    """exp(w log z); 0 to the 0 is 1, 0 to a power with a negative real part infinite, to others 0."""
    zero = F.when((w["re"] == 0) & (w["im"] == 0), complex_(1)).when(w["re"] < 0, complex_(float("inf"))).otherwise(complex_(0))
    return F.when((z["re"] == 0) & (z["im"] == 0), zero).otherwise(let(let(log(z), lambda v: mul(w, v)), exp))
