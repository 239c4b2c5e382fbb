"""Activations, small number theory, numeric comparisons and sinusoids as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(alpha * x)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))


def selu(x: Column) -> Column:
    return SELU_SCALE * elu(x, SELU_ALPHA)


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return x / 2 * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def softplus(x: Column) -> Column:
    """ln(1 + e^x), stable on both sides."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softsign(x: Column) -> Column:
    return x / (1 + F.abs(x))


ACTIVATIONS = {f.__name__: f for f in (sigmoid, logistic, relu, leaky_relu, elu, selu, gelu, tanh, softplus, softsign)}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Of an array, shifted by its largest element."""

    def scaled(e: Column) -> Column:
        return _let(_sum(e), lambda z: F.transform(e, lambda x: x / z))

    return _let(a, lambda v: _let(F.array_max(v), lambda m: _let(F.transform(v, lambda x: F.exp(x - m)), scaled)))


def layernorm(a: Column, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + epsilon) of an array."""

    def scaled(d: Column) -> Column:
        spread = F.sqrt(_sum(F.transform(d, lambda x: x * x)) / F.size(d) + epsilon)
        return _let(spread, lambda s: F.transform(d, lambda x: x / s))

    return _let(a, lambda v: _let(_sum(v) / F.size(v), lambda m: _let(F.transform(v, lambda x: x - m), scaled)))


def hypot(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double; k outside 0..n is an error."""
    bad = F.raise_error(F.lit("k must be within 0..n")).cast("double")
    m = F.least(k, n - k).cast("int")
    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.when((k < 0) | (k > n), bad).otherwise(F.round(F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - m + i) / i)))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number as a long, n up to 92."""
    pair = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, _: F.struct(s["b"].alias("a"), F.try_add(s["a"], s["b"]).alias("b")))
    return pair["a"]


def is_prime(n: Column) -> Column:
    """Trial division up to the square root."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return (n >= 2) & ((n < 4) | ~F.exists(F.when(n >= 4, F.sequence(F.lit(2).cast("long"), root)).otherwise(F.array().cast("array<bigint>")), lambda d: n % d == 0))


def eps() -> float:
    return 2.0**-52


def approx_equal_abs(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= tol


def approx_equal_rel(a: Column, b: Column, rel: float, tol: float = 0.0) -> Column:
    d = F.abs(a - b)
    return (d <= tol) | (d <= rel * F.greatest(F.abs(a), F.abs(b)))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def check_index(i: Column, length: Column) -> Column:
    """The index, or an error outside 0..length-1."""
    return F.when((i >= 0) & (i < length), i).otherwise(F.raise_error(F.lit("index out of bounds")).cast("long"))


def check_same_length(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("lengths differ")).cast("boolean"))


def sinusoid(t: Column, amplitude: float, frequency: float, phase: float, offset: float) -> Column:
    return amplitude * F.sin(2 * math.pi * frequency * t + phase) + offset


def sinusoid_essential(t: Column, period: float, mean: float, amplitude: float, phase: float) -> Column:
    """mean + amplitude cos(2 pi t / period + phase)."""
    return mean + amplitude * F.cos(t * (2 * math.pi / period) + phase)


def sinusoid_basis(t: Column, period: float, mean: float, a1: float, b1: float) -> Column:
    """mean + a1 cos + b1 sin of the base frequency."""
    w = t * (2 * math.pi / period)
    return mean + a1 * F.cos(w) + b1 * F.sin(w)


def essential_of_basis(a1: float, b1: float) -> tuple[float, float]:
    """(amplitude, phase) of the essential form."""
    return math.hypot(a1, b1), math.atan2(-b1, a1)


def chebyshev(c: Column | list[Column], x: Column) -> Column:
    """Clenshaw's sum of a coefficient array (or list of columns) on [-1, 1], the first coefficient whole."""
    if isinstance(c, list):
        a = b = F.lit(0.0)
        for k in reversed(c[1:]):
            a, b = 2 * x * a - b + k, a
        return x * a - b + c[0]
    s = F.aggregate(F.reverse(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, k: F.struct((2 * x * s["a"] - s["b"] + k).alias("a"), s["a"].alias("b")))
    return x * s["a"] - s["b"] + F.get(c, F.lit(0))
