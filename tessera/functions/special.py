"""Gamma, error and Bessel functions as Arrow-batched functions, from quadratures and recurrences in numpy.

Bessel functions come from their integrals over a period, where the trapezoidal rule converges exponentially, from
Neumann's series, and, for the K family, from a doubly exponential integrand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def _each(f, *xs) -> np.ndarray:
    return np.array([f(*v) for v in zip(*(np.broadcast_to(np.asarray(x, float), np.broadcast(*xs).shape).ravel() for x in xs))], float).reshape(np.broadcast(*xs).shape)


def _gamma(x: float) -> float:
    if x == 0:
        return math.copysign(math.inf, x)
    if x != x or x == -math.inf or (x < 0 and x == math.floor(x)):
        return math.nan
    try:
        return math.gamma(x)
    except OverflowError:
        return math.inf


def _log_gamma(x: float) -> float:
    if x != x:
        return math.nan
    if x <= 0 and x == math.floor(x):
        return math.inf
    return math.lgamma(x)


def gamma(x) -> np.ndarray:
    """Infinite at 0, NaN at negative whole numbers."""
    return _each(_gamma, x)


def log_gamma(x) -> np.ndarray:
    return _each(_log_gamma, x)


def factorial(n) -> np.ndarray:
    return gamma(np.asarray(n, float) + 1)


def ln_factorial(n) -> np.ndarray:
    return log_gamma(np.asarray(n, float) + 1)


def digamma(x) -> np.ndarray:
    """Infinite at 0 and negative whole numbers; shifted up to 8 and expanded there, reflected below 0."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        neg = x < 0
        y = np.where(neg, 1 - x, x)
        shift = np.zeros_like(y)
        for _ in range(8):
            low = y < 8
            shift = shift - np.where(low, 1 / y, 0)
            y = np.where(low, y + 1, y)
        r = 1 / (y * y)
        tail = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760 - r / 12))))))
        out = np.log(y) - 0.5 / y - tail + shift
        out = np.where(neg, out - np.pi / np.tan(np.pi * x), out)
        return np.where((x <= 0) & (x == np.floor(x)), np.inf, out)


def erf(x) -> np.ndarray:
    return _each(math.erf, x)


def erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _erfcx(x: float) -> float:
    if x < 25:
        return math.inf if x < -26.6 else math.exp(x * x) * math.erfc(x)
    f = 0.0
    for k in range(60, 0, -1):
        f = k / 2 / (x + f)
    return 1 / (math.sqrt(math.pi) * (x + f))


def erfcx(x) -> np.ndarray:
    """exp(x^2) erfc(x), by a continued fraction for large x."""
    return _each(_erfcx, x)


def _nodes(x: np.ndarray, n: int) -> np.ndarray:
    top = float(np.nanmax(np.abs(np.where(np.isfinite(x), x, 0)), initial=0))
    return np.arange(int(top * 1.2 + n + 64)) * (2 * np.pi / int(top * 1.2 + n + 64))


def jn(n: int, x) -> np.ndarray:
    """J of order n: mean of cos(n t - x sin t) over a period."""
    x = np.asarray(x, float)
    t = _nodes(x, 2 * abs(n))
    out = np.cos(n * t - np.where(np.isfinite(x), x, 0)[..., None] * np.sin(t)).mean(-1)
    return np.where(np.isnan(x), np.nan, np.where(np.isinf(x), 0.0, out))


def j0(x) -> np.ndarray:
    return jn(0, x)


def j1(x) -> np.ndarray:
    return jn(1, x)


def _orders(x: np.ndarray) -> int:
    return int(np.nanmax(np.where(np.isfinite(x), x, 0), initial=1) / 2 + 24)


def y0(x) -> np.ndarray:
    """Neumann's series in even J; -infinite at 0, NaN below."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        s = sum((-1) ** k * jn(2 * k, x) / k for k in range(1, _orders(x)))
        out = 2 / np.pi * (np.log(x / 2) + EULER) * j0(x) - 4 / np.pi * s
        return np.where(x < 0, np.nan, np.where(x == 0, -np.inf, out))


def y1(x) -> np.ndarray:
    """The derivative of the series of Y0 with the sign changed."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        s = sum((-1) ** k * (jn(2 * k - 1, x) - jn(2 * k + 1, x)) / (2 * k) for k in range(1, _orders(x)))
        out = -(2 / np.pi * (j0(x) / x - (np.log(x / 2) + EULER) * j1(x)) - 4 / np.pi * s)
        return np.where(x < 0, np.nan, np.where(x == 0, -np.inf, out))


def _upward(n: int, x, a, b, sign: int) -> np.ndarray:
    """f(k+1) = 2k/x f(k) + sign f(k-1)."""
    with np.errstate(all="ignore"):
        for k in range(1, n):
            a, b = b, 2 * k / x * b + sign * a
    return a if n == 0 else b


def yn(n: int, x) -> np.ndarray:
    x = np.asarray(x, float)
    out = _upward(abs(n), x, y0(x), y1(x), -1)
    out = np.where(x == 0, -np.inf, out)
    return -out if n < 0 and n % 2 else out


def in_(n: int, x) -> np.ndarray:
    """I of order n >= 0: mean of exp(x cos t) cos(n t) over a period."""
    if n < 0:
        raise ValueError("n must not be negative")
    x = np.asarray(x, float)
    t = _nodes(x, 2 * n)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.exp(np.abs(x)) * (np.exp(x[..., None] * np.cos(t) - np.abs(x)[..., None]) * np.cos(n * t)).mean(-1)


def i0(x) -> np.ndarray:
    return in_(0, x)


def i1(x) -> np.ndarray:
    return in_(1, x)


def kn(n: int, x) -> np.ndarray:
    """K of order n: the integral of exp(-x cosh t) cosh(n t); infinite at 0, NaN below."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        y = np.where(x > 0, x, 1.0)
        end = np.arccosh(1 + (750 + 40 * abs(n)) / y)
        t = np.linspace(0, 1, 1201) * end[..., None]
        f = np.exp(np.clip(-y[..., None] * np.cosh(t), -745, 0)) * np.cosh(n * t)
        out = (f.sum(-1) - f[..., 0] / 2 - f[..., -1] / 2) * end / 1200
        return np.where(x < 0, np.nan, np.where(x == 0, np.inf, out))


def k0(x) -> np.ndarray:
    return kn(0, x)


def k1(x) -> np.ndarray:
    return kn(1, x)


def clog_gamma(z) -> np.ndarray:
    """Complex log gamma: reflection below 1/2, shift up to 7 and Stirling's expansion."""
    z = np.asarray(z, complex)
    with np.errstate(all="ignore"):
        low = z.real < 0.5
        w = np.where(low, 1 - z, z)
        shift = np.zeros_like(w)
        for _ in range(8):
            up = w.real < 7
            shift = shift - np.where(up, np.log(w), 0)
            w = np.where(up, w + 1, w)
        r = 1 / (w * w)
        series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / w
        out = (w - 0.5) * np.log(w) - w + 0.5 * np.log(2 * np.pi) + series + shift
        return np.where(low, np.log(np.pi) - np.log(np.sin(np.pi * z)) - out, out)


def cgamma(z) -> np.ndarray:
    return np.exp(clog_gamma(z))


def beta(a, b) -> np.ndarray:
    return np.exp(log_gamma(a) + log_gamma(b) - log_gamma(np.asarray(a, float) + np.asarray(b, float)))


def binomial(n, k) -> np.ndarray:
    """Exact for whole numbers up to 22, else by beta."""

    def one(n: float, k: float) -> float:
        if n == int(n) and k == int(k) and 0 <= k <= n <= 22:
            return float(math.comb(int(n), int(k)))
        return math.exp(-math.log(n + 1) - float(log_gamma(n - k + 1) + log_gamma(k + 1) - log_gamma(n + 2)))

    return _each(one, n, k)


UNARY = {f.__name__: f for f in (gamma, log_gamma, factorial, ln_factorial, digamma, erf, erfc, erfcx, j0, j1, y0, y1, i0, i1, k0, k1)}
ORDERED = {"jn": jn, "yn": yn, "in": in_, "kn": kn}


def column(name: str, x: Column, order: int | None = None) -> Column:
    """One of the functions above over a column; null stays null."""
    f = UNARY[name] if order is None else (lambda v: ORDERED[name](order, v))

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float, na_value=np.nan)
        return pd.Series(np.where(s.isna(), np.nan, f(v))) if len(s) else pd.Series([], dtype=float)

    return F.when(x.isNotNull(), apply(x.cast("double")))


def column2(name: str, a: Column, b: Column) -> Column:
    f = {"beta": beta, "binomial": binomial}[name]

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float))) if len(x) else pd.Series([], dtype=float)

    return apply(a.cast("double"), b.cast("double"))
