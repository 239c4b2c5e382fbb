"""Polynomials as arrays of ascending coefficients, real roots of low degree, cubic and quadratic interpolation.

Where the number of coefficients is known, a list of columns does for an array: its sums are written out, so they are
compiled, while the lambdas of arrays are interpreted.
"""

from __future__ import annotations

import math
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.quaternions import let


def _some(c: list[Column]) -> list[Column]:
    if not c:
        raise ValueError("no coefficients")
    return c


def evaluate(c: Column | list[Column], x: Column) -> Column:
    """Horner's rule."""
    if isinstance(c, list):
        out = F.lit(0.0)
        for k in reversed(_some(c)):
            out = out * x + k
        return out
    return F.when(F.size(c) > 0, F.aggregate(F.reverse(c), F.lit(0.0), lambda s, k: s * x + k)).otherwise(F.raise_error(F.lit("no coefficients")).cast("double"))


def derivative(c: Column) -> Column:
    return F.when(F.size(c) > 1, F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), lambda k, i: k * (i + 1))).otherwise(F.array(F.lit(0.0)))


def evaluate_derivatives(c: Column, x: Column, count: int) -> Column:
    """Array of the value and the derivatives up to count - 1."""
    out, d = [], c
    for _ in range(count):
        out.append(evaluate(d, x))
        d = derivative(d)
    return F.array(*out)


def _padded(a, b, f):
    if isinstance(a, list):
        return [f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))) for x, y in zip_longest(a, b, fillvalue=F.lit(0.0))]
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def add(a, b):
    return _padded(a, b, lambda x, y: x + y)


def subtract(a, b):
    return _padded(a, b, lambda x, y: x - y)


def multiply(a, b):
    """Convolution of the coefficients; an empty side is an error."""
    if isinstance(a, list):
        return [sum((x * b[k - i] for i, x in enumerate(_some(a)) if 0 <= k - i < len(b)), F.lit(0.0)) for k in range(len(a) + len(_some(b)) - 1)]
    last = F.size(a) + F.size(b) - 2

    def cell(k: Column) -> Column:
        terms = F.transform(a, lambda x, i: F.when((k - i >= 0) & (k - i < F.size(b)), x * F.get(b, k - i)).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), cell)).otherwise(F.raise_error(F.lit("no coefficients")).cast("array<double>"))


def degree(c: Column | list[Column]) -> Column:
    if isinstance(c, list):
        return F.lit(len(_some(c)) - 1)
    return F.when(F.size(c) > 0, F.size(c) - 1).otherwise(F.raise_error(F.lit("no coefficients")).cast("int"))


def sum_odd(c: Column | list[Column]) -> Column:
    if isinstance(c, list):
        return sum(c[1::2], F.lit(0.0))
    return F.aggregate(F.filter(c, lambda _, i: i % 2 == 1), F.lit(0.0), lambda s, k: s + k)


def sum_even(c: Column | list[Column]) -> Column:
    if isinstance(c, list):
        return sum(c[0::2], F.lit(0.0))
    return F.aggregate(F.filter(c, lambda _, i: i % 2 == 0), F.lit(0.0), lambda s, k: s + k)



def solve_quadratic(a: Column, b: Column, c: Column) -> Column:
    """Real roots of a x^2 + b x + c, ascending; a double root twice, a linear equation's once, none without."""
    none = F.array().cast("array<double>")
    line = F.when(b == 0, none).otherwise(F.array(-c / F.nullif(b, F.lit(0.0))))

    def roots(d: Column) -> Column:
        q = -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(d, F.lit(0.0)))) / 2
        both = F.sort_array(F.array(q / F.nullif(a, F.lit(0.0)), F.when(q == 0, 0.0).otherwise(c / F.nullif(q, F.lit(0.0)))))
        half = -b / (2 * F.nullif(a, F.lit(0.0)))
        return F.when(d < 0, none).when(d == 0, F.array(half, half)).otherwise(both)

    return F.when(a == 0, line).otherwise(let(b * b - 4 * a * c, roots))


def solve_cubic(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Real roots of a x^3 + b x^2 + c x + d, ascending; one if the others are complex."""
    n = F.nullif(a, F.lit(0.0))
    shift = b / (3 * n)
    depressed = F.struct((c / n - b * b / (3 * n * n)).alias("p"), (2 * b * b * b / (27 * n * n * n) - b * c / (3 * n * n) + d / n).alias("q"), shift.alias("s"))

    def roots(v: Column) -> Column:
        p, q, s = v["p"], v["q"], v["s"]
        disc = q * q / 4 + p * p * p / 27
        r = F.sqrt(F.greatest(disc, F.lit(0.0)))
        one = F.array(F.cbrt(-q / 2 + r) + F.cbrt(-q / 2 - r) - s)
        m = 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0)))
        turn = F.acos(F.least(F.greatest(3 * q / F.nullif(p * m, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))) / 3
        three = F.sort_array(F.array(*(m * F.cos(turn - 2 * math.pi * k / 3) - s for k in range(3))))
        return F.when((p == 0) & (q == 0), F.array(-s, -s, -s)).when(disc > 0, one).otherwise(three)

    return F.when(a == 0, solve_quadratic(b, c, d)).otherwise(let(depressed, roots))


def fit_points(xs: list[float], ys: list[float], slope_at: float | None = None, slope: float = 0.0) -> list[float]:
    """Ascending coefficients of the polynomial through the points and, on request, with a slope at another place."""
    import numpy as np

    n = len(xs) + (slope_at is not None)
    rows = [[x**k for k in range(n)] for x in xs]
    right = list(ys)
    if slope_at is not None:
        rows.append([k * slope_at ** (k - 1) if k else 0.0 for k in range(n)])
        right.append(slope)
    m = np.array(rows, float)
    if abs(np.linalg.det(m)) < 1e-15:
        raise ZeroDivisionError("degenerate points")
    return np.linalg.solve(m, np.array(right, float)).tolist()


def cubic_critical(c: Column | list[Column]) -> Column:
    """struct xmin, xmax, xifl, has_min, has_max, has_ifl of a cubic's coefficients; null where there is none."""
    a, b, g = c[3:0:-1] if isinstance(c, list) else (F.get(c, F.lit(3)), F.get(c, F.lit(2)), F.get(c, F.lit(1)))
    roots = solve_quadratic(3 * a, 2 * b, g)

    def of(r: Column) -> Column:
        at = lambda test: F.get(F.filter(r, test), F.lit(0))
        low, high = at(lambda x: 6 * a * x + 2 * b > 0), at(lambda x: 6 * a * x + 2 * b < 0)
        ifl = -b / F.nullif(3 * a, F.lit(0.0))
        return F.struct(low.alias("xmin"), high.alias("xmax"), ifl.alias("xifl"), low.isNotNull().alias("has_min"), high.isNotNull().alias("has_max"), ifl.isNotNull().alias("has_ifl"))

    return let(roots, of)


def quadratic_optimum(c: Column | list[Column]) -> Column:
    """struct xopt, fopt of a quadratic's vertex; an error without a square term."""
    a, b = c[2:0:-1] if isinstance(c, list) else (F.get(c, F.lit(2)), F.get(c, F.lit(1)))
    x = F.when(F.abs(a) < 1e-15, F.raise_error(F.lit("no square term")).cast("double")).otherwise(-b / (2 * F.nullif(a, F.lit(0.0))))
    return let(x, lambda v: F.struct(v.alias("xopt"), evaluate(c, v).alias("fopt")))
