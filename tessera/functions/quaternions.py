"""Quaternions as struct<w,x,y,z> columns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("w", "x", "y", "z")
EPS = 2.0**-52


_steps: ContextVar[list[Column] | None] = ContextVar("steps", default=None)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: as a column of its own inside `steps`, else by a lambda, which is interpreted."""
    kept = _steps.get()
    if kept is None:
        return F.get(F.transform(F.array(value), body), F.lit(0))
    kept.append(value)
    return body(F.col(f"_step{len(kept) - 1}"))


@contextmanager
def steps() -> Iterator[list[Column]]:
    """Inside, `let` puts its values into the list; `with_steps` adds them to the table. Not for use under a lambda."""
    kept: list[Column] = []
    token = _steps.set(kept)
    try:
        yield kept
    finally:
        _steps.reset(token)


def apart(c: Column) -> Column:
    """The same value by way of a lambda, which keeps its projection out of whole-stage code: of many columns that makes
    one method too long for the JIT compiler, while a projection of its own is split into small ones."""
    return F.get(F.transform(F.array(c), lambda v: v), F.lit(0))


def with_steps(df: DataFrame, kept: list[Column], key: str) -> DataFrame:
    """df with the values of `let`, in as many projections as they depend on each other. key: any cheap column."""
    levels: list[int] = []
    for value in kept:
        levels.append(1 + max((levels[int(i)] for i in re.findall(r"_step(\d+)", str(value))), default=-1))
    for level in range(max(levels, default=-1) + 1):
        df = df.withColumns({key: apart(F.col(key))} | {f"_step{i}": v for i, v in enumerate(kept) if levels[i] == level})
    return df


def quaternion(w, x, y, z) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(PARTS, (w, x, y, z))))


def _parts(q: Column) -> list[Column]:
    return [q[n] for n in PARTS]


def _each(q: Column, f) -> Column:
    return quaternion(*(f(c) for c in _parts(q)))


def _signed(q: Column, signs) -> Column:
    return quaternion(*(c * s if s else F.lit(0.0) for c, s in zip(_parts(q), signs)))


def identity() -> Column:
    return quaternion(1, 0, 0, 0)


def add(a: Column, b: Column) -> Column:
    return quaternion(*(x + y for x, y in zip(_parts(a), _parts(b))))


def sub(a: Column, b: Column) -> Column:
    return quaternion(*(x - y for x, y in zip(_parts(a), _parts(b))))


#: Hamilton product: for each part of the result, (sign, part of a, part of b).
_HAMILTON = [[(1, 0, 0), (-1, 1, 1), (-1, 2, 2), (-1, 3, 3)], [(1, 0, 1), (1, 1, 0), (1, 2, 3), (-1, 3, 2)], [(1, 0, 2), (-1, 1, 3), (1, 2, 0), (1, 3, 1)], [(1, 0, 3), (1, 1, 2), (-1, 2, 1), (1, 3, 0)]]


def mul(a: Column, b: Column) -> Column:
    p, q = _parts(a), _parts(b)
    return quaternion(*(sum((s * p[i] * q[j] for s, i, j in row), F.lit(0.0)) for row in _HAMILTON))


def conjugate(q: Column) -> Column:
    return _signed(q, (1, -1, -1, -1))


def opposite(q: Column) -> Column:
    return _signed(q, (-1, -1, -1, -1))


def dot(a: Column, b: Column) -> Column:
    return sum((x * y for x, y in zip(_parts(a), _parts(b))), F.lit(0.0))


def norm(q: Column) -> Column:
    """Squared magnitude."""
    return dot(q, q)


def magnitude(q: Column) -> Column:
    return F.sqrt(norm(q))


def scale(q: Column, s) -> Column:
    return _each(q, lambda c: c * s)


def scalar_add(q: Column, s) -> Column:
    return quaternion(q["w"] + s, q["x"], q["y"], q["z"])


def scalar_sub(q: Column, s) -> Column:
    """The scalar part becomes s - w."""
    return quaternion(s - q["w"], q["x"], q["y"], q["z"])


def scalar_div(q: Column, s) -> Column:
    """s / q."""
    return let(norm(q), lambda n: _each(conjugate(q), lambda c: s * c / n))


def inverse(q: Column) -> Column:
    return scalar_div(q, F.lit(1.0))


def div(a: Column, b: Column) -> Column:
    """a times the conjugate of b over the norm of b."""
    return let(F.struct(mul(a, conjugate(b)).alias("m"), norm(b).alias("n")), lambda v: _each(v["m"], lambda c: c / v["n"]))


def normalized(q: Column) -> Column:
    return let(magnitude(q), lambda m: F.when(m == 0, q).otherwise(_each(q, lambda c: c / F.nullif(m, F.lit(0.0)))))


def _vector(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def log(q: Column) -> Column:
    """Principal logarithm; of negative reals with i as direction."""

    def of(b: Column) -> Column:
        w = q["w"]
        real = F.when(w < 0, quaternion(F.when(F.abs(w + 1) > EPS, F.ln(-w)).otherwise(0.0), math.pi, 0, 0)).otherwise(quaternion(F.ln(w), 0, 0, 0))
        f = F.atan2(b, w) / F.nullif(b, F.lit(0.0))
        return F.when(b <= EPS * F.abs(w), real).otherwise(quaternion(F.ln(w * w + b * b) / 2, f * q["x"], f * q["y"], f * q["z"]))

    return let(_vector(q), of)


def exp(q: Column) -> Column:
    def of(v: Column) -> Column:
        e = F.exp(q["w"])
        s = e * F.sin(v) / F.nullif(v, F.lit(0.0))
        return F.when(v > EPS, quaternion(e * F.cos(v), s * q["x"], s * q["y"], s * q["z"])).otherwise(quaternion(e, 0, 0, 0))

    return let(_vector(q), of)


def is_nan(q: Column) -> Column:
    return F.isnan(q["w"]) | F.isnan(q["x"]) | F.isnan(q["y"]) | F.isnan(q["z"])


def is_zero(q: Column) -> Column:
    """All parts 0; a NaN counts as zero."""
    return is_nan(q) | ((q["w"] == 0) & (q["x"] == 0) & (q["y"] == 0) & (q["z"] == 0))


def is_inf(q: Column) -> Column:
    inf = float("inf")
    return (F.abs(q["w"]) == inf) | (F.abs(q["x"]) == inf) | (F.abs(q["y"]) == inf) | (F.abs(q["z"]) == inf)


def is_finite(q: Column) -> Column:
    return ~is_nan(q) & ~is_inf(q)


def is_identity(q: Column) -> Column:
    return (q["w"] == 1) & (q["x"] == 0) & (q["y"] == 0) & (q["z"] == 0)


def equal(a: Column, b: Column) -> Column:
    return ~is_nan(a) & ~is_nan(b) & (a["w"] == b["w"]) & (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])


def _ordered(a: Column, b: Column, test: Column) -> Column:
    return F.when(is_nan(a) | is_nan(b), False).otherwise(test)


def is_less(a: Column, b: Column) -> Column:
    """Lexicographic by w, x, y, z; false with a NaN."""
    return _ordered(a, b, a < b)


def is_greater(a: Column, b: Column) -> Column:
    return _ordered(a, b, a > b)


def is_less_equal(a: Column, b: Column) -> Column:
    return _ordered(a, b, a <= b)


def is_greater_equal(a: Column, b: Column) -> Column:
    return _ordered(a, b, a >= b)


def scalar_pow(q: Column, s: Column) -> Column:
    """exp(s log q); with s = 0 the identity for zero and zero for all else."""
    zero = F.when(is_zero(q), identity()).otherwise(quaternion(0, 0, 0, 0))
    return F.when(s == 0, zero).otherwise(let(let(log(q), lambda v: scale(v, s)), exp))


def power(q: Column, r: Column) -> Column:
    """exp(log(q) r); a zero base gives zero, or the identity for a zero exponent."""
    zero = F.when(is_zero(r), identity()).otherwise(quaternion(0, 0, 0, 0))
    return F.when(is_zero(q), zero).otherwise(let(let(log(q), lambda v: mul(v, r)), exp))


def sqrt(q: Column) -> Column:
    def of(m: Column) -> Column:
        u = 1 + q["w"] / m
        c = F.sqrt(m / (2 * F.nullif(u, F.lit(0.0))))
        return F.when(F.abs(u) < EPS * m, quaternion(0, 1, 0, 0)).otherwise(quaternion(u * c, q["x"] * c / m, q["y"] * c / m, q["z"] * c / m))

    return let(magnitude(q), of)


def angle(q: Column) -> Column:
    return 2 * let(log(q), magnitude)


def lerp(a: Column, b: Column, tau: Column) -> Column:
    return F.when(tau == 0, a).when(tau == 1, b).otherwise(quaternion(*((1 - tau) * x + tau * y for x, y in zip(_parts(a), _parts(b)))))


def nlerp(a: Column, b: Column, tau: Column) -> Column:
    return let(lerp(a, b, tau), normalized)


def rotor_chordal_distance(a: Column, b: Column) -> Column:
    return let(sub(a, b), magnitude)


def _near(a: Column, b: Column) -> Column:
    """b or its opposite, whichever is nearer to a."""
    return F.when(rotor_chordal_distance(a, b) <= math.sqrt(2), b).otherwise(opposite(b))


def slerp(a: Column, b: Column, tau: Column) -> Column:
    def of(v: Column) -> Column:
        return let(let(_near(v["a"], v["b"]), lambda c: div(c, v["a"])), lambda r: let(scalar_pow(r, v["t"]), lambda p: mul(p, v["a"])))

    return let(F.struct(a.alias("a"), b.alias("b"), tau.alias("t")), of)


def squad(q: Column, a: Column, b: Column, q1: Column, tau: Column) -> Column:
    """Spherical quadrangle from q to q1 with inner points a and b."""
    return let(slerp(q, q1, tau), lambda s: let(slerp(a, b, tau), lambda t: slerp(s, t, 2 * tau * (1 - tau))))


def rotate_vector(q: Column, v: Column) -> Column:
    """q v conj(q) of a struct<x,y,z>; q is taken as a unit."""
    r = let(mul(q, quaternion(0, v["x"], v["y"], v["z"])), lambda m: mul(m, conjugate(q)))
    return let(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))


def rotor_intrinsic_distance(a: Column, b: Column) -> Column:
    return let(div(a, b), angle)


def rotation_intrinsic_distance(a: Column, b: Column) -> Column:
    return let(_near(a, b), lambda c: rotor_intrinsic_distance(a, c))


def rotation_chordal_distance(a: Column, b: Column) -> Column:
    return let(_near(a, b), lambda c: rotor_chordal_distance(a, c))


#: Signs of the parts under the conjugate, symmetric and antisymmetric parts of each parity.
_PARITY = {"": ((1, 1, 1, 1), (1, 1, 1, 1), (0, 0, 0, 0)), "x": ((1, 1, -1, -1), (1, 1, 0, 0), (0, 0, 1, 1)), "y": ((1, -1, 1, -1), (1, 0, 1, 0), (0, 1, 0, 1)), "z": ((1, -1, -1, 1), (1, 0, 0, 1), (0, 1, 1, 0))}


def parity_conjugate(q: Column, axis: str = "") -> Column:
    return _signed(q, _PARITY[axis][0])


def parity_symmetric_part(q: Column, axis: str = "") -> Column:
    return _signed(q, _PARITY[axis][1])


def parity_antisymmetric_part(q: Column, axis: str = "") -> Column:
    return _signed(q, _PARITY[axis][2])


def from_axis_angle(radians: Column, x: Column, y: Column, z: Column) -> Column:
    s = F.sin(radians / 2)
    return let(quaternion(F.cos(radians / 2), x * s, y * s, z * s), normalized)


def from_spherical_coords(theta: Column, phi: Column) -> Column:
    a, b = theta / 2, phi / 2
    return quaternion(F.cos(b) * F.cos(a), -F.sin(b) * F.sin(a), F.sin(a) * F.cos(b), F.sin(b) * F.cos(a))


def from_euler_angles(alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rotations about z, y, z."""
    s, d, h = (alpha + gamma) / 2, (gamma - alpha) / 2, beta / 2
    return quaternion(F.cos(h) * F.cos(s), F.sin(h) * F.sin(d), F.sin(h) * F.cos(d), F.cos(h) * F.sin(s))


def from_matrix(m: Column) -> Column:
    """Of a rotation matrix, array<array<double>>, by its largest diagonal part."""
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    trace = at(0, 0) + at(1, 1) + at(2, 2)
    skew = [at(2, 1) - at(1, 2), at(0, 2) - at(2, 0), at(1, 0) - at(0, 1)]
    r = 2 * F.sqrt(F.greatest(trace + 1, F.lit(0.0)))
    out = F.when(trace > 0, quaternion(r / 4, *(s / F.nullif(r, F.lit(0.0)) for s in skew)))

    def largest(i: int) -> Column:
        s = 2 * F.sqrt(F.greatest(1 + 2 * at(i, i) - trace, F.lit(0.0)))
        safe = F.nullif(s, F.lit(0.0))
        return quaternion(skew[i] / safe, *(s / 4 if j == i else (at(i, j) + at(j, i)) / safe for j in range(3)))

    return out.when((at(0, 0) > at(1, 1)) & (at(0, 0) > at(2, 2)), largest(0)).when(at(1, 1) > at(2, 2), largest(1)).otherwise(largest(2))


def to_matrix(q: Column) -> Column:
    v = [q["x"], q["y"], q["z"]]
    cross = {(0, 1): (-1, 2), (1, 0): (1, 2), (0, 2): (1, 1), (2, 0): (-1, 1), (1, 2): (-1, 0), (2, 1): (1, 0)}

    def cell(i: int, j: int) -> Column:
        if i == j:
            a, b = (v[k] for k in range(3) if k != i)
            return 1 - 2 * (a * a + b * b)
        sign, k = cross[i, j]
        return 2 * (v[i] * v[j] + sign * q["w"] * v[k])

    return F.array(*(F.array(*(cell(i, j) for j in range(3))) for i in range(3)))


def to_text(q: Column) -> Column:
    return F.concat(q["w"].cast("string"), F.lit(" + "), q["x"].cast("string"), F.lit("i + "), q["y"].cast("string"), F.lit("j + "), q["z"].cast("string"), F.lit("k"))
