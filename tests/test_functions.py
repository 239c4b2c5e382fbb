"""Scalar function families against numbers known from elsewhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.core import NotConverged, ieee_div
from tessera.functions import complexes as cx
from tessera.functions import constants, easings, noise, numerics, scalars, special
from tessera.functions import polynomials as po
from tessera.functions import quaternions as qt


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_special_values():
    s = special
    assert s.gamma([5.0, 0.5, -1.0]).tolist()[:2] == pytest.approx([24, math.sqrt(math.pi)]) and np.isnan(s.gamma(-1.0)) and np.isinf(s.gamma(0.0))
    known = {"erf": (1.0, 0.8427007929497149), "j0": (1.0, 0.76519768655796655), "j1": (1.0, 0.44005058574493352), "y0": (1.0, 0.08825696421567697), "y1": (1.0, -0.7812128213002887), "i0": (1.0, 1.2660658777520082), "i1": (1.0, 0.5651591039924851), "k0": (1.0, 0.42102443824070834), "k1": (2.0, 0.13986588181652243), "digamma": (1.0, -0.5772156649015329), "erfcx": (30.0, 0.018795888861416751)}
    for name, (x, want) in known.items():
        assert float(s.UNARY[name](x)) == pytest.approx(want, abs=1e-10), name
    assert float(s.jn(2, 1.0)) == pytest.approx(0.1149034849319005) and float(s.kn(3, 2.0)) == pytest.approx(0.6473853909486341) and float(s.yn(2, 1.0)) == pytest.approx(-1.6506826068162543) and float(s.in_(2, 1.0)) == pytest.approx(0.13574766976703828)
    assert float(s.beta(2.0, 3.0)) == pytest.approx(1 / 12) and float(s.binomial(5.0, 2.0)) == 10 and float(s.binomial(5.5, 2.0)) == pytest.approx(12.375)
    assert np.exp(s.clog_gamma(5 + 0j)) == pytest.approx(24) and s.cgamma(1j) == pytest.approx(-0.15494982830181069 - 0.49801566811835604j)


def test_special_columns(spark):
    row = one(spark, a=special.column("gamma", F.lit(5.0)), n=special.column("erf", F.lit(None).cast("double")), j=special.column("jn", F.lit(1.0), 2))
    assert row.a == 24 and row.n is None and row.j == pytest.approx(0.1149034849319005)


def test_easings_meet_their_ends(spark):
    for t in (0.0, 1.0):
        row = one(spark, **{k: f(F.lit(t)) for k, f in easings.CURVES.items()})
        assert all(v == pytest.approx(t, abs=1e-9) for v in row), row


def test_division_and_numbers(spark):
    row = one(spark, inf=ieee_div(F.lit(1.0), F.lit(0.0)), neg=ieee_div(F.lit(-1.0), F.lit(0.0)), nan=ieee_div(F.lit(0.0), F.lit(0.0)), fine=ieee_div(F.lit(1.0), F.lit(4.0)))
    assert row.inf == math.inf and row.neg == -math.inf and math.isnan(row.nan) and row.fine == 0.25
    row = one(spark, c=scalars.choose(F.lit(5), F.lit(2)), f=scalars.fibonacci(F.lit(10)), p=scalars.is_prime(F.lit(97)), q=scalars.is_prime(F.lit(91)), ch=scalars.chebyshev(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(0.5)), s=scalars.softplus(F.lit(800.0)), e=scalars.approx_equal_rel(F.lit(1.0), F.lit(1.0001), 1e-3))
    assert tuple(row) == (10, 55, True, False, pytest.approx(1 + 1 - 1.5), 800, True)


def test_polynomials(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    c = arr(1, -2, 1)
    row = one(spark, d=po.evaluate_derivatives(c, F.lit(2.0), 3), m=po.multiply(arr(1, 1), arr(1, -1)), a=po.add(arr(1), arr(1, 2)), two=po.solve_quadratic(F.lit(1.0), F.lit(-3.0), F.lit(2.0)), none=po.solve_quadratic(F.lit(1.0), F.lit(0.0), F.lit(1.0)), line=po.solve_quadratic(F.lit(0.0), F.lit(2.0), F.lit(-4.0)), three=po.solve_cubic(F.lit(1.0), F.lit(-6.0), F.lit(11.0), F.lit(-6.0)), one=po.solve_cubic(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-8.0)), odd=po.sum_odd(c), even=po.sum_even(c), deg=po.degree(c), crit=po.cubic_critical(arr(0, -3, 0, 1)), opt=po.quadratic_optimum(c))
    assert row.d == [1, 2, 2] and row.m == [1, 0, -1] and row.a == [2, 2] and row.two == [1, 2] and row.none == [] and row.line == [2] and row.three == pytest.approx([1, 2, 3]) and row.one == pytest.approx([2])
    assert (row.odd, row.even, row.deg) == (-2, 2, 2) and (row.crit.xmin, row.crit.xmax, row.crit.xifl) == pytest.approx((1, -1, 0)) and tuple(row.opt) == (1, 0)
    assert po.fit_points([0, 1, 2, 3], [1, 2, 9, 28]) == pytest.approx([1, 0, 0, 1], abs=1e-9)
    with pytest.raises(ZeroDivisionError):
        po.fit_points([1, 1], [0, 1])


def test_quaternions(spark):
    i, j = qt.quaternion(0, 1, 0, 0), qt.quaternion(0, 0, 1, 0)
    q = qt.quaternion(1, 2, 3, 4)
    axis = qt.from_axis_angle(F.lit(math.pi / 2), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    row = one(spark, k=qt.mul(i, j), n=qt.norm(q), inv=qt.mul(q, qt.inverse(q)), sd=qt.scalar_div(q, F.lit(30.0)), ss=qt.scalar_sub(q, 5.0), zero=qt.scalar_pow(q, F.lit(0.0)), back=qt.exp(qt.log(q)), root=qt.mul(qt.sqrt(q), qt.sqrt(q)), rot=qt.rotate_vector(axis, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))), mat=qt.from_matrix(qt.to_matrix(axis)), half=qt.slerp(qt.identity(), axis, F.lit(0.5)), nz=qt.is_zero(qt.quaternion(float("nan"), 1, 1, 1)), less=qt.is_less(i, q), ang=qt.angle(axis), par=qt.parity_antisymmetric_part(q, "x"), dist=qt.rotation_intrinsic_distance(axis, qt.opposite(axis)))
    assert tuple(row.k) == (0, 0, 0, 1) and row.n == 30 and tuple(row.inv) == pytest.approx((1, 0, 0, 0)) and tuple(row.sd) == (1, -2, -3, -4) and row.ss.w == 4 and tuple(row.zero) == (0, 0, 0, 0)
    assert tuple(row.back) == pytest.approx((1, 2, 3, 4)) and tuple(row.root) == pytest.approx((1, 2, 3, 4)) and tuple(row.rot) == pytest.approx((0, 1, 0), abs=1e-12)
    assert tuple(row.mat) == pytest.approx((math.sqrt(0.5), 0, 0, math.sqrt(0.5))) and tuple(row.half) == pytest.approx((math.cos(math.pi / 8), 0, 0, math.sin(math.pi / 8)))
    assert row.nz and row.less and row.ang == pytest.approx(math.pi / 2) and tuple(row.par) == (0, 0, 3, 4) and row.dist == pytest.approx(0, abs=1e-9)


def test_complex(spark):
    z, w = cx.complex_(1.0, 2.0), cx.complex_(-3.0, 0.5)
    row = one(spark, d=cx.div(z, w), r=cx.mul(cx.sqrt(z), cx.sqrt(z)), s=cx.sin(z), c=cx.cosh(z), p=cx.power(z, w), one=cx.power(cx.complex_(0), cx.complex_(0)), l=cx.log(z))
    import cmath

    a, b = 1 + 2j, -3 + 0.5j
    for got, want in ((row.d, a / b), (row.r, a), (row.s, cmath.sin(a)), (row.c, cmath.cosh(a)), (row.p, a**b), (row.one, 1), (row.l, cmath.log(a))):
        assert complex(got.re, got.im) == pytest.approx(want)


def test_roots_and_derivatives():
    f, df = lambda x: x**3 - x - 2, lambda x: 3 * x * x - 1
    root = 1.5213797068045676
    assert all(r == pytest.approx(root, abs=1e-9) for r in (numerics.bisection(f, 1, 2), numerics.brent(f, 1, 2), numerics.newton(f, df, 2.0), numerics.newton_bisection(f, df, 1, 2)))
    with pytest.raises(NotConverged):
        numerics.bisection(f, 2, 3)
    for d in (numerics.central, numerics.forward, numerics.backward):
        value, error = d(math.exp, 1.0, 1e-3)
        assert value == pytest.approx(math.e, abs=1e-6) and error < 1e-4
    assert numerics.diff_central(math.sin, 0.3)[0] == pytest.approx(math.cos(0.3), abs=1e-7) and numerics.partial(lambda x: x[0] * x[1] ** 2, [2.0, 3.0], 1)[0] == pytest.approx(12, abs=1e-6)


def test_noise():
    p = noise.permutation()
    x = np.linspace(0, 20, 400)
    for f, n in ((noise.perlin, 2), (noise.perlin, 3), (noise.simplex, 2), (noise.simplex, 3)):
        v = f(p, *(x * (k + 1) * 0.37 for k in range(n)))
        assert np.isfinite(v).all() and np.abs(v).max() <= 1.3 and v.std() > 0.05
    assert (noise.perlin(p, np.arange(5.0), np.arange(5.0)) == 0).all() and (noise.permutation(5) == noise.permutation(5)).all()


def test_constants():
    assert constants.constant("speed_of_light", "cgs") == 29979245800.0 and constants.constant("mass_electron", "cgs") == pytest.approx(9.1093837015e-28) and constants.constant("kilo") == 1000
