"""More registered queries: scalar functions, inverses, predictions, matrices and transforms, each with SQL of its own form.

A query has a column per function. Results of several parts (quaternions, complex numbers, arrays) are summed with the
weights 1, 2, 3, ..., so that every part counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.catalog import query, rounded, table
from tessera.functions import complexes, polynomials, quaternions, scalars
from tessera.operators import encoders, geometry, graph, matrix, models, scalers, signal
from tessera.sources import generators


def _columns(sql: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) + 0.0 AS {k}" for k, x in sql.items())


def _rounded(c: Column, digits: int) -> Column:
    """Half away from zero as C's round does it, which is what SQL's does; Spark's goes through decimals, a hundred times slower."""
    unit = 10.0**digits
    near = F.floor(F.abs(c) * unit + 0.5) / unit
    return F.when(F.abs(c) < 2.0**52 / unit, F.when(c < 0, -near).otherwise(near)).otherwise(c) + 0.0


def _lines(spark, sf_dir, columns: dict[str, Column], digits: int = 6, kept: Sequence[Column] = ()):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") / 50).alias("w"), F.col("l_discount").alias("x"), (F.col("l_tax") + 0.01).alias("y"))
    df = quaternions.with_steps(df, kept, "l_linenumber").select("l_orderkey", "l_linenumber", *(c.cast("double").alias(k) for k, c in columns.items()))
    return df.select("l_orderkey", quaternions.apart(F.col("l_linenumber")).alias("l_linenumber"), *(_rounded(F.col(k), digits).alias(k) for k in columns))


_LINES = "FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS w, l_discount AS x, l_tax + 0.01 AS y, 1.0::DOUBLE AS z, 0.5::DOUBLE AS a, 0.1::DOUBLE AS b, 0.2::DOUBLE AS c, 0.3::DOUBLE AS d FROM lineitem)"


# --- quaternions: q = (w, x, y, 1), p = (0.5, 0.1, 0.2, 0.3) ---------------------------------------------------------


def _q() -> tuple[Column, Column]:
    return quaternions.quaternion(F.col("w"), F.col("x"), F.col("y"), 1.0), quaternions.quaternion(0.5, 0.1, 0.2, 0.3)


def _mix(q: Column) -> Column:
    return q["w"] + 2 * q["x"] + 3 * q["y"] + 4 * q["z"]


def _mix_sql(w: str, x: str, y: str, z: str) -> str:
    return f"({w}) + 2 * ({x}) + 3 * ({y}) + 4 * ({z})"


def _times(p: str, q: str) -> tuple[str, ...]:
    """The Hamilton product of four letters by four, written out."""
    a, b, c, d = p
    e, f, g, h = q
    return f"{a}*{e}-{b}*{f}-{c}*{g}-{d}*{h}", f"{a}*{f}+{b}*{e}+{c}*{h}-{d}*{g}", f"{a}*{g}-{b}*{h}+{c}*{e}+{d}*{f}", f"{a}*{h}+{b}*{g}-{c}*{f}+{d}*{e}"


_N, _M = "(w*w+x*x+y*y+z*z)", "(a*a+b*b+c*c+d*d)"
_WITH_CONJ = _times("wxyz", "aBCD")
_OVER = [e.replace("*B", "*(-b)").replace("*C", "*(-c)").replace("*D", "*(-d)") for e in _WITH_CONJ]
_BOOLS = {"equal": "w=a AND x=b AND y=c AND z=d", "less": "(w,x,y,z)<(a,b,c,d)", "greater": "(w,x,y,z)>(a,b,c,d)", "less_equal": "(w,x,y,z)<=(a,b,c,d)", "greater_equal": "(w,x,y,z)>=(a,b,c,d)", "zero": "w=0 AND x=0 AND y=0 AND z=0", "is_one": "w=1 AND x=0 AND y=0 AND z=0", "nan": "isnan(w)", "inf": "isinf(w)", "finite": "isfinite(w)"}
_ALGEBRA = {
    "added": _mix_sql("w+a", "x+b", "y+c", "z+d"),
    "subtracted": _mix_sql("w-a", "x-b", "y-c", "z-d"),
    "divided": f"({_mix_sql(*_OVER)}) / {_M}",
    "scaled": _mix_sql("w*3", "x*3", "y*3", "z*3"),
    "plus_scalar": _mix_sql("w+3", "x", "y", "z"),
    "minus_scalar": _mix_sql("3-w", "x", "y", "z"),
    "scalar_over": f"3 * ({_mix_sql('w', '-x', '-y', '-z')}) / {_N}",
    "opposite": _mix_sql("-w", "-x", "-y", "-z"),
    "conjugate": _mix_sql("w", "-x", "-y", "-z"),
    "inverse": f"({_mix_sql('w', '-x', '-y', '-z')}) / {_N}",
    "normalized": f"({_mix_sql('w', 'x', 'y', 'z')}) / sqrt({_N})",
    "magnitude": f"sqrt({_N})",
    "dot": "w*a+x*b+y*c+z*d",
    "identity": "1",
    "lerp": _mix_sql("w*0.75+a*0.25", "x*0.75+b*0.25", "y*0.75+c*0.25", "z*0.75+d*0.25"),
    "nlerp": f"({_mix_sql('w*0.75+a*0.25', 'x*0.75+b*0.25', 'y*0.75+c*0.25', 'z*0.75+d*0.25')}) / sqrt((w*0.75+a*0.25)**2+(x*0.75+b*0.25)**2+(y*0.75+c*0.25)**2+(z*0.75+d*0.25)**2)",
    "rotor_chordal": "sqrt((w-a)**2+(x-b)**2+(y-c)**2+(z-d)**2)",
    "rotation_chordal": "least(sqrt((w-a)**2+(x-b)**2+(y-c)**2+(z-d)**2), CASE WHEN sqrt((w-a)**2+(x-b)**2+(y-c)**2+(z-d)**2) <= sqrt(2) THEN 100 ELSE sqrt((w+a)**2+(x+b)**2+(y+c)**2+(z+d)**2) END)",
    "parity": _mix_sql("w", "x", "y", "z"), "parity_even": _mix_sql("w", "x", "y", "z"), "parity_odd": "0",
    "x_parity": _mix_sql("w", "x", "-y", "-z"), "x_even": _mix_sql("w", "x", "0", "0"), "x_odd": _mix_sql("0", "0", "y", "z"),
    "y_parity": _mix_sql("w", "-x", "y", "-z"), "y_even": _mix_sql("w", "0", "y", "0"), "y_odd": _mix_sql("0", "x", "0", "z"),
    "z_parity": _mix_sql("w", "-x", "-y", "z"), "z_even": _mix_sql("w", "0", "0", "z"), "z_odd": _mix_sql("0", "x", "y", "0"),
} | {k: f"({x})::INT" for k, x in _BOOLS.items()}


@query(f"SELECT l_orderkey, l_linenumber, {_columns(_ALGEBRA)} {_LINES}")
def quaternion_algebra(spark, sf_dir):
    u, (q, p) = quaternions, _q()
    with u.steps() as kept:
        out = {"added": u.add(q, p), "subtracted": u.sub(q, p), "divided": u.div(q, p), "scaled": u.scale(q, 3.0), "plus_scalar": u.scalar_add(q, 3.0), "minus_scalar": u.scalar_sub(q, 3.0), "scalar_over": u.scalar_div(q, F.lit(3.0)), "opposite": u.opposite(q), "conjugate": u.conjugate(q), "inverse": u.inverse(q), "normalized": u.normalized(q), "identity": u.identity(), "lerp": u.lerp(q, p, F.lit(0.25)), "nlerp": u.nlerp(q, p, F.lit(0.25))}
        for axis in ("", "x", "y", "z"):
            name = axis + "_" if axis else "parity_"
            out |= {f"{axis}_parity" if axis else "parity": u.parity_conjugate(q, axis), name + "even": u.parity_symmetric_part(q, axis), name + "odd": u.parity_antisymmetric_part(q, axis)}
        plain = {"magnitude": u.magnitude(q), "dot": u.dot(q, p), "rotor_chordal": u.rotor_chordal_distance(q, p), "rotation_chordal": u.rotation_chordal_distance(q, p)}
        tests = {"equal": u.equal(q, p), "less": u.is_less(q, p), "greater": u.is_greater(q, p), "less_equal": u.is_less_equal(q, p), "greater_equal": u.is_greater_equal(q, p), "zero": u.is_zero(q), "is_one": u.is_identity(q), "nan": u.is_nan(q), "inf": u.is_inf(q), "finite": u.is_finite(q)}
        mixed = {k: u.let(v, _mix) for k, v in out.items()}
    return _lines(spark, sf_dir, mixed | plain | {k: v.cast("int") for k, v in tests.items()}, kept=kept)


_V, _R = "sqrt(x*x+y*y+z*z)", "sqrt(w*w+x*x+y*y+z*z)"
_F = f"(atan2({_V}, w) / {_V})"
_CURVED = {
    "exponential": f"exp(w) * ({_mix_sql(f'cos({_V})', *(f'sin({_V}) / {_V} * {k}' for k in 'xyz'))})",
    "logarithm": _mix_sql(f"ln({_R})", *(f"{_F} * {k}" for k in "xyz")),
    "root": f"({_mix_sql(f'{_R} + w', 'x', 'y', 'z')}) / sqrt(2 * ({_R} + w))",
    "angle": f"2 * sqrt(ln({_R})**2 + atan2({_V}, w)**2)",
    "cubed": _mix_sql("w*w*w-3*w*(x*x+y*y+z*z)", *(f"{k}*(3*w*w-(x*x+y*y+z*z))" for k in "xyz")),
    "to_the_two": _mix_sql("w*w-x*x-y*y-z*z", "2*w*x", "2*w*y", "2*w*z"),
    "axis_angle": _mix_sql("cos(w/2)", *(f"sin(w/2)*{k}" for k in ("0.6", "0.0", "0.8"))),
    "spherical": _mix_sql("cos(x/2)*cos(w/2)", "-sin(x/2)*sin(w/2)", "sin(w/2)*cos(x/2)", "sin(x/2)*cos(w/2)"),
    "euler": _mix_sql("cos(x/2)*cos((w+y)/2)", "sin(x/2)*sin((y-w)/2)", "sin(x/2)*cos((y-w)/2)", "cos(x/2)*sin((w+y)/2)"),
    "matrix_and_back": f"({_mix_sql('w', 'x', 'y', 'z')}) / {_R}",
    "rotated": "(1-2*(y*y+z*z)/n)*1+2*((x*y-w*z)/n)*2+2*((x*z+w*y)/n)*3 + 2*(2*((x*y+w*z)/n)*1+(1-2*(x*x+z*z)/n)*2+2*((y*z-w*x)/n)*3) + 3*(2*((x*z-w*y)/n)*1+2*((y*z+w*x)/n)*2+(1-2*(x*x+y*y)/n)*3)".replace("n", _N),
    "rotor_turn": "acos(least(1, greatest(-1, cos(w))))",
}


@query(f"SELECT l_orderkey, l_linenumber, {_columns(_CURVED)} {_LINES}")
def quaternion_functions(spark, sf_dir):
    u, (q, _) = quaternions, _q()
    with u.steps() as kept:
        unit = u.let(u.normalized(q), lambda v: v)
        r = u.rotate_vector(unit, F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")))
        turned = u.from_axis_angle(F.col("w") * 1.0, F.lit(0.0), F.lit(0.0), F.lit(1.0))
        out = {"exponential": u.exp(q), "logarithm": u.log(q), "root": u.sqrt(q), "cubed": u.scalar_pow(q, F.lit(3.0)), "to_the_two": u.power(q, u.quaternion(2.0, 0, 0, 0)), "axis_angle": u.from_axis_angle(F.col("w"), F.lit(0.6), F.lit(0.0), F.lit(0.8)), "spherical": u.from_spherical_coords(F.col("w"), F.col("x")), "euler": u.from_euler_angles(F.col("w"), F.col("x"), F.col("y")), "matrix_and_back": u.let(u.to_matrix(unit), u.from_matrix)}
        plain = {"angle": u.angle(q), "rotated": r["x"] + 2 * r["y"] + 3 * r["z"], "rotor_turn": u.rotor_intrinsic_distance(turned, u.identity())}
        mixed = {k: u.let(v, _mix) for k, v in out.items()}
    return _lines(spark, sf_dir, mixed | plain, kept=kept)


# --- complex numbers: w + xi -----------------------------------------------------------------------------------------

_COMPLEX = {"added": ("w+3", "x+2"), "subtracted": ("w-3", "x-2"), "product": ("w*3-x*2", "w*2+x*3"), "scaled": ("w*3", "x*3"), "conjugate": ("w", "-x"), "logarithm": ("ln(sqrt(w*w+x*x))", "atan2(x,w)"), "root": ("sqrt((sqrt(w*w+x*x)+w)/2)", "sqrt(greatest((sqrt(w*w+x*x)-w)/2, 0))"), "sine": ("sin(w)*cosh(x)", "cos(w)*sinh(x)"), "cosine": ("cos(w)*cosh(x)", "-sin(w)*sinh(x)"), "sinh": ("sinh(w)*cos(x)", "cosh(w)*sin(x)"), "cosh": ("cosh(w)*cos(x)", "sinh(w)*sin(x)"), "squared": ("w*w-x*x", "2*w*x"), "real": ("w", "0")}


@query(f"SELECT l_orderkey, l_linenumber, {_columns({k: f'({a}) + 2 * ({b})' for k, (a, b) in _COMPLEX.items()})} {_LINES}")
def complex_functions(spark, sf_dir):
    u = complexes
    z, v = u.complex_(F.col("w"), F.col("x")), u.complex_(3.0, 2.0)
    out = {"added": u.add(z, v), "subtracted": u.sub(z, v), "product": u.mul(z, v), "scaled": u.scale(z, 3.0), "conjugate": u.conj(z), "logarithm": u.log(z), "root": u.sqrt(z), "sine": u.sin(z), "cosine": u.cos(z), "sinh": u.sinh(z), "cosh": u.cosh(z), "squared": u.power(z, u.complex_(2.0)), "real": u.complex_(F.col("w"))}
    return _lines(spark, sf_dir, {k: c["re"] + 2 * c["im"] for k, c in out.items()})


# --- polynomials -----------------------------------------------------------------------------------------------------


def _weighed(a: Column | list[Column]) -> Column:
    if isinstance(a, list):
        return sum((v * (i + 1) for i, v in enumerate(a)), F.lit(0.0))
    return F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)


_POLY = {"added": "(w+1) + 2*(x+2) + 3*(y+3) + 4*1", "subtracted": "(w-1) + 2*(x-2) + 3*(y-3) + 4*1", "multiplied": "w + 2*(2*w+x) + 3*(3*w+2*x+y) + 4*(3*x+2*y+1) + 5*(3*y+2) + 6*3", "degree": "3", "odd": "x + 1", "even": "w + y", "low": "w", "middle": "w + 1.5", "high": "w + 4", "xopt": "-x / 7.4", "fopt": "w - x*x/14.8", "xifl": "-y / 3", "chebyshev": "w + x*0.3 + y*(2*0.3*0.3-1) + 4*0.3*0.3*0.3-3*0.3", "through": "1 - w + 2*w*w", "with_slope": "2 + w*w"}


@query(f"SELECT l_orderkey, l_linenumber, {_columns(_POLY, 5)} {_LINES}")
def polynomial_algebra(spark, sf_dir):
    u, w = polynomials, F.col("w")
    with quaternions.steps() as kept:
        a, b = [w, F.col("x"), F.col("y"), F.lit(1.0)], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
        r, s = w + 1.5, w + 4
        roots = quaternions.let(u.solve_cubic(F.lit(1.0), -(w + r + s), w * r + w * s + r * s, -w * r * s), lambda v: v)
        top = u.quadratic_optimum([w, F.col("x"), F.lit(3.7)])
        line = [F.lit(c) for c in u.fit_points([0.0, 1.0, 2.0], [1.0, 2.0, 7.0])]
        bent = [F.lit(c) for c in u.fit_points([0.0, 1.0], [2.0, 3.0], 1.0, 2.0)]
        out = {"added": _weighed(u.add(a, b)), "subtracted": _weighed(u.subtract(a, b)), "multiplied": _weighed(u.multiply(a, b)), "degree": u.degree(a), "odd": u.sum_odd(a), "even": u.sum_even(a), "low": roots[0], "middle": roots[1], "high": roots[2], "xopt": top["xopt"], "fopt": top["fopt"], "xifl": u.cubic_critical(a)["xifl"], "chebyshev": scalars.chebyshev(a, F.lit(0.3)), "through": u.evaluate(line, w), "with_slope": u.evaluate(bent, w)}
    return _lines(spark, sf_dir, out, 5, kept)


# --- scalars and points ----------------------------------------------------------------------------------------------

_SCALAR = {"hypotenuse": "sqrt(w*w+x*x)", "wave": "2*sin(2*pi()*3*w+0.5)+1", "essential": "1+2*cos(w*2*pi()/7+0.5)", "basis": "1+2*cos(w*2*pi()/7)+3*sin(w*2*pi()/7)", "from_basis": "1+2*cos(w*2*pi()/7)+3*sin(w*2*pi()/7)", "near_abs": "(abs(w-x)<=0.1)::INT", "near_rel": "(abs(w-x)<=0.1*greatest(abs(w),abs(x)))::INT", "finite": "1", "same_length": "1", "index_in": "l_linenumber", "moved": "(w+1)+2*(x+2)+3*(y+3)", "flat": "sqrt((w-1)**2+(x-2)**2)", "epsilon": "2.0**-52*1e15"}


@query(f"SELECT l_orderkey, l_linenumber, {_columns(_SCALAR)} {_LINES}")
def scalar_functions(spark, sf_dir):
    u, w, x = scalars, F.col("w"), F.col("x")
    amplitude, phase = u.essential_of_basis(2.0, 3.0)
    p = geometry.displace(geometry.point(w, x, F.col("y")), 1.0, 2.0, 3.0)
    out = {"hypotenuse": u.hypot(w, x), "wave": u.sinusoid(w, 2.0, 3.0, 0.5, 1.0), "essential": u.sinusoid_essential(w, 7.0, 1.0, 2.0, 0.5), "basis": u.sinusoid_basis(w, 7.0, 1.0, 2.0, 3.0), "from_basis": u.sinusoid_essential(w, 7.0, 1.0, amplitude, phase), "near_abs": u.approx_equal_abs(w, x, 0.1).cast("int"), "near_rel": u.approx_equal_rel(w, x, 0.1).cast("int"), "finite": u.is_finite(w).cast("int"), "same_length": u.check_same_length(F.array(w, x), F.array(x, w)).cast("int"), "index_in": u.check_index(F.col("l_linenumber").cast("long"), F.lit(100)), "moved": p["x"] + 2 * p["y"] + 3 * p["z"], "flat": geometry.distance_2d(geometry.point(w, x), geometry.point(F.lit(1.0), F.lit(2.0))), "epsilon": F.lit(u.eps() * 1e15)}
    return _lines(spark, sf_dir, out)


# --- inverses --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment AS label, c_mktsegment AS onehot, round(c_acctbal, 4) + 0.0 AS standard, round(c_acctbal, 4) + 0.0 AS minmax, round(c_acctbal, 4) + 0.0 AS robust FROM customer")
def inverse_transforms(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    label = encoders.LabelEncoder("c_mktsegment", "c_custkey")
    out = label.inverse_transform(label.fit_transform(df)).select("c_custkey", F.col("c_mktsegment").alias("label"))
    hot = encoders.OneHotEncoder(["c_mktsegment"], "c_custkey")
    out = out.join(hot.inverse_transform(hot.fit_transform(df)).select("c_custkey", F.col("c_mktsegment").alias("onehot")), "c_custkey")
    for name, kind in (("standard", scalers.StandardScaler), ("minmax", scalers.MinMaxScaler), ("robust", scalers.RobustScaler)):
        s = kind(["c_acctbal"])
        out = out.join(s.inverse_transform(s.fit_transform(df)).select("c_custkey", F.col("c_acctbal").alias(name)), "c_custkey")
    return rounded(out, 4)


# --- models with given weights ---------------------------------------------------------------------------------------

_E = "(1000 + 2 * l_quantity + 500 * l_tax - l_extendedprice)"
_Z = "(0.5 - 0.02 * l_quantity + l_tax)"


@query(f"SELECT round(sum(1000 + 2 * l_quantity + 500 * l_tax), 2) AS predicted, round(avg({_E} * {_E}) / 2, 2) AS linear_cost, round(avg({_E} * {_E}) / 2 + 7.0 / (2 * count(*)) * 250004, 2) AS ridge_cost, round(avg({_E} * {_E}) + 7.0 * 502, 2) AS lasso_cost, round(avg({_E} * {_E}) / 2 + 3 * (0.25 * 502 + 0.75 / 2 * 250004), 2) AS elastic_cost, round(avg({_E} * l_quantity) + 7.0 / count(*) * 2, 3) AS ridge_slope, round(avg({_E}), 4) AS ridge_bias FROM lineitem")
def model_costs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_extendedprice")))
    of = lambda kind, **more: kind(["l_quantity", "l_tax"], np.array([2.0, 500.0]), 1000.0, **more)
    elastic, ridge, y = of(models.ElasticNet), of(models.Ridge, penalty=7.0), "l_extendedprice"
    elastic.alpha, elastic.l1_ratio = 3.0, 0.25
    slope, bias = ridge.gradients(df, y)
    total = of(models.LinearRegression).predict(df).agg(F.sum("prediction")).first()[0]
    row = (round(total, 2), round(of(models.LinearRegression).cost(df, y), 2), round(ridge.cost(df, y), 2), round(of(models.Lasso, penalty=7.0).cost(df, y), 2), round(elastic.cost(df, y), 2), round(float(slope[0]), 3), round(float(bias), 4))
    return spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{c} double" for c in ("predicted", "linear_cost", "ridge_cost", "lasso_cost", "elastic_cost", "ridge_slope", "ridge_bias")))


@query(f"SELECT round(avg(p), 6) AS probability, round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z))) + (1 - y) * z) + 7.0 / (2 * count(*)) * 1.0004, 6) AS cost, round(avg((p - y) * l_quantity) + 7.0 / count(*) * -0.02, 6) AS slope, round(avg(p - y), 6) AS bias FROM (SELECT *, {_Z} AS z, 1 / (1 + exp(-{_Z})) AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)")
def logistic_costs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_tax").cast("double").alias("l_tax"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    m = models.LogisticRegression(["l_quantity", "l_tax"], np.array([-0.02, 1.0]), 0.5, 7.0)
    slope, bias = m.gradients(df, "y")
    row = (m.predict(df).agg(F.avg("prediction")).first()[0], m.cost(df, "y"), slope[0], bias)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in row)], "probability double, cost double, slope double, bias double")


# --- matrices: S is the Gram matrix of the embeddings' sums by label, v its first column ------------------------------

_SYM = "WITH e AS (SELECT label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS k FROM embeddings), l AS (SELECT label AS i, k, sum(x) AS x FROM e GROUP BY 1, 2), s AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM l a JOIN l b USING (k) GROUP BY 1, 2), c AS (SELECT i, v AS x FROM s WHERE j = 0) "


def _symmetric(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    a = e.groupBy(F.col("label").cast("long").alias("i"), F.col("k").cast("long").alias("j")).agg(F.sum(F.col("x").cast("double")).alias("val"))
    s = matrix.gemm(a, a, trans_b=True)
    return s, s.filter("j = 0").select("i", "val")


_VECTORS = {"symv": "sum(v * x)", "trmv_upper": "sum(CASE WHEN i <= j THEN v * x ELSE 0 END)", "trmv_lower": "sum(CASE WHEN i >= j THEN v * x ELSE 0 END)"}


@query(_SYM + "SELECT s.i AS i, " + ", ".join(f"round({x.replace('i ', 's.i ').replace('x', 'c.x')}, 2) + 0.0 AS {k}" for k, x in _VECTORS.items()) + " FROM s JOIN c ON c.i = s.j GROUP BY 1")
def matrix_vectors(spark, sf_dir):
    s, v = _symmetric(spark, sf_dir)
    got = {"symv": matrix.symv(s, v, "upper"), "trmv_upper": matrix.trmv(s, v, "upper"), "trmv_lower": matrix.trmv(s, v, "lower")}
    out = None
    for k, df in got.items():
        df = df.withColumnRenamed("val", k)
        out = df if out is None else out.join(df, "i")
    return rounded(out, 2)


_UPDATES = {"ger": "s.v + 2 * a.x * b.x", "transposed": "s.v", "kept": "CASE WHEN s.i = 1 AND s.j = 2 THEN 5.0 ELSE s.v END"}
_UPPER = {"syr": "s.v + 2 * a.x * b.x", "syr2": "s.v + 4 * a.x * b.x", "syrk": "p.v", "syr2k": "2 * p.v"}


@query(_SYM + ", p AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.j = b.i GROUP BY 1, 2), t AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.j = b.i WHERE a.i <= a.j GROUP BY 1, 2) SELECT s.i AS i, s.j AS j, " + ", ".join(f"round({x}, 1) + 0.0 AS {k}" for k, x in _UPDATES.items()) + ", round(t.v, 1) + 0.0 AS trmm, " + ", ".join(f"CASE WHEN s.i <= s.j THEN round({x}, 1) + 0.0 END AS {k}" for k, x in _UPPER.items()) + " FROM s JOIN c a ON a.i = s.i JOIN c b ON b.i = s.j JOIN p ON p.i = s.i AND p.j = s.j JOIN t ON t.i = s.i AND t.j = s.j")
def matrix_updates(spark, sf_dir):
    s, v = _symmetric(spark, sf_dir)
    whole = {"ger": matrix.ger(v, v, s, 2.0), "transposed": matrix.transpose(s), "kept": matrix.to_dense(matrix.put(s, 1, 2, 5.0), 10, 10), "trmm": matrix.trmm(s, s, "upper")}
    upper = {"syr": matrix.syr(v, s, "upper", 2.0), "syr2": matrix.syr2(v, v, s, "upper", 2.0), "syrk": matrix.syrk(s, "upper"), "syr2k": matrix.syr2k(s, s, "upper")}
    out = s.select("i", "j")
    for k, df in (whole | upper).items():
        out = out.join(df.withColumnRenamed("val", k), ["i", "j"], "left")
    return rounded(out, 1)


_TWO = "FROM (SELECT c_custkey, 2 + abs(c_acctbal) / 1000 AS p, c_nationkey / 25 AS q, 3.0::DOUBLE AS r FROM customer)"
_SMALL = {"det": "p*r-q*q", "inverse": "(r - 2*q - 3*q + 4*p) / (p*r-q*q)", "inverse_small": "(r - 2*q - 3*q + 4*p) / (p*r-q*q)", "solved": "((r*1-q*2) + 2*(p*2-q*1)) / (p*r-q*q)", "solved_lu": "((r*1-q*2) + 2*(p*2-q*1)) / (p*r-q*q)", "cholesky": "sqrt(p) + 2*q/sqrt(p) + 3*sqrt(r-q*q/p)", "largest": "(p+r)/2 + sqrt((p-r)**2/4+q*q)", "smallest": "(p+r)/2 - sqrt((p-r)**2/4+q*q)", "singular": "(p+r)/2 + sqrt((p-r)**2/4+q*q)", "r11": "sqrt(p*p+q*q)", "qr_back": "p + 2*q + 3*q + 4*r", "length": "sqrt(p*p+q*q)", "lower": "1/p + 2*(2-q/p)/r", "norm_of_reflected": "sqrt(p*p+q*q)"}


@query(f"SELECT c_custkey, {_columns(_SMALL, 5)} {_TWO}")
def small_matrices(spark, sf_dir):
    """LAPACK's functions on one symmetric matrix of order two per customer, against their closed forms."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (2 + F.abs("c_acctbal") / 1000).cast("double").alias("p"), (F.col("c_nationkey") / 25).cast("double").alias("q"))
    names = list(_SMALL)

    def run(batches):
        mixed = lambda m: m[:, 0, 0] + 2 * m[:, 0, 1] + 3 * m[:, 1, 0] + 4 * m[:, 1, 1]
        for pdf in batches:
            if not len(pdf):
                continue
            p, q = pdf["p"].to_numpy(), pdf["q"].to_numpy()
            a = np.stack([np.stack([p, q], 1), np.stack([q, np.full(len(p), 3.0)], 1)], 1)
            b = np.broadcast_to([[1.0], [2.0]], (len(p), 2, 1))
            factors, pivots = matrix.lu_many(a)
            low, values, (o, t) = matrix.cholesky_many(a), np.sort(matrix.jacobi_many(a)[0], 1), matrix.qr_many(a)
            half = matrix.triangular_solve_many(np.tril(a), b, True)[:, :, 0]
            x = matrix.solve_lu_many(factors, pivots, b)[:, :, 0]
            back = matrix.solve_lu_many(factors, pivots, np.broadcast_to(np.eye(2), a.shape))
            beta = matrix.householder_many(a[:, :, 0])[2]
            solved = x[:, 0] + 2 * x[:, 1]
            columns = (matrix.det_many(factors, pivots), mixed(back), mixed(matrix.inverse_small_many(a)), solved, solved, low[:, 0, 0] + 2 * low[:, 1, 0] + 3 * low[:, 1, 1], values[:, 1], values[:, 0], matrix.singular_values_many(a)[:, 0], np.abs(t[:, 0, 0]), mixed(o @ t), np.hypot(p, q), half[:, 0] + 2 * half[:, 1], np.abs(beta))
            yield pd.DataFrame({"c_custkey": pdf["c_custkey"]} | dict(zip(names, columns)))

    return rounded(df.mapInPandas(run, "c_custkey long, " + ", ".join(f"{c} double" for c in names)), 5)


# --- vectors and Fourier transforms ------------------------------------------------------------------------------------

_D = "list_transform(embedding, lambda x: x::DOUBLE)"


def _weigh_sql(e: str) -> str:
    return f"list_sum(list_transform({e}, lambda x, i: x * i))"


_FOURIER = {"back": f"64 * {_weigh_sql(_D)}", "normalized_back": _weigh_sql(_D), "shifted": _weigh_sql(f"list_concat({_D}[33:], {_D}[:32])"), "shifted_back": _weigh_sql(f"list_concat({_D}[33:], {_D}[:32])"), "top_bin": f"abs(list_sum({_D}))", "again": f"64 * {_D}[1]", "axpy": f"3 * {_weigh_sql(_D)}", "scaled": f"3 * {_weigh_sql(_D)}", "third": f"{_D}[3]", "by_columns": _weigh_sql(f"list_concat(list_transform(range(32), lambda k: {_D}[2*k+1]), list_transform(range(32), lambda k: {_D}[2*k+2]))"), "by_rows": _weigh_sql(_D)}


@query("SELECT vec_id, " + _columns(_FOURIER, 4) + ", 64::BIGINT AS padded FROM embeddings")
def vectors_and_transforms(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).withColumn("z", signal.fft(F.col("e")))
    df = df.withColumns({"b": signal.ifft(F.col("z")), "n": signal.ifft_normalized(F.col("z")), "c": signal.fft_complex(F.col("z"))})
    x = F.col("e")
    columns = matrix.row_major_to_column_major(x, 32, 2)
    out = {"back": _weighed(F.transform("b", lambda v: v["re"])), "normalized_back": _weighed(F.col("n")), "shifted": _weighed(signal.fftshift(x)), "shifted_back": _weighed(signal.ifftshift(x)), "top_bin": signal.magnitude_spectrum(F.col("z"))[0], "again": F.col("c")[0]["re"], "axpy": _weighed(matrix.axpy(2.0, x, x)), "scaled": _weighed(matrix.scal(3.0, x)), "third": matrix.get(x, F.lit(2)), "by_columns": _weighed(columns), "by_rows": _weighed(matrix.column_major_to_row_major(columns, 32, 2))}
    return rounded(df.select("vec_id", *(c.cast("double").alias(k) for k, c in out.items())), 4).withColumn("padded", F.lit(signal.next_power_of_2(50)).cast("long"))


# --- generators and graphs -------------------------------------------------------------------------------------------


@query("SELECT i AS idx, 1.5 + i * 0.25 AS counted, ['a', 'b', 'c'][i % 3 + 1] AS cycled, 7 AS repeated FROM range(100) r(i)")
def endless_iterators(spark, sf_dir):
    c = generators.counter(spark, 1.5, 0.25, 100).withColumnRenamed("val", "counted")
    y = generators.cycle(spark, ["a", "b", "c"], 100).withColumnRenamed("val", "cycled")
    return c.join(y, "idx").join(generators.repeat(spark, 7, 100).withColumnRenamed("val", "repeated"), "idx")


@query("SELECT 'product' AS kind, a || b AS val FROM (VALUES ('x'), ('y')) p(a), (VALUES ('1'), ('2'), ('3')) q(b) UNION ALL SELECT 'permutation', a || b || c FROM (VALUES ('x'), ('y'), ('z')) p(a), (VALUES ('x'), ('y'), ('z')) q(b), (VALUES ('x'), ('y'), ('z')) r(c) WHERE a <> b AND b <> c AND a <> c")
def item_products(spark, sf_dir):
    rows = [("product", a + b) for a, b in generators.items_product("xy", "123")] + [("permutation", "".join(x)) for x in generators.items_permutations("xyz")]
    return spark.createDataFrame(rows, "kind string, val string")


@query("WITH e AS (SELECT DISTINCT s_nationkey AS u, n_regionkey + 100 AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS vertices, (SELECT count(*) FROM e) AS edges")
def graph_sizes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    e = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_nationkey").alias("u"), (F.col("n_regionkey") + 100).alias("v")).distinct()
    edges = graph.edges_of(e, "u", "v")
    return spark.range(1).select(F.lit(graph.n_vertices(edges)).cast("long").alias("vertices"), F.lit(edges.count()).cast("long").alias("edges"))
