"""Vectors as arrays, matrices as coordinate tables (i, j, val), and dense factorizations of small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import NotConverged, NotPositiveDefinite, SingularMatrix

# --- arrays ----------------------------------------------------------------------------------------------------------


def _same(a: Column, b: Column, out: Column, kind: str) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("lengths differ")).cast(kind))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def axpy(alpha, x: Column, y: Column) -> Column:
    return _same(x, y, F.zip_with(x, y, lambda a, b: alpha * a.cast("double") + b), "array<double>")


def dot(x: Column, y: Column) -> Column:
    return _same(x, y, _sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b)), "double")


def nrm2(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a.cast("double") * a)))


def scal(alpha, x: Column) -> Column:
    return F.transform(x, lambda a: alpha * a)


def asum(x: Column) -> Column:
    return _sum(F.transform(x, lambda a: F.abs(a).cast("double")))


def iamax(x: Column) -> Column:
    """First index of the largest absolute value."""
    a = F.transform(x, lambda v: F.abs(v))
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def get(x: Column, i: Column) -> Column:
    """Element at a 0-based index; outside is an error."""
    return F.when((i >= 0) & (i < F.size(x)), F.get(x, i)).otherwise(F.raise_error(F.lit("index out of bounds")).cast("double"))


def row_major_to_column_major(x: Column, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.get(x, (k % rows) * cols + F.floor(k / rows).cast("int")))


def column_major_to_row_major(x: Column, rows: int, cols: int) -> Column:
    return row_major_to_column_major(x, cols, rows)


# --- coordinate tables -----------------------------------------------------------------------------------------------


def rows_to_coo(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(i, j, val) of a table with one array per row."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "val")).select("i", F.col("j").cast("long").alias("j"), F.col("val").cast("double").alias("val"))


def to_dense(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """(i, j, val) of every cell, 0 where the table has none."""
    spark = a.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    return grid.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("val", F.lit(0.0)).alias("val"))


def put(a: DataFrame, i: int, j: int, val: float) -> DataFrame:
    cell = a.sparkSession.range(1).select(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(float(val)).alias("val"))
    return a.filter(~((F.col("i") == i) & (F.col("j") == j))).unionByName(cell)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def triangle(a: DataFrame, uplo: str, unit: bool = False) -> DataFrame:
    """The upper or lower triangle, with ones for the diagonal if unit."""
    keep = F.col("i") <= F.col("j") if uplo == "upper" else F.col("i") >= F.col("j")
    if not unit:
        return a.filter(keep)
    ones = a.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("val"))
    return a.filter(keep & (F.col("i") != F.col("j"))).unionByName(ones)


def symmetric(a: DataFrame, uplo: str) -> DataFrame:
    """The full matrix of one triangle."""
    t = triangle(a, uplo)
    return t.unionByName(transpose(t.filter("i <> j")))


def _combined(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    out = None
    for k, p in parts:
        p = p.withColumn("val", F.col("val") * k)
        out = p if out is None else out.unionByName(p)
    keys = [c for c in out.columns if c != "val"]
    return out.groupBy(*keys).agg(F.sum("val").alias("val"))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, c: DataFrame | None = None, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """alpha A B + beta C: an equi-join on the inner index and a sum with partial aggregation."""
    a, b = transpose(a) if trans_a else a, transpose(b) if trans_b else b
    m = a.select("i", F.col("j").alias("k"), F.col("val").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("val").alias("y")), "k")
    m = m.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("val"))
    return _combined([(alpha, m)] + ([(beta, c)] if c is not None else []))


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0, trans: bool = False) -> DataFrame:
    """alpha A x + beta y as (i, val)."""
    a = transpose(a) if trans else a
    m = a.join(x.select(F.col("i").alias("j"), F.col("val").alias("x")), "j").groupBy("i").agg(F.sum(F.col("val") * F.col("x")).alias("val"))
    return _combined([(alpha, m)] + ([(beta, y)] if y is not None else []))


spmv = gemv


def ger(x: DataFrame, y: DataFrame, a: DataFrame, alpha: float = 1.0) -> DataFrame:
    """A + alpha x y'; the outer product has a row per cell of the result."""
    outer = x.select("i", F.col("val").alias("x")).crossJoin(y.select(F.col("i").alias("j"), F.col("val").alias("y"))).select("i", "j", (F.col("x") * F.col("y")).alias("val"))
    return _combined([(alpha, outer), (1.0, a)])


def symv(a: DataFrame, x: DataFrame, uplo: str, **more) -> DataFrame:
    return gemv(symmetric(a, uplo), x, **more)


def syr(x: DataFrame, a: DataFrame, uplo: str, alpha: float = 1.0) -> DataFrame:
    return triangle(ger(x, x, a, alpha), uplo)


def syr2(x: DataFrame, y: DataFrame, a: DataFrame, uplo: str, alpha: float = 1.0) -> DataFrame:
    return triangle(ger(y, x, ger(x, y, a, alpha), alpha), uplo)


def trmv(a: DataFrame, x: DataFrame, uplo: str, unit: bool = False, trans: bool = False) -> DataFrame:
    return gemv(triangle(a, uplo, unit), x, trans=trans)


def syrk(a: DataFrame, uplo: str, alpha: float = 1.0, c: DataFrame | None = None, beta: float = 0.0, trans: bool = False) -> DataFrame:
    """One triangle of alpha A A' + beta C."""
    return triangle(gemm(a, a, alpha, c, beta, trans_a=trans, trans_b=not trans), uplo)


def syr2k(a: DataFrame, b: DataFrame, uplo: str, alpha: float = 1.0, c: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    return triangle(_combined([(alpha, gemm(a, b, trans_b=True)), (alpha, gemm(b, a, trans_b=True))] + ([(beta, c)] if c is not None else [])), uplo)


def trmm(t: DataFrame, b: DataFrame, uplo: str, left: bool = True, unit: bool = False, trans: bool = False, alpha: float = 1.0) -> DataFrame:
    t = triangle(t, uplo, unit)
    return gemm(t, b, alpha, trans_a=trans) if left else gemm(b, t, alpha, trans_b=trans)


# --- dense, small ----------------------------------------------------------------------------------------------------


def lu(a) -> tuple[np.ndarray, np.ndarray, bool]:
    """(LU in one matrix, row exchanged at each step, whether no pivot was exactly 0) with partial pivoting."""
    a = np.array(a, float)
    n = min(a.shape)
    pivots, fine = np.arange(n), True
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        pivots[k] = p
        if a[p, k] == 0:
            fine = False
            continue
        a[[k, p]] = a[[p, k]]
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, pivots, fine


def swap_rows(a, pivots) -> np.ndarray:
    a = np.array(a, float)
    for k, p in enumerate(pivots):
        a[[k, p]] = a[[p, k]]
    return a


def triangular_solve(t, b, lower: bool, unit: bool = False, trans: bool = False) -> np.ndarray:
    t, x = np.array(t, float), np.array(b, float)
    if trans:
        t, lower = t.T, not lower
    n = len(t)
    for i in range(n) if lower else range(n - 1, -1, -1):
        known = t[i, :i] @ x[:i] if lower else t[i, i + 1 :] @ x[i + 1 :]
        x[i] = x[i] - known
        if not unit:
            if t[i, i] == 0:
                raise SingularMatrix("zero on the diagonal")
            x[i] = x[i] / t[i, i]
    return x


trsv = triangular_solve


def trsm(t, b, lower: bool, left: bool = True, unit: bool = False, trans: bool = False, alpha: float = 1.0) -> np.ndarray:
    b = alpha * np.array(b, float)
    return triangular_solve(t, b, lower, unit, trans) if left else triangular_solve(t, b.T, lower, unit, not trans).T


def solve_lu(factors: np.ndarray, pivots: np.ndarray, b, trans: bool = False) -> np.ndarray:
    if trans:
        y = triangular_solve(factors, triangular_solve(factors, b, lower=False, trans=True), lower=True, unit=True, trans=True)
        for k in range(len(pivots) - 1, -1, -1):
            y[[k, pivots[k]]] = y[[pivots[k], k]]
        return y
    return triangular_solve(factors, triangular_solve(factors, swap_rows(b, pivots), lower=True, unit=True), lower=False)


def solve(a, b) -> np.ndarray:
    factors, pivots, fine = lu(a)
    if not fine:
        raise SingularMatrix("a pivot is 0")
    return solve_lu(factors, pivots, b)


def inverse(a) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def det(a) -> float:
    """An exactly zero pivot is an error, not 0."""
    factors, pivots, fine = lu(a)
    if not fine:
        raise SingularMatrix("a pivot is 0")
    return float(np.prod(np.diag(factors)) * (-1) ** int((pivots != np.arange(len(pivots))).sum()))


def inverse_small(a, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """Inverse and determinant of up to 3 x 3 by cofactors."""
    a = np.array(a, float)
    n = len(a)
    if n not in (1, 2, 3):
        raise ValueError("1 to 3 rows are needed")
    minor = lambda i, j: np.delete(np.delete(a, i, 0), j, 1)
    flat = lambda m: 1.0 if m.size == 0 else m[0, 0] if m.size == 1 else m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    cof = np.array([[(-1) ** (i + j) * flat(minor(i, j)) for j in range(n)] for i in range(n)])
    d = float(a[0] @ cof[0])
    if abs(d) <= tol:
        raise SingularMatrix("the determinant is within tol of 0")
    return cof.T / d, d


def cholesky(a) -> np.ndarray:
    """Lower factor, reading the lower triangle alone."""
    a = np.array(a, float)
    out = np.zeros_like(a)
    for j in range(len(a)):
        d = a[j, j] - out[j, :j] @ out[j, :j]
        if not d > 0:  # also NaN
            raise NotPositiveDefinite(f"pivot {j} isn't positive")
        out[j, j] = np.sqrt(d)
        out[j + 1 :, j] = (a[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out


def householder(x) -> tuple[np.ndarray, float, float]:
    """(v with v[0] = 1, tau, beta): (I - tau v v') x = beta e1."""
    x = np.array(x, float)
    rest = np.linalg.norm(x[1:])
    v = x.copy()
    v[0] = 1.0
    if rest == 0:
        return v, 0.0, float(x[0])
    beta = -np.copysign(np.hypot(x[0], rest), x[0])
    v[1:] = x[1:] / (x[0] - beta)
    return v, float((beta - x[0]) / beta), float(beta)


def reflect(c, v: np.ndarray, tau: float, left: bool = True) -> np.ndarray:
    c = np.array(c, float)
    return c - tau * np.outer(v, v @ c) if left else c - tau * np.outer(c @ v, v)


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    """Thin factorization by reflections."""
    r = np.array(a, float)
    m, n = r.shape
    k = min(m, n)
    q = np.eye(m)
    for j in range(k):
        v, tau, _ = householder(r[j:, j])
        r[j:] = reflect(r[j:], v, tau)
        q[:, j:] = reflect(q[:, j:], v, tau, left=False)
    return q[:, :k], np.triu(r[:k])


def jacobi(a, tol: float = 1e-15, sweeps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of a symmetric matrix by cyclic rotations, in no order."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for _ in range(sweeps + 1):
        if np.abs(np.triu(a, 1)).sum() <= tol:
            return np.diag(a).copy(), q
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j]:
                    theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                    t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                    c = 1 / np.hypot(t, 1)
                    s = t * c
                    rot = np.array([[c, s], [-s, c]])
                    a[[i, j]] = rot.T @ a[[i, j]]
                    a[:, [i, j]] = a[:, [i, j]] @ rot
                    a[i, j] = a[j, i] = 0.0
                    q[:, [i, j]] = q[:, [i, j]] @ rot
    if np.abs(np.triu(a, 1)).sum() > 1e-9 * max(1.0, np.abs(a).sum()):
        raise NotConverged("off-diagonal entries remain")
    return np.diag(a).copy(), q


eigen_symmetric = jacobi


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin (u, s, vt), s descending, from the eigenvectors of A'A."""
    a = np.array(a, float)
    if a.shape[0] < a.shape[1]:
        u, s, vt = svd(a.T)
        return vt.T, s, u.T
    values, v = jacobi(a.T @ a)
    order = np.argsort(-values, kind="stable")
    s, v = np.sqrt(np.maximum(values[order], 0)), v[:, order]
    u = a @ v / np.where(s > 1e-300, s, 1)
    return u, s, v.T


def dlapy2(x: float, y: float) -> float:
    return float(np.hypot(x, y))


# --- stacks of small matrices: the same steps for all of (..., n, n) at once --------------------------------------------


def lu_many(a) -> tuple[np.ndarray, np.ndarray]:
    """(LU, pivots) of every matrix as in `lu`; a pivot that is exactly 0 is an error."""
    a = np.array(a, float)
    n = a.shape[-1]
    one, pivots = np.arange(len(a)), np.zeros((len(a), n), int)
    for k in range(n):
        p = k + np.abs(a[:, k:, k]).argmax(1)
        pivots[:, k] = p
        if (a[one, p, k] == 0).any():
            raise SingularMatrix("a pivot is 0")
        a[one, k], a[one, p] = a[one, p], a[one, k]
        a[:, k + 1 :, k] /= a[:, k, k, None]
        a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, k, None, k + 1 :]
    return a, pivots


def triangular_solve_many(t: np.ndarray, b: np.ndarray, lower: bool, unit: bool = False) -> np.ndarray:
    """Of matrices (m, n, n) and right sides (m, n, r)."""
    x = np.array(b, float)
    n = t.shape[-1]
    for i in range(n) if lower else range(n - 1, -1, -1):
        known = slice(0, i) if lower else slice(i + 1, n)
        x[:, i] -= np.einsum("mk,mkr->mr", t[:, i, known], x[:, known])
        if not unit:
            if (t[:, i, i] == 0).any():
                raise SingularMatrix("zero on the diagonal")
            x[:, i] /= t[:, i, i, None]
    return x


def solve_lu_many(factors: np.ndarray, pivots: np.ndarray, b) -> np.ndarray:
    x, one = np.array(b, float), np.arange(len(factors))
    for k in range(pivots.shape[1]):
        x[one, k], x[one, pivots[:, k]] = x[one, pivots[:, k]], x[one, k]
    return triangular_solve_many(factors, triangular_solve_many(factors, x, True, True), False)


def det_many(factors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From what `lu_many` returns."""
    return np.diagonal(factors, axis1=1, axis2=2).prod(1) * (-1.0) ** (pivots != np.arange(pivots.shape[1])).sum(1)


def inverse_small_many(a: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """By cofactors, of 2 x 2."""
    d = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
    if (np.abs(d) <= tol).any():
        raise SingularMatrix("the determinant is within tol of 0")
    out = -a / d[:, None, None]
    out[:, 0, 0], out[:, 1, 1] = a[:, 1, 1] / d, a[:, 0, 0] / d
    return out


def cholesky_many(a: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    for j in range(a.shape[-1]):
        d = a[:, j, j] - (out[:, j, :j] ** 2).sum(1)
        if not (d > 0).all():  # also NaN
            raise NotPositiveDefinite(f"pivot {j} isn't positive")
        out[:, j, j] = np.sqrt(d)
        out[:, j + 1 :, j] = (a[:, j + 1 :, j] - np.einsum("mik,mk->mi", out[:, j + 1 :, :j], out[:, j, :j])) / out[:, j, j, None]
    return out


def householder_many(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = np.sqrt((x[:, 1:] ** 2).sum(1))
    none = rest == 0
    beta = np.where(none, x[:, 0], -np.copysign(np.hypot(x[:, 0], rest), x[:, 0]))
    v = x / np.where(none, 1, x[:, 0] - beta)[:, None]
    v[:, 0] = 1
    return v, np.where(none, 0, (beta - x[:, 0]) / np.where(beta == 0, 1, beta)), beta


def qr_many(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of square matrices, by reflections."""
    r, n = np.array(a, float), a.shape[-1]
    q = np.broadcast_to(np.eye(n), a.shape).copy()
    for j in range(n):
        v, tau, _ = householder_many(r[:, j:, j])
        r[:, j:] -= tau[:, None, None] * v[:, :, None] * np.einsum("mi,mij->mj", v, r[:, j:])[:, None]
        q[:, :, j:] -= tau[:, None, None] * np.einsum("mij,mj->mi", q[:, :, j:], v)[:, :, None] * v[:, None]
    return q, np.triu(r)


def jacobi_many(a, tol: float = 1e-15, sweeps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of symmetric matrices by cyclic rotations; each stops at its own tolerance."""
    a = np.array(a, float)
    n = a.shape[-1]
    q = np.broadcast_to(np.eye(n), a.shape).copy()
    off = lambda: np.abs(np.triu(a, 1)).sum((1, 2))
    for _ in range(sweeps):
        open_ = off() > tol
        if not open_.any():
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                at = np.flatnonzero(open_ & (a[:, i, j] != 0))
                theta = (a[at, j, j] - a[at, i, i]) / (2 * a[at, i, j])
                t = np.where(theta >= 0, 1, -1) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                c, s = c[:, None], s[:, None]
                x, y = a[at, i], a[at, j]
                a[at, i], a[at, j] = c * x - s * y, s * x + c * y
                for m in (a, q):
                    x, y = m[at, :, i], m[at, :, j]
                    m[at, :, i], m[at, :, j] = c * x - s * y, s * x + c * y
                a[at, i, j] = a[at, j, i] = 0.0
    if (off() > np.maximum(tol, 1e-9 * np.maximum(1.0, np.abs(a).sum((1, 2))))).any():
        raise NotConverged("off-diagonal entries remain")
    return np.diagonal(a, axis1=1, axis2=2).copy(), q


def singular_values_many(a: np.ndarray) -> np.ndarray:
    """Descending, from the eigenvalues of A'A as in `svd`."""
    values = jacobi_many(np.swapaxes(a, 1, 2) @ a)[0]
    return np.sqrt(np.maximum(-np.sort(-values, axis=1), 0))


def per_matrix(df: DataFrame, key: str, i: str, j: str, val: str, fn, schema: str) -> DataFrame:
    """fn(key, dense matrix) -> DataFrame for every small matrix of a coordinate table, in parallel by key."""
    import pandas as pd

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf[i].max()) + 1, int(pdf[j].max()) + 1))
        m[pdf[i].astype(int), pdf[j].astype(int)] = pdf[val]
        return fn(k[0], m)

    return df.groupBy(key).applyInPandas(run, schema)


# --- complex vectors ---------------------------------------------------------------------------------------------------


def caxpy(alpha: complex, x, y) -> np.ndarray:
    return alpha * np.asarray(x, complex) + np.asarray(y, complex)


def cdotu(x, y) -> complex:
    return complex(np.dot(np.asarray(x, complex), np.asarray(y, complex)))


def cdotc(x, y) -> complex:
    return complex(np.vdot(np.asarray(x, complex), np.asarray(y, complex)))


def cgemv(alpha: complex, a, x, beta: complex, y, trans: bool = False) -> np.ndarray:
    a = np.asarray(a, complex)
    return alpha * (a.T if trans else a) @ np.asarray(x, complex) + beta * np.asarray(y, complex)


def cgemm(alpha: complex, a, b, beta: complex, c) -> np.ndarray:
    return alpha * np.asarray(a, complex) @ np.asarray(b, complex) + beta * np.asarray(c, complex)
