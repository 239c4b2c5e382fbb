"""Plans and kernels of the queries that were too slow or too large on big tables."""

import duckdb
import numpy as np
import pytest

from tessera import catalog, catalog_functions
from tessera.functions import polynomials, quaternions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quaternion_algebra", "quaternion_functions", "polynomial_algebra"])
def test_lines_are_compiled(spark, name):
    """Lambdas are interpreted: the only ones left pass a line number on."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    assert plan.count("lambdafunction(") == plan.count("transform(array(l_linenumber")


def test_rounding_is_that_of_sql(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 100, 5000), [0.0, -0.0, 1e300, -1e20, 2.5e-6, -2.5e-6, 0.4999995]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r[0] for r in df.select(catalog_functions._rounded(df.v, 6)).collect()]
    db = duckdb.connect()
    assert got == [db.execute("SELECT round(?::DOUBLE, 6) + 0.0", [float(v)]).fetchone()[0] for v in x]


def test_lists_of_coefficients_are_arrays(spark):
    from pyspark.sql import functions as F

    a, b, x = [1.0, -2.0, 0.5, 3.0], [2.0, 7.0], 0.3
    cols = lambda v: [F.lit(c) for c in v]
    one = spark.range(1)
    for f in (polynomials.add, polynomials.subtract, polynomials.multiply):
        row = one.select(F.array(*f(cols(a), cols(b))).alias("l"), f(F.array(*cols(a)), F.array(*cols(b))).alias("a")).first()
        assert row.l == pytest.approx(row.a)
    for f in (polynomials.sum_odd, polynomials.sum_even, polynomials.degree, lambda c: polynomials.evaluate(c, F.lit(x))):
        row = one.select(f(cols(a)).alias("l"), f(F.array(*cols(a))).alias("a")).first()
        assert row.l == pytest.approx(row.a)
    with pytest.raises(ValueError):
        polynomials.multiply([], cols(b))


def test_steps_give_what_lambdas_give(spark):
    df = spark.createDataFrame([(1, 0.3, -1.0), (2, -2.0, 0.0)], "k int, w double, x double")
    make = lambda: quaternions.log(quaternions.normalized(quaternions.quaternion(df.w, df.x, 0.5, 2.0)))
    with quaternions.steps() as kept:
        column = quaternions.let(make(), lambda v: v)
    assert quaternions.with_steps(df, kept, "k").select(column).collect() == df.select(make()).collect()


def test_stacks_give_what_single_matrices_give():
    from tessera.operators import matrix

    r = np.random.default_rng(1)
    m = r.normal(size=(200, 3, 3))
    m[0], m[1] = np.diag([1.0, 2.0, 3.0]), np.eye(3)[[1, 0, 2]] + 0.0
    spd, b = m @ np.swapaxes(m, 1, 2) + np.eye(3), r.normal(size=(200, 3, 1))
    f, p = matrix.lu_many(m)
    near = lambda x, y: np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)
    near(f, [matrix.lu(x)[0] for x in m])
    near(matrix.det_many(f, p), [matrix.det(x) for x in m])
    near(matrix.solve_lu_many(f, p, b), [matrix.solve(x, y) for x, y in zip(m, b)])
    near(matrix.triangular_solve_many(np.tril(spd), b, True), [matrix.triangular_solve(np.tril(x), y, True) for x, y in zip(spd, b)])
    near(matrix.cholesky_many(spd), [matrix.cholesky(x) for x in spd])
    near(matrix.inverse_small_many(spd[:, :2, :2]), [matrix.inverse_small(x[:2, :2])[0] for x in spd])
    for got, want in zip(matrix.qr_many(m), zip(*(matrix.qr(x) for x in m))):
        near(got, want)
    for got, want in zip(matrix.householder_many(m[:, :, 0]), zip(*(matrix.householder(x) for x in m[:, :, 0]))):
        near(got, want)
    for got, want in zip(matrix.jacobi_many(spd), zip(*(matrix.jacobi(x) for x in spd))):
        near(got, want)
    near(matrix.singular_values_many(m), [matrix.svd(x)[1] for x in m])
    with pytest.raises(matrix.SingularMatrix):
        matrix.lu_many(np.zeros((2, 2, 2)))
    with pytest.raises(matrix.NotPositiveDefinite):
        matrix.cholesky_many(-spd)


def test_transforms_of_mixed_lengths_and_nulls(spark):
    """Without a Python object per bin, whatever the lengths in a batch."""
    from pyspark.sql import functions as F

    from tessera.operators import signal

    rows = [(1, [1.0, 2.0, 3.0, 5.0]), (2, None), (3, [1.0, -1.0]), (4, [4.0, 0.5, 2.0, 1.0, 0.0, 7.0, 1.5, 2.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").coalesce(1)
    z = signal.fft(F.col("v"))
    got = {r.k: r for r in df.select("k", z.alias("z"), signal.ifft_normalized(z).alias("b"), signal.fft_complex(z).alias("c")).collect()}
    assert got[2].z is None and got[2].b is None and got[2].c is None
    for k, v in rows:
        if v is not None:
            whole = lambda bins: [complex(x["re"], x["im"]) for x in bins]
            assert whole(got[k].z) == pytest.approx(np.fft.fft(v).tolist())
            assert got[k].b == pytest.approx(v)
            assert whole(got[k].c) == pytest.approx(np.fft.fft(np.fft.fft(v)).tolist(), abs=1e-9)


def _word_rows():
    return [(1, "Straße A a, b-b  É é"), (2, None), (3, ""), (4, "\tx y_z «q» a A"), (4, "a a b x"), (None, "n a"), (None, "n"), (5, "one")]


@pytest.mark.parametrize("low, high", [(1, 1), (2, 2), (3, 1)])
def test_counts_of_rows_are_those_of_tokens(spark, low, high):
    from pyspark.sql import functions as F

    from tessera.operators import text

    df = spark.createDataFrame(_word_rows(), "doc_id long, text string")
    want = df.select("doc_id", F.explode(text.tokenize(F.col("text"), low, high)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    got = text.token_counts(df, low=low, high=high)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_counting_shuffles_no_tokens_of_single_rows(spark):
    from tessera.operators import text

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Exchange" not in plan(text.token_counts(docs))
    ranked = plan(text.vocabulary(text.token_counts(docs)))
    assert "MapInArrow" not in ranked  # counted once, before the branches of the ranking


@pytest.mark.parametrize("name", ["token_counts", "vocabulary", "count_vectorize", "most_frequent_bigrams", "tf_idf"])
def test_text_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
