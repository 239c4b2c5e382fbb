"""Fixture values of the operators, and the quirks that set them apart from Spark's own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import core
from tessera.operators import binning, encoders, geometry, graph, matrix, metrics, models, scalers, signal, splits, stats, text
from tessera.sources import arrays, csv, generators, plots


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 1.0), (2, 3.0, 4.0), (3, 4.0, 3.0)], "id long, a double, b double")


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, v double")


def pairs(a, b):
    return [(float(x), float(y)) for x, y in zip(a, b)]


def test_column_statistics(four):
    a = stats.column_stats(four, ["a", "b"]).filter("column = 'a'").first()
    assert (a.n, a.mean, a["min"], a["max"], a["sum"]) == (4, 2.5, 1, 4, 10) and a["std"] == pytest.approx(math.sqrt(1.25))
    cov = {(r.i, r.j): r.val for r in stats.covariance_matrix(four, ["a", "b"], 1).collect()}
    assert cov[0, 0] == pytest.approx(5 / 3) and cov[0, 1] == pytest.approx(1.0) == pytest.approx(cov[1, 0])
    cor = {(r.i, r.j): r.val for r in stats.correlation_matrix(four.withColumn("c", F.lit(1.0)), ["a", "b", "c"]).collect()}
    assert cor[0, 1] == pytest.approx(0.6) and cor[0, 2] == 0 and cor[2, 2] == 1
    nan = four.withColumn("a", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("a")))
    assert nan.agg(stats.maximum("a"), stats.minimum("a")).first() == (3.0, 1.0)


def test_histogram(spark):
    assert [r.n for r in stats.histogram(values(spark, [0.5, 1.5, 2.5, 3.5, 4.5]), "v", 2).orderBy("bin").collect()] == [2, 3]
    assert [r.n for r in stats.histogram(values(spark, [3, 3, 3]), "v", 4).orderBy("bin").collect()] == [3, 0, 0, 0]
    with pytest.raises(Exception, match="no values"):
        stats.histogram(values(spark, []), "v", 2).collect()


def test_bins(spark):
    assert [r.bin for r in binning.cut(values(spark, range(6)), "v", 3).orderBy("id").collect()] == ["bin_0", "bin_0", "bin_1", "bin_1", "bin_2", "bin_2"]
    assert [r.bin for r in binning.qcut(values(spark, range(0, 60, 10)), "v", 3).orderBy("id").collect()] == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3"]
    got = values(spark, [-1, 0, 0.5, 1, 1.5, 2, 3]).withColumn("b", binning.digitize(F.col("v"), [0, 1, 2])).orderBy("id").collect()
    assert [r.b for r in got] == [0, 0, 0, 1, 1, 2, 1]


@pytest.mark.parametrize("small", [50_000, 10])
def test_order_statistics(spark, small):
    rng = np.random.default_rng(0)
    for xs in (rng.normal(size=500), rng.integers(0, 3, 500), np.zeros(50)):
        want = np.sort(xs)
        assert core.order_statistics(values(spark, xs), "v", [0, len(xs) // 3, len(xs) - 1], small) == [want[0], want[len(xs) // 3], want[-1]]
    with pytest.raises(ValueError):
        core.order_statistics(values(spark, [1]), "v", [1])


def test_row_index(spark):
    xs = np.random.default_rng(1).permutation(300)
    assert all(r.idx == r.v for r in core.row_index(values(spark, xs), "v", buckets=7).collect())


def test_encoders(spark):
    df = spark.createDataFrame([(0, "cat", "x"), (1, "dog", "y"), (2, "cat", "y"), (3, "bird", "x")], "id long, c string, d string")
    e = encoders.LabelEncoder("c", "id").fit(df)
    assert [r.c for r in e.transform(df).orderBy("id").collect()] == [0, 1, 0, 2]
    assert e.inverse_transform(e.transform(df)).orderBy("id").collect() == df.orderBy("id").collect()
    with pytest.raises(Exception, match="unseen"):
        e.transform(df.withColumn("c", F.lit("new"))).collect()
    with pytest.raises(core.NotFitted):
        encoders.LabelEncoder("c", "id").transform(df)
    h = encoders.OneHotEncoder(["c", "d"], "id").fit(df)
    got = h.transform(df)
    assert [r.onehot for r in got.orderBy("id").collect()] == [[1, 0, 0, 1, 0], [0, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 1, 1, 0]]
    assert h.inverse_transform(got).select("id", "c", "d").orderBy("id").collect() == df.orderBy("id").collect()


def test_scalers(spark):
    two = spark.createDataFrame([(0.0, 7.0), (2.0, 7.0)], "a double, b double")
    assert [r.a for r in scalers.StandardScaler(["a", "b"]).fit_transform(two).collect()] == [-1, 1]
    m = scalers.MinMaxScaler(["a", "b"], 1, 3)
    assert [tuple(r) for r in m.fit_transform(two).collect()] == [(1, 1), (3, 1)]
    assert m.inverse_transform(m.transform(two)).collect() == two.collect()
    five = values(spark, [1, 2, 3, 4, 5])
    assert [r.v for r in scalers.RobustScaler(["v"]).fit_transform(five).orderBy("id").collect()] == [-1, -0.5, 0, 0.5, 1]
    assert scalers.RobustScaler(["v"]).fit_transform(values(spark, [3, 3])).first().v == 3


def test_classification(spark):
    cm = spark.createDataFrame(pairs([0, 1, 1, 0, 1, 0], [0, 1, 0, 0, 1, 1]), "y double, p double")
    assert tuple(metrics.confusion_matrix(cm, "y", "p").first()) == (2, 1, 1, 2)
    prf = spark.createDataFrame(pairs([0, 1, 1, 0, 1], [0, 1, 0, 0, 1]), "y double, p double")
    r = metrics.classification_report(prf, "y", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((0.8, 1, 2 / 3, 0.8))
    s = spark.createDataFrame(pairs([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), "y double, s double")
    assert tuple(metrics.roc_auc(s, "y", "s").first()) == pytest.approx((0.75, 0.5)) and metrics.ks_statistic(s, "y", "s").first().ks == 0.5
    roc = metrics.roc_curve(s, "y", "s").orderBy(F.desc("threshold")).collect()
    assert tuple(roc[0])[1:] == (0, 0) and tuple(roc[-1])[1:] == (1, 1) and len(roc) == 5 and roc[0].threshold == 1.8
    assert metrics.average_precision(s.filter("s > 0.7"), "y", "s").first()[0] == 0
    with pytest.raises(ValueError):
        metrics.roc_curve(s.filter("y = 1"), "y", "s")


def test_regression(spark):
    df = spark.createDataFrame(pairs([3, -0.5, 2, 7], [2.5, 0, 2, 8]), "y double, p double")
    m = metrics
    row = df.agg(m.mean_squared_error("y", "p"), m.mean_absolute_error("y", "p"), m.r2_score("y", "p"), m.explained_variance("y", "p"), m.max_error("y", "p")).first()
    assert tuple(row) == pytest.approx((0.375, 0.5, 0.948608137, 0.9571734475, 1))
    assert m.median_absolute_error(df, "y", "p") == 0.5
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert flat.agg(m.r2_score("y", "p")).first()[0] == 0
    with pytest.raises(Exception, match="other than 0"):
        flat.agg(m.mean_absolute_percentage_error("y", "p")).collect()


def test_splits(spark):
    eight = values(spark, [0, 0, 1, 1, 0, 1, 0, 1])
    assert splits.train_test_split(eight, "id", seed=3).filter("is_test").count() == 2
    assert [r.id for r in splits.train_test_split(eight.limit(4), "id").filter("is_test").collect()] == [3]
    strat = splits.train_test_split(eight, "id", 0.25, 1, "v").filter("is_test").collect()
    assert sorted(r.v for r in strat) == [0, 1]
    ten = values(spark, range(10))
    assert sorted(r["count"] for r in splits.k_fold(ten, "id", 3, seed=1).groupBy("fold").count().collect()) == [3, 3, 4]
    assert [len(r.test_in) for r in splits.shuffle_split(ten, "id", 3, 0.2).collect()] and splits.shuffle_split(ten, "id", 3).select(F.explode("test_in").alias("s")).groupBy("s").count().filter("count = 2").count() == 3


def test_text(spark):
    df = spark.createDataFrame([(0, "Hello, world!"), (1, "a b c"), (2, "tab\tin É")], "doc_id long, text string")
    rows = df.select(text.tokenize(F.col("text")).alias("w"), text.tokenize(F.col("text"), 2, 1).alias("n"), text.tokenize(F.col("text"), lowercase=False, strip=False).alias("raw")).collect()
    assert rows[0].w == ["hello", "world"] and rows[0].raw == ["Hello,", "world!"] and rows[1].n == ["a", "b", "c", "a_b", "b_c"] and rows[2].w == ["tab\tin", "É"]
    words = {"walked": "walk", "running": "runn", "cats": "cat", "flies": "fly", "tried": "try"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words
    three = spark.createDataFrame([(0, "hello world"), (1, "hello hello world"), (2, "foo bar")], "doc_id long, text string")
    tf = {(r.doc_id, r.token): r.val for r in text.tf_idf(three).collect()}
    assert tf[0, "hello"] == 0 and tf[2, "foo"] > 0
    v = text.vocabulary(text.token_counts(three)).orderBy("col").collect()
    assert [r.token for r in v] == ["hello", "world", "bar", "foo"] and [r.col for r in v] == [0, 1, 2, 3]
    with pytest.raises(core.NotFitted):
        text.CountVectorizer().transform(three)


def test_linear_models(spark):
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    m = models.LinearRegression(["x"]).train(line, "y")
    assert (m.theta[0], m.bias) == pytest.approx((2, 1)) and m.cost(line, "y") == pytest.approx(0, abs=1e-12)
    noisy = spark.createDataFrame(list(zip(map(float, range(5)), [1.001, 2.998, 5.002, 6.999, 9.001])), "x double, y double")
    lasso = models.Lasso(["x"]).train(noisy, "y", 2000, 0.001)
    net = models.ElasticNet(["x"]).train(noisy, "y", 2000, 0.001, 0.5, 1.0)
    assert (lasso.theta[0], lasso.bias) == pytest.approx((2, 1), abs=2e-3) and (net.theta[0], net.bias) == pytest.approx((2, 1), abs=1e-2)
    logit = spark.createDataFrame([(-1.0, 0.0), (-0.5, 0.0), (0.5, 1.0), (1.0, 1.0)], "x double, y double")
    g = models.LogisticRegression(["x"]).train(logit, "y", 20, 0.5)
    p = {r.x: r.prediction for r in g.predict(logit).collect()}
    assert p[-1.0] < 0.5 < p[1.0] and g.cost(logit, "y") < math.log(2)
    with pytest.raises(core.NotFitted):
        models.Lasso(["x"]).decision()


def test_clusters_and_neighbours(spark):
    pts = [(0, 0.1), (0.1, 0), (-0.1, 0), (0, -0.1), (5, 5.1), (5.1, 5), (4.9, 5), (5, 4.9)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    k = models.KMeans(["x", "y"], np.array([[0.0, 0], [5, 5]])).train(df)
    assert np.allclose(k.centroids, [[0, 0], [5, 5]], atol=0.2) and k.assign(df).groupBy("cluster").count().filter("count = 4").count() == 2
    assert (models.KMeans(["x", "y"], np.array([[2.0, 2], [99, 99]])).train(df, 1).centroids[1] == 0).all()
    train = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [10.0, 10.0], 1), (3, [9.0, 8.0], 0)], "id long, features array<double>, label int")
    q = spark.createDataFrame([(7, [9.5, 9.5]), (8, [1.0, 0.0])], "query_id long, features array<double>")
    assert {r.query_id: r.prediction for r in models.knn_predict(q, train, 1).collect()} == {7: 1, 8: 0}
    assert {r.query_id: r.prediction for r in models.knn_predict(q, train, 2).collect()} == {7: 1, 8: 0}  # tied, so k - 1


def test_knn_orders_equal_distances_by_id(spark):
    rows = [(i, [0.1, 0.7, 0.3], float(i < 5)) for i in range(400)][::-1] + [(1000 + i, [9.0 + i, 9.0, 9.0], 0.0) for i in range(50)]
    train = spark.createDataFrame(rows, "id long, features array<double>, label double").coalesce(1)
    q = spark.createDataFrame([(7, [0.1, 0.7, 0.3]), (8, [0.2, 0.1, 0.4])], "query_id long, features array<double>")
    assert {r.query_id: r.prediction for r in models.knn_predict(q, train, 5).collect()} == {7: 1, 8: 1}


def test_trees_and_machines(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (1, 1.0, 2.0, 0.0), (2, 2.0, 1.0, 1.0), (3, 2.0, 2.0, 1.0)], "id long, a double, b double, y double")
    x, y = np.array([[1, 1], [1, 2], [2, 1], [2, 2]]), np.array([0, 0, 1, 1])
    for c in ("gini", "entropy"):
        t = models.DecisionTree(criterion=c).fit(x, y)
        assert [r[0] for r in df.orderBy("id").select(t.predict([F.col("a"), F.col("b")])).collect()] == [0, 0, 1, 1]
    assert models.bootstrap(3, 0) == [12345 % 3, (12345 * 1103515245 + 12345) % 2**32 % 2**31 % 3, models.bootstrap(3, 0)[2]]
    f = models.RandomForest(5).train(df, ["a", "b"], "y", "id")
    assert all(0 <= r[0] <= 1 for r in df.select(f.predict_proba([F.col("a"), F.col("b")])).collect()) and f.feature_importance() == [0, 0]
    s = models.SVM().train([[0, 0], [0, 1], [1, 0], [3, 3], [3, 4], [4, 3]], [-1, -1, -1, 1, 1, 1])
    got = spark.createDataFrame([(-1.0, -1.0), (5.0, 5.0)], "a double, b double").select(s.predict([F.col("a"), F.col("b")])).collect()
    assert [r[0] for r in got] == [-1, 1]


def test_graph(spark):
    e = spark.createDataFrame([(0, 0, 1, 5.0), (1, 1, 2, 3.0), (2, 2, 3, 1.0), (3, 0, 3, 10.0)], "edge_id long, u long, v long, w double")
    d = {(r.i, r.j): r.dist for r in graph.distance_grid(e).collect()}
    assert d[0, 3] == 9 and d[3, 0] == math.inf and len(d) == 16
    known = graph.shortest_from(e, 0)
    assert graph.path_to(known, 0, 3) == [0, 1, 2, 3] and graph.path_to(known, 0, 0) == [0] and graph.path_to(graph.shortest_from(e, 3), 3, 0) == []
    assert graph.shortest_from(e, 0, hops=True).filter("v = 3").first().dist == 1
    assert {r.u: r.out for r in graph.neighbours(e).collect()}[0] == [1, 3] and graph.n_vertices(e) == 4
    assert graph.last_wins(e.unionByName(e.limit(1).withColumn("edge_id", F.lit(9).cast("long")).withColumn("w", F.lit(1.0)))).filter("u = 0 AND v = 1").first().w == 1


def test_geometry(spark):
    b = geometry.Bins(["x", "y"], [0, 0], [10, 10], [2, 2])
    pts = spark.createDataFrame([(10, 1.0, 1.0), (20, 1.5, 1.5), (30, 6.0, 6.0), (40, 5.2, 1.0)], "id long, x double, y double")
    q = spark.createDataFrame([(1, 1.1, 1.1), (2, 4.9, 1.0)], "id long, x double, y double")
    assert sorted((r.q_id, r.id) for r in b.near(pts, q, 1.0).collect()) == [(1, 10), (1, 20)]
    assert sorted((r.q_id, r.id) for r in b.near(pts, q, 1.0, neighbours=True).collect()) == [(1, 10), (1, 20), (2, 40)]
    assert b.first_near(pts, q, 0.5, "id", "id").collect()[0].id == 10
    s = geometry.segment(geometry.point(F.lit(0.0), F.lit(0.0)), geometry.point(F.lit(4.0), F.lit(0.0)))
    row = spark.range(1).select(*(geometry.distance_to_segment(s, geometry.point(F.lit(x), F.lit(y))) for x, y in ((1.0, -3.0), (-3.0, 4.0), (7.0, 4.0)))).first()
    assert tuple(row) == pytest.approx((3, 5, 5))


def test_matrices(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)], "i long, j long, val double")
    x = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 6.0)], "i long, val double")
    assert {r.i: r.val for r in matrix.spmv(a, x).collect()} == {0: 16, 1: 15}
    assert matrix.to_dense(a, 2, 3).count() == 6
    rng = np.random.default_rng(3)
    m, n = rng.normal(size=(4, 4)), rng.normal(size=(4, 4))
    coo = lambda z: spark.createDataFrame([(i, j, float(z[i, j])) for i in range(4) for j in range(4)], "i long, j long, val double")
    dense = lambda t: np.array([[next((r.val for r in rows if (r.i, r.j) == (i, j)), 0.0) for j in range(4)] for i in range(4)]) if (rows := t.collect()) else None
    assert np.allclose(dense(matrix.gemm(coo(m), coo(n), 2.0, coo(n), 3.0, trans_a=True)), 2 * m.T @ n + 3 * n)
    assert np.allclose(dense(matrix.syrk(coo(m), "lower")), np.tril(m @ m.T)) and np.allclose(dense(matrix.trmm(coo(m), coo(n), "upper", unit=True)), (np.triu(m, 1) + np.eye(4)) @ n)
    assert np.allclose(matrix.inverse(m) @ m, np.eye(4)) and matrix.det(m) == pytest.approx(np.linalg.det(m)) and np.allclose(matrix.solve_lu(*matrix.lu(m)[:2], n, trans=True), np.linalg.solve(m.T, n))
    spd = m @ m.T + np.eye(4)
    assert np.allclose(matrix.cholesky(spd) @ matrix.cholesky(spd).T, spd) and np.allclose(np.sort(matrix.jacobi(spd)[0]), np.linalg.eigvalsh(spd))
    t = rng.normal(size=(5, 3))
    q, r = matrix.qr(t)
    u, s, vt = matrix.svd(t)
    assert np.allclose(q @ r, t) and np.allclose(q.T @ q, np.eye(3)) and np.allclose((u * s) @ vt, t) and np.allclose(s, np.linalg.svd(t)[1])
    assert np.allclose(matrix.trsm(np.tril(m), n, True), np.linalg.solve(np.tril(m), n)) and np.allclose(matrix.inverse_small(m[:3, :3])[0], np.linalg.inv(m[:3, :3]))
    with pytest.raises(core.SingularMatrix):
        matrix.det(np.zeros((2, 2)))
    with pytest.raises(core.NotPositiveDefinite):
        matrix.cholesky(-np.eye(2))


def test_signal(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], list(range(5)))], "v array<double>, o array<int>")
    row = df.select(signal.fft(F.col("v")).alias("z"), signal.fftshift(F.col("o")).alias("s"), signal.ifftshift(F.col("o")).alias("i"), signal.ifft_normalized(signal.fft(F.col("v"))).alias("back")).first()
    assert [(z.re, z.im) for z in row.z] == [(1, 0)] * 4 and row.s == [2, 3, 4, 0, 1] and row.i == [3, 4, 0, 1, 2] and row.back == [1, 0, 0, 0]
    with pytest.raises(Exception, match="power of two"):
        df.select(signal.fft(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).collect()
    k = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double")
    got = signal.interpolate(values(spark, [0.5, 1.5, -1, 4, 3, 0]), k, x="v").orderBy("id").collect()
    assert [r.y for r in got] == [0.5, 2.5, 0, 9, 9, 0]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\n\nskip me\nx,y,z\n 1.0, \"2.0\",3\n# more\n4,5,6\n7,8,9\n")
    df = csv.read_csv(spark, str(tmp_path / "a.csv"), skip_rows=1, skip_header=True, max_rows=2)
    assert df.columns == ["row", "x", "y", "z"] and [tuple(r) for r in df.orderBy("row").collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    assert csv.column_by_index(df, 2).columns == ["row", "z"]
    for bad in (lambda: csv.column_by_name(df, "no"), lambda: csv.column_by_index(df, 3)):
        with pytest.raises(IndexError):
            bad()
    (tmp_path / "b.csv").write_text("1.0,not_a_number\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read_csv(spark, str(tmp_path / "b.csv")).collect()
    csv.write_csv(df, str(tmp_path / "out"), ["x", "y"])
    assert sorted(spark.read.csv(str(tmp_path / "out"), header=True).first()) == ["1.000000", "2.000000"]


def test_array_store_and_stubs(spark, tmp_path):
    store = arrays.ArrayStore(spark, str(tmp_path / "s"))
    store.write("m", spark.createDataFrame([(0, 0, 1.0), (1, 2, 5.0)], "i long, j long, val double"), 2, {"scale": 2.5})
    assert store.shape("m") == (2, 3) and store.attribute("m", "scale") == 2.5 and store.read("m").count() == 2
    for stub in (arrays.H5File("x", "r").open, arrays.Mpi().send, arrays.CudaBackend().gemm):
        with pytest.raises(NotImplementedError):
            stub()
    assert arrays.compute_backend("cpu") == "spark"


def test_generators(spark):
    g = generators
    assert [r.val for r in g.combinations(spark, 4, 2).orderBy("idx").collect()] == [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]
    assert [r.val for r in g.permutations(spark, 3).orderBy("idx").collect()] == [[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]
    assert [r.p for r in g.primes(spark, 30, 7).orderBy("p").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert [r.val for r in g.cycle(spark, ["a", "b"], 3).orderBy("idx").collect()] == ["a", "b", "a"] and len(g.items_permutations("abc")) == 6
    assert [r.val for r in g.int_range(spark, 5, 0, -2).orderBy("idx").collect()] == [5, 3, 1]


def test_figures(tmp_path):
    f = plots.Figure().scatter([1], [2]).line([1], [2]).bar(["a"], [1]).heatmap([[1]]).pie(["a"], [1]).surface([[1]]).contour([[1]]).box([1]).violin([1]).histogram([1]).histogram2d([1], [2]).ohlc([1], [2], [0], [1], ["d"]).candlestick([1], [2], [0], [1], ["d"]).waterfall(["a"], [1], ["total"]).sunburst(["a"], ["A"], [""], [1]).treemap(["a"], ["A"], [""], [1]).sankey(["a", "b"], [0], [1], [3]).table(["h</script>"], [["c"]])
    assert len(f.traces) == 18 and f.to_html().count("</script>") == 2
    f.save_html(str(tmp_path / "deep" / "f.html"))
    assert (tmp_path / "deep" / "f.html").exists()
    with pytest.raises(ValueError):
        plots.Figure().scatter([1], [1, 2])
    assert len(plots.feature_importance_figure([1, 3, 2], ["a", "b", "c"], 2).traces[0]["x"]) == 2
