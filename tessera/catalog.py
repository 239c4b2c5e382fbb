"""The registered queries of the package (without the llm subpackage) and their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import complexes, easings, numerics, polynomials, quaternions, scalars, special
from tessera.functions import noise as noise_functions
from tessera.operators import binning, encoders, geometry, graph, matrix, metrics, models, scalers, signal, splits, stats, text
from tessera.sources import csv, generators
from tessera.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded, as sums depend on the order of rows; -0 becomes 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c, t in df.dtypes if t == "double" and (not columns or c in columns)})


# --- statistics ------------------------------------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) + 0.0 AS mean, round(stddev_pop({c}), 4) + 0.0 AS std, min({c}) AS min, max({c}) AS max, round(sum({c}), 2) + 0.0 AS sum FROM lineitem" for c in NUMERIC))
def col_stats_lineitem(spark, sf_dir):
    df = stats.column_stats(table(spark, sf_dir, "lineitem"), NUMERIC)
    return df.withColumns({"mean": F.round("mean", 4) + 0.0, "std": F.round("std", 4) + 0.0, "sum": F.round("sum", 2) + 0.0})


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({a}, {b}), 3) + 0.0 AS val FROM lineitem" for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC)))
def covariance_lineitem(spark, sf_dir):
    return rounded(stats.covariance_matrix(table(spark, sf_dir, "lineitem"), NUMERIC, ddof=1), 3)


@query("WITH t AS (SELECT *, 1.0::DOUBLE AS c FROM lineitem) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, " + (f"round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 6) + 0.0") + " AS val FROM t" for i, a in enumerate([*NUMERIC, "c"]) for j, b in enumerate([*NUMERIC, "c"]) if i != j) + " UNION ALL SELECT i, i AS j, 1.0::DOUBLE AS val FROM range(5) r(i)")
def correlation_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("c", F.lit(1.0))
    return rounded(stats.correlation_matrix(df, [*NUMERIC, "c"]))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 6) + 0.0 AS l_quantity FROM lineitem")
def center_lineitem(spark, sf_dir):
    return rounded(stats.center(table(spark, sf_dir, "lineitem"), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 5) + 0.0 AS l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)")
def standardize_lineitem(spark, sf_dir):
    return rounded(stats.standardize(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_extendedprice"), 5)


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / w), 9)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT b::INT AS bin, round(lo + b * w, 4) AS lo, round(lo + (b + 1) * w, 4) AS hi, coalesce(n, 0) AS n FROM range(10) r(b) CROSS JOIN e LEFT JOIN c ON c.bin = b")
def hist_price(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10), 4)


# --- preprocessing ---------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CASE " + " ".join(f"WHEN l_extendedprice <= lo + {i + 1} * ((hi - lo) / 5) THEN 'bin_{i}'" for i in range(4)) + " ELSE 'bin_4' END AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem, e GROUP BY 1")
def cut_price(spark, sf_dir):
    return binning.cut(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


_ORDER = "WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem), "


@query(_ORDER + "e AS (SELECT " + ", ".join(f"max(CASE WHEN i = floor({k} / 4.0 * (n - 1)) THEN v END) AS e{k}" for k in range(1, 4)) + " FROM o) SELECT CASE WHEN v <= e1 THEN 'Q1' WHEN v <= e2 THEN 'Q2' WHEN v <= e3 THEN 'Q3' ELSE 'Q4' END AS bin, count(*) AS n, min(v) AS low, max(v) AS high FROM o, e GROUP BY 1")
def qcut_price(spark, sf_dir):
    return binning.qcut(table(spark, sf_dir, "lineitem"), "l_extendedprice", 4).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT l_quantity, CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity = 40 THEN 3 WHEN l_quantity > 40 THEN 2 WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def digitize_quantity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_quantity", binning.digitize(F.col("l_quantity"), [5, 10, 20, 40]).alias("bin")).agg(F.count("*").alias("n"))


_CODES = "WITH f AS (SELECT {c} AS c, min(p_partkey) AS k FROM part GROUP BY 1), v AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS code FROM f) "


@query(_CODES.format(c="p_brand") + "SELECT p_partkey, code AS p_brand FROM part JOIN v ON c = p_brand")
def label_encode_brand(spark, sf_dir):
    return encoders.LabelEncoder("p_brand", "p_partkey").fit_transform(table(spark, sf_dir, "part")).select("p_partkey", "p_brand")


@query("WITH f AS (SELECT p_brand AS c, min(p_partkey) AS k FROM part GROUP BY 1), v AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS code FROM f), g AS (SELECT p_type AS c, min(p_partkey) AS k FROM part GROUP BY 1), w AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS code FROM g) SELECT p_partkey, v.code AS p_brand, w.code AS p_type FROM part JOIN v ON v.c = p_brand JOIN w ON w.c = p_type")
def ordinal_encode_part(spark, sf_dir):
    return encoders.OrdinalEncoder(["p_brand", "p_type"], "p_partkey").fit_transform(table(spark, sf_dir, "part")).select("p_partkey", "p_brand", "p_type")


@query("SELECT p_partkey, p_brand, p_type FROM part")
def ordinal_round_trip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    e = encoders.OrdinalEncoder(["p_brand", "p_type"], "p_partkey").fit(part)
    return e.inverse_transform(e.transform(part)).select("p_partkey", "p_brand", "p_type")


@query("WITH f AS (SELECT c_mktsegment AS c, min(c_custkey) AS k FROM customer GROUP BY 1), v AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS code FROM f) SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM v) AS width, code + 1 AS one_at FROM customer JOIN v ON c = c_mktsegment")
def onehot_segment(spark, sf_dir):
    df = encoders.OneHotEncoder(["c_mktsegment"], "c_custkey").fit_transform(table(spark, sf_dir, "customer"))
    return df.select("c_custkey", "c_mktsegment", F.size("onehot").cast("long").alias("width"), F.array_position("onehot", F.lit(1.0)).alias("one_at"))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standard_scaler(spark, sf_dir):
    return rounded(scalers.StandardScaler(["c_acctbal"]).fit_transform(table(spark, sf_dir, "customer")).select("c_custkey", "c_acctbal"))


@query("SELECT c_custkey, round((c_acctbal - a) / (b - a) * 2 - 1, 6) + 0.0 AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def minmax_scaler(spark, sf_dir):
    return rounded(scalers.MinMaxScaler(["c_acctbal"], -1.0, 1.0).fit_transform(table(spark, sf_dir, "customer")).select("c_custkey", "c_acctbal"))


@query("WITH o AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer), q AS (SELECT max(CASE WHEN i = floor(0.25 * (n - 1)) THEN v END) AS q1, max(CASE WHEN i = floor(0.75 * (n - 1)) THEN v END) AS q3, median(v) AS m FROM o) SELECT c_custkey, round((c_acctbal - m) / (q3 - q1), 6) + 0.0 AS c_acctbal FROM customer, q")
def robust_scaler(spark, sf_dir):
    return rounded(scalers.RobustScaler(["c_acctbal"]).fit_transform(table(spark, sf_dir, "customer")).select("c_custkey", "c_acctbal"))


# --- metrics ---------------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_discount").alias("score"), (F.col("l_tax") * 12).alias("p"))


_SCORED = "WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_discount AS score, l_tax * 12 AS p FROM lineitem), "
_CURVE = _SCORED + "g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g) "


@query(_SCORED + "q AS (SELECT y >= 0.5 AS a, p >= 0.5 AS b FROM s) SELECT count(*) FILTER (NOT a AND NOT b) AS tn, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (a AND b) AS tp FROM q")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), "y", "p")


@query("WITH m AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels), r AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m) SELECT round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r")
def label_metrics(spark, sf_dir):
    return rounded(metrics.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query(_CURVE + "SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT max(score) + 1, 0.0, 0.0 FROM c")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(_scored(spark, sf_dir), "y", "score"), 6, "fpr", "tpr")


@query(_CURVE + ", t AS (SELECT tp / p AS y, fp / n AS x, lag(tp / p, 1, 0) OVER (ORDER BY score DESC) AS y0, lag(fp / n, 1, 0) OVER (ORDER BY score DESC) AS x0 FROM c) SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS auc, round(2 * sum((x - x0) * (y + y0) / 2) - 1, 6) AS gini FROM t")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored(spark, sf_dir), "y", "score"))


@query(_CURVE + "SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c")
def precision_recall_curve(spark, sf_dir):
    return rounded(metrics.precision_recall_curve(_scored(spark, sf_dir), "y", "score"), 6, "precision", "recall")


@query(_CURVE + "SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM c WHERE score < (SELECT max(score) FROM c)")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_scored(spark, sf_dir), "y", "score"))


@query(_CURVE + "SELECT round(max(abs(tp / p - fp / n)), 6) AS ks FROM (SELECT sum(pos) OVER (ORDER BY score) AS tp, sum(neg) OVER (ORDER BY score) AS fp, p, n FROM c)")
def ks_statistic(spark, sf_dir):
    return rounded(metrics.ks_statistic(_scored(spark, sf_dir), "y", "score"))


@query(_SCORED + "q AS (SELECT y, least(greatest(p, 1e-15), 1 - 1e-15) AS p FROM s) SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM q")
def log_loss(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).agg(metrics.log_loss("y", "p").alias("log_loss")))


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_extendedprice") / 1500).alias("p"))


@query("WITH s AS (SELECT l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem) SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 5) AS r2, round(avg(abs((y - p) / y)) FILTER (y <> 0) * 100, 4) AS mape, round(1 - var_pop(y - p) / var_pop(y), 5) AS explained, round(max(abs(y - p)), 5) AS max_error, round(avg(pow(ln(1 + y) - ln(1 + p), 2)), 6) AS msle FROM s")
def regression_metrics(spark, sf_dir):
    m = metrics
    return _priced(spark, sf_dir).agg(
        F.round(m.mean_squared_error("y", "p"), 4).alias("mse"), F.round(m.root_mean_squared_error("y", "p"), 5).alias("rmse"), F.round(m.mean_absolute_error("y", "p"), 5).alias("mae"), F.round(m.r2_score("y", "p"), 5).alias("r2"),
        F.round(m.mean_absolute_percentage_error("y", "p"), 4).alias("mape"), F.round(m.explained_variance("y", "p"), 5).alias("explained"), F.round(m.max_error("y", "p"), 5).alias("max_error"), F.round(m.mean_squared_log_error("y", "p"), 6).alias("msle"),
    )


@query("SELECT round(median(abs(l_quantity - l_extendedprice / 1500)), 6) AS medae FROM lineitem")
def median_absolute_error(spark, sf_dir):
    return spark.createDataFrame([(round(metrics.median_absolute_error(_priced(spark, sf_dir), "y", "p"), 6),)], "medae double")


# --- splits ----------------------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, i >= n - greatest(1, least(n - 1, floor(n * 0.25 + 0.5))) AS is_test FROM o")
def train_test_split(spark, sf_dir):
    return splits.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT - 1 AS fold FROM orders")
def k_fold(spark, sf_dir):
    return splits.k_fold(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "fold")


@query("WITH f AS (SELECT ntile(5) OVER (ORDER BY o_orderkey) AS f FROM orders) SELECT (f - 1)::INT AS fold, count(*) AS n FROM f GROUP BY 1")
def k_fold_shuffled_sizes(spark, sf_dir):
    return splits.k_fold(table(spark, sf_dir, "orders"), "o_orderkey", 5, seed=7).groupBy("fold").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT - 1 AS fold FROM orders")
def stratified_k_fold(spark, sf_dir):
    return splits.stratified_k_fold(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "fold")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS fold FROM customer")
def leave_one_out(spark, sf_dir):
    return splits.leave_one_out(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "fold")


@query("SELECT s::INT AS split, floor((SELECT count(*) FROM customer) * 0.2 + 0.5)::BIGINT AS n FROM range(3) r(s)")
def shuffle_split_sizes(spark, sf_dir):
    df = splits.shuffle_split(table(spark, sf_dir, "customer"), "c_custkey", 3, 0.2, seed=5)
    return df.select(F.explode("test_in").alias("split")).groupBy("split").agg(F.count("*").alias("n"))


# --- text ------------------------------------------------------------------------------------------------------------

_TOKENS = "WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{-~]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS token FROM d), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL) "


@query(_TOKENS + "SELECT doc_id, len(w)::INT AS n_tokens, list_distinct(w).len()::INT AS n_distinct FROM d")
def tokenize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(_TOKENS + "SELECT doc_id, token, n FROM c")
def token_counts(spark, sf_dir):
    return text.token_counts(table(spark, sf_dir, "documents"))


@query(_TOKENS + ", v AS (SELECT token, sum(n)::BIGINT AS total, count(*) AS df FROM c GROUP BY 1) SELECT token, total, df, (row_number() OVER (ORDER BY total DESC, token) - 1)::INT AS col FROM v")
def vocabulary(spark, sf_dir):
    return text.vocabulary(text.token_counts(table(spark, sf_dir, "documents")))


@query(_TOKENS + ", v AS (SELECT token, row_number() OVER (ORDER BY sum(n) DESC, token) - 1 AS col FROM c GROUP BY 1 QUALIFY col < 500) SELECT doc_id, col::INT AS col, n::DOUBLE AS val FROM c JOIN v USING (token)")
def count_vectorize(spark, sf_dir):
    return text.CountVectorizer(max_features=500).fit_transform(table(spark, sf_dir, "documents"))


@query(_TOKENS + ", b AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS z FROM d WHERE len(w) > 1), g AS (SELECT z[1] || '_' || z[2] AS token FROM b) SELECT token, count(*) AS total, (row_number() OVER (ORDER BY count(*) DESC, token) - 1)::INT AS col FROM g GROUP BY 1 QUALIFY col < 20")
def most_frequent_bigrams(spark, sf_dir):
    return text.most_frequent_ngrams(table(spark, sf_dir, "documents"), 2, 20)


@query(_TOKENS + ", v AS (SELECT token, count(*) AS df FROM c GROUP BY 1) SELECT doc_id, token, round(ln(1 + n) * ln((SELECT count(*) FROM documents) / (1 + df)), 6) + 0.0 AS val FROM c JOIN v USING (token)")
def tf_idf(spark, sf_dir):
    return rounded(text.tf_idf(table(spark, sf_dir, "documents")))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, CASE WHEN length(word) >= 8 AND word LIKE '%ational' THEN left(word, -7) || 'ate' WHEN length(word) >= 7 AND word LIKE '%tional' THEN left(word, -6) || 'tion' WHEN length(word) >= 5 AND word LIKE '%izer' THEN left(word, -4) || 'ize' WHEN length(word) >= 5 AND word LIKE '%ator' THEN left(word, -4) || 'ate' WHEN length(word) >= 4 AND (word LIKE '%ies' OR word LIKE '%ied') THEN left(word, -3) || 'y' WHEN length(word) >= 4 AND word LIKE '%ing' THEN left(word, -3) WHEN length(word) >= 3 AND word LIKE '%ed' THEN left(word, -2) WHEN length(word) >= 3 AND word LIKE '%s' THEN left(word, -1) ELSE word END AS stem FROM w")
def stem_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("stem", text.stem(F.col("word")))


# --- models ----------------------------------------------------------------------------------------------------------


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS theta, round(regr_intercept(l_extendedprice, l_quantity), 2) AS bias FROM lineitem")
def linear_regression(spark, sf_dir):
    m = models.LinearRegression(["l_quantity"]).train(_line(spark, sf_dir), "l_extendedprice")
    return spark.createDataFrame([(round(float(m.theta[0]), 3), round(float(m.bias), 2))], "theta double, bias double")


@query("WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000) AS t, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem) SELECT round(t, 3) AS theta, round(my - t * mx, 2) AS bias FROM s")
def ridge_regression(spark, sf_dir):
    m = models.Ridge(["l_quantity"]).train(_line(spark, sf_dir), "l_extendedprice", 1000.0)
    return spark.createDataFrame([(round(float(m.theta[0]), 3), round(float(m.bias), 2))], "theta double, bias double")


@query("WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem) SELECT round((c - 500) / v, 2) AS theta, round(my - (c - 500) / v * mx, 1) AS bias FROM s")
def lasso_regression(spark, sf_dir):
    m = models.Lasso(["l_quantity"]).train(_line(spark, sf_dir), "l_extendedprice", 400, 1000.0)
    return spark.createDataFrame([(round(float(m.theta[0]), 2), round(float(m.bias), 1))], "theta double, bias double")


@query("WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem) SELECT round((c - 50) / (v + 50), 2) AS theta, round(my - (c - 50) / (v + 50) * mx, 1) AS bias FROM s")
def elastic_net_regression(spark, sf_dir):
    m = models.ElasticNet(["l_quantity"]).train(_line(spark, sf_dir), "l_extendedprice", 2000, 100.0, 0.5, 1.0)
    return spark.createDataFrame([(round(float(m.theta[0]), 2), round(float(m.bias), 1))], "theta double, bias double")


def _logistic_sql(epochs: int, rate: float) -> str:
    out = "WITH d AS (SELECT l_discount * 10 AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), e0 AS (SELECT 0.0::DOUBLE AS t, 0.0::DOUBLE AS b)"
    for k in range(epochs):
        out += f", e{k + 1} AS (SELECT any_value(t) - {rate} * avg((1 / (1 + exp(-(b + t * x))) - y) * x) AS t, any_value(b) - {rate} * avg(1 / (1 + exp(-(b + t * x))) - y) AS b FROM d, e{k})"
    return out + f" SELECT round(t, 8) AS theta, round(b, 8) AS bias FROM e{epochs}"


@query(_logistic_sql(5, 0.5))
def logistic_regression(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    m = models.LogisticRegression(["x"]).train(df, "y", 5, 0.5)
    return spark.createDataFrame([(round(float(m.theta[0]), 8), round(float(m.bias), 8))], "theta double, bias double")


def _kmeans_sql(rounds: int) -> str:
    out = "WITH d AS (SELECT l_quantity AS x, l_discount * 100 AS y FROM lineitem), c0 AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE, 2.0::DOUBLE), (1, 25.0, 5.0), (2, 40.0, 8.0)) v(k, a, b))"
    for r in range(rounds):
        out += f", a{r} AS (SELECT x, y, arg_min(k, (x - a) * (x - a) + (y - b) * (y - b)) AS k FROM (SELECT *, row_number() OVER () AS id FROM d), c{r} GROUP BY id, x, y), c{r + 1} AS (SELECT k, avg(x) AS a, avg(y) AS b FROM a{r} GROUP BY k)"
    return out + f" SELECT k, round(a, 6) AS a, round(b, 6) AS b FROM c{rounds}"


@query(_kmeans_sql(3))
def kmeans(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    m = models.KMeans(["x", "y"], np.array([[10.0, 2.0], [25.0, 5.0], [40.0, 8.0]])).train(df, epochs=3)
    return rounded(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(m.centroids)], "k int, a double, b double"))


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, label, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))) AS d FROM q, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM d QUALIFY r <= 5), v AS (SELECT query_id, kk, label, count(*) AS n FROM r, range(1, 6) k(kk) WHERE r <= kk GROUP BY ALL), b AS (SELECT query_id, kk, label, n, max(n) OVER (PARTITION BY query_id, kk) AS top FROM v), u AS (SELECT query_id, kk, max(label) AS label FROM b WHERE n = top GROUP BY ALL HAVING count(*) = 1) SELECT query_id, arg_max(label, kk)::DOUBLE AS prediction FROM u GROUP BY 1")
def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("features"))
    return models.knn_predict(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"), 5)


@query()
def decision_tree(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").cast("double").alias("y")).filter("c_acctbal IS NOT NULL")
    small = models.bounded(df).sort_values("c_custkey")
    tree = models.DecisionTree(max_depth=4).fit(small[["c_acctbal", "c_nationkey"]].to_numpy(float), small["y"].to_numpy())
    return df.select("c_custkey", tree.predict([F.col("c_acctbal"), F.col("c_nationkey")]).alias("prediction"))


@query()
def random_forest(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_nationkey") % 2).cast("double").alias("y"))
    f = models.RandomForest(5, 4).train(df, ["s_acctbal", "s_nationkey"], "y", "s_suppkey")
    cols = [F.col("s_acctbal"), F.col("s_nationkey")]
    return df.select("s_suppkey", f.predict(cols).alias("prediction"), f.predict_proba(cols).alias("proba"))


@query()
def support_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 25.0).alias("a"), F.when(F.col("n_nationkey") < 12, -1.0).otherwise(1.0).alias("y"))
    rows = models.bounded(df).sort_values("n_nationkey")
    m = models.SVM("rbf", 1.0, 2.0).train(rows[["a"]].to_numpy(), rows["y"].to_numpy())
    return df.select("n_nationkey", m.predict([F.col("a")]).alias("prediction"))


# --- graph -----------------------------------------------------------------------------------------------------------


def _trade(spark, sf_dir):
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg(F.round(F.avg("l_extendedprice"), 2).alias("w"))


_TRADE = "e AS (SELECT c_nationkey AS u, s_nationkey AS v, round(avg(l_extendedprice), 2) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_PAIRS = "WITH RECURSIVE " + _TRADE + ", d0 AS MATERIALIZED (SELECT u AS i, v AS j, w AS d FROM e WHERE u <> v UNION ALL SELECT u, u, 0.0 FROM e WHERE u IN (SELECT u FROM e) GROUP BY u)" + "".join(f", d{k + 1} AS MATERIALIZED (SELECT a.i, b.j, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.j = b.i GROUP BY 1, 2)" for k in range(5))


@query(_PAIRS + " SELECT i, j, round(d, 2) + 0.0 AS dist FROM d5")
def all_pairs_paths(spark, sf_dir):
    return rounded(graph.all_pairs(graph.edges_of(_trade(spark, sf_dir), "u", "v", "w")), 2)


@query(_PAIRS + " SELECT j AS v, round(d, 2) + 0.0 AS dist FROM d5 WHERE i = 3")
def single_source_paths(spark, sf_dir):
    return rounded(graph.shortest_from(graph.edges_of(_trade(spark, sf_dir), "u", "v", "w"), 3).select("v", "dist"), 2)


@query("WITH RECURSIVE g AS (SELECT DISTINCT c_nationkey AS u, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey), e AS (SELECT u, (u * 7 + 1) % 25 AS v FROM g UNION SELECT u, (u + 5) % 25 FROM g), b AS (SELECT 0 AS v, 0 AS h UNION SELECT e.v, h + 1 FROM b JOIN e ON e.u = b.v WHERE h < 25) SELECT v, min(h)::DOUBLE AS dist FROM b GROUP BY 1")
def bfs_hops(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("u")).distinct()
    e = g.select("u", F.explode(F.array((F.col("u") * 7 + 1) % 25, (F.col("u") + 5) % 25)).alias("v")).distinct()
    return graph.shortest_from(graph.edges_of(e, "u", "v"), 0, hops=True).select("v", "dist")


@query("SELECT s_nationkey AS u, list(s_suppkey ORDER BY s_suppkey)::VARCHAR AS out FROM supplier GROUP BY 1")
def adjacency(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.col("s_nationkey").alias("u"), F.col("s_suppkey").alias("v"))
    return graph.neighbours(e).select("u", F.concat(F.lit("["), F.array_join(F.transform("out", lambda x: x.cast("string")), ", "), F.lit("]")).alias("out"))


# --- geometry, matrices ----------------------------------------------------------------------------------------------


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))


@query("SELECT least(floor((l_quantity - 0) / (60 / 6)), 5)::BIGINT + least(floor((l_discount * 100) / (12 / 4)), 3)::BIGINT * 6 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def spatial_bins(spark, sf_dir):
    b = geometry.Bins(["x", "y"], [0, 0], [60, 12], [6, 4])
    return b.assign(_points(spark, sf_dir)).groupBy("bin").agg(F.count("*").alias("n"))


_BALANCE = "WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey % 100)::DOUBLE AS y FROM customer), q AS (SELECT s_suppkey AS qid, s_acctbal AS qx, (s_suppkey % 100)::DOUBLE AS qy FROM supplier) "


@query(_BALANCE + "SELECT qid AS q_id, count(*) AS n FROM p, q WHERE (x - qx) * (x - qx) + (y - qy) * (y - qy) <= 900 GROUP BY 1")
def radius_join(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    b = geometry.Bins(["x", "y"], [-2000, 0], [12000, 100], [200, 3])
    return b.near(p, q, 30.0, neighbours=True).groupBy("q_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_quantity - t * 50, 2) + pow(l_discount * 100 - t * 10, 2)), 6) AS d FROM (SELECT *, greatest(0, least(1, (l_quantity * 50 + l_discount * 100 * 10) / 2600)) AS t FROM lineitem)")
def segment_distance(spark, sf_dir):
    p = geometry.point(F.col("x"), F.col("y"))
    s = geometry.segment(geometry.point(F.lit(0.0), F.lit(0.0)), geometry.point(F.lit(50.0), F.lit(10.0)))
    return rounded(_points(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.distance_to_segment(s, p).alias("d")))


@query("WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 3) + 0.0 AS val FROM u a JOIN u b USING (vec_id) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    a = matrix.rows_to_coo(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rounded(matrix.gemm(a, a, trans_a=True), 3)


@query("SELECT vec_id AS i, round(list_sum(list_transform(embedding, lambda x, k: x::DOUBLE * k)), 4) + 0.0 AS val FROM embeddings")
def matrix_vector(spark, sf_dir):
    a = matrix.rows_to_coo(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    x = spark.range(64).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("val"))
    return rounded(matrix.gemv(a, x), 4)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS nrm2, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS asum, (list_position(list_transform(embedding, lambda x: abs(x)), list_max(list_transform(embedding, lambda x: abs(x)))) - 1)::INT AS iamax, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: z[1]::DOUBLE * z[2])), 6) + 0.0 AS dot FROM embeddings")
def vector_blas(spark, sf_dir):
    e = F.col("embedding")
    df = table(spark, sf_dir, "embeddings").select("vec_id", matrix.nrm2(e).alias("nrm2"), matrix.asum(e).alias("asum"), matrix.iamax(e).alias("iamax"), matrix.dot(e, F.reverse(e)).alias("dot"))
    return rounded(df)


@query("SELECT vec_id, round(list_max(s), 6) AS top, round(list_sum(l), 5) + 0.0 AS norm_sum, round(list_max(l), 5) AS norm_top FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - m) / z) AS s, list_transform(embedding, lambda x: (x::DOUBLE - a) / sqrt(v + 1e-5)) AS l FROM (SELECT *, list_max(embedding)::DOUBLE AS m, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)))) AS z, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS a, list_var_pop(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings))")
def softmax_layernorm(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", scalars.softmax(e).alias("s"), scalars.layernorm(e).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + x)
    return df.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), (F.round(total, 5) + 0.0).alias("norm_sum"), F.round(F.array_max("l"), 5).alias("norm_top"))


@query()
def dense_factorizations(spark, sf_dir):
    """Per label: determinant, Cholesky, eigen and singular values of a small Gram matrix, in parallel by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x"), "vec_id")
    g = e.select("label", "vec_id", "i", "x").join(e.select("label", "vec_id", F.col("i").alias("j"), F.col("x").alias("y")), ["label", "vec_id"]).groupBy("label", "i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("val"))

    def run(label, m):
        import pandas as pd

        values, _ = matrix.jacobi(m)
        _, s, _ = matrix.svd(m)
        return pd.DataFrame({"label": [label], "det": [round(matrix.det(m), 3)], "trace": [round(float(values.sum()), 4)], "largest": [round(float(s[0]), 4)], "pivot": [round(float(matrix.cholesky(m)[0, 0]), 4)]})

    return matrix.per_matrix(g, "label", "i", "j", "val", run, "label int, det double, trace double, largest double, pivot double")


# --- signal, functions -----------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value FROM events), n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1) SELECT event_type, k::INT AS k, round(sum(value * cos(-2 * pi() * k * i / n)), 3) + 0.0 AS re, round(sum(value * sin(-2 * pi() * k * i / n)), 3) + 0.0 AS im FROM s JOIN n USING (event_type), range(8) r(k) GROUP BY ALL")
def fourier_bins(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1)
    return rounded(signal.dft_bins(s, "event_type", "i", "value", 8), 3)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * 64, 3) AS energy, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS dc FROM embeddings")
def fft_embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", signal.fft(F.transform("embedding", lambda x: x.cast("double"))).alias("z"))
    return df.select("vec_id", F.round(F.aggregate(signal.power_spectrum(F.col("z")), F.lit(0.0), lambda s, x: s + x), 3).alias("energy"), (F.round(F.col("z")[0]["re"], 4) + 0.0).alias("dc"))


@query("WITH k AS (SELECT c_custkey AS x, c_acctbal AS y, lead(c_custkey) OVER (ORDER BY c_custkey) AS x2, lead(c_acctbal) OVER (ORDER BY c_custkey) AS y2 FROM customer), b AS (SELECT min(x) AS lo, max(x) AS hi FROM k), q AS (SELECT p_partkey, p_retailprice AS v FROM part) SELECT p_partkey, round(CASE WHEN v <= lo THEN (SELECT y FROM k, b WHERE x = lo) WHEN v >= hi THEN (SELECT y FROM k, b WHERE x = hi) ELSE (SELECT y + (v - x) / (x2 - x) * (y2 - y) FROM k WHERE v >= x AND v < x2) END, 5) + 0.0 AS y FROM q, b")
def interpolate(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y"))
    q = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    return rounded(signal.interpolate(q, k, x="v").select("p_partkey", "y"), 5)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY 1")
def ohlc_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("k", F.struct("ts", "event_id"))
    return df.groupBy(F.window("ts", "1 day").alias("w")).agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "open", "high", "low", "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(value) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def windowed_event_stats(spark, sf_dir):
    return rounded(windows.windowed_stats(table(spark, sf_dir, "events"), "ts", "value", "6 hours", keys=("event_type",)), 3, "mean", "std")


_GRID = "SELECT l_orderkey, l_linenumber, "


def _grid(spark, sf_dir, at: Column, /, **columns: Column):
    return table(spark, sf_dir, "lineitem").withColumn("x", at).select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in columns.items()))


def _ease_sql(k: str, n: int) -> dict[str, str]:
    p = lambda v: "*".join([f"({v})"] * n)
    return {f"ease_in_{k}": p("t"), f"ease_out_{k}": f"1-{p('1-t')}", f"ease_in_out_{k}": f"CASE WHEN t < 0.5 THEN {p('2*t')}/2 ELSE 1-{p('2-2*t')}/2 END"}


_EASE = {"linear": "t"} | _ease_sql("quad", 2) | _ease_sql("cubic", 3) | _ease_sql("quart", 4) | _ease_sql("quint", 5)
_EASE |= {"ease_in_sine": "1-cos(t*pi()/2)", "ease_out_sine": "sin(t*pi()/2)", "ease_in_out_sine": "(1-cos(t*pi()))/2", "ease_in_circ": "1-sqrt(1-t*t)", "ease_out_circ": "sqrt(1-(t-1)*(t-1))", "ease_in_out_circ": "CASE WHEN t<0.5 THEN (1-sqrt(1-4*t*t))/2 ELSE (sqrt(1-(2-2*t)*(2-2*t))+1)/2 END"}
_EASE |= {"ease_in_back": "t*t*t-t*sin(t*pi())", "ease_out_back": "1-(pow(1-t,3)-(1-t)*sin((1-t)*pi()))", "ease_in_out_back": "CASE WHEN t<0.5 THEN (pow(2*t,3)-2*t*sin(2*t*pi()))/2 ELSE (1-(pow(2-2*t,3)-(2-2*t)*sin((2-2*t)*pi())))/2+0.5 END"}
_EASE |= {"ease_in_elastic": "CASE WHEN t IN (0,1) THEN t ELSE -pow(2,10*t-10)*sin((t-1-0.075)*2*pi()/0.3) END", "ease_out_elastic": "CASE WHEN t IN (0,1) THEN t ELSE pow(2,-10*t)*sin((t-0.075)*2*pi()/0.3)+1 END", "ease_in_out_elastic": "CASE WHEN t IN (0,1) THEN t WHEN t<0.5 THEN -0.5*pow(2,20*t-10)*sin((20*t-10-0.1125)*2*pi()/0.45) ELSE 0.5*pow(2,10-20*t)*sin((20*t-10-0.1125)*2*pi()/0.45)+1 END"}
_B = lambda v: f"CASE WHEN {v}<4.0/11 THEN 121.0/16*{v}*{v} WHEN {v}<8.0/11 THEN 363.0/40*{v}*{v}-9.9*{v}+3.4 WHEN {v}<0.9 THEN 4356.0/361*{v}*{v}-35442.0/1805*{v}+16061.0/1805 ELSE 10.8*{v}*{v}-20.52*{v}+10.72 END"
_EASE |= {"ease_out_bounce": _B("t"), "ease_in_bounce": f"1-({_B('(1-t)')})", "ease_in_out_bounce": f"CASE WHEN t<0.5 THEN (1-({_B('(1-2*t)')}))/2 ELSE ({_B('(2*t-1)')})/2+0.5 END"}


@query("WITH g AS (SELECT DISTINCT l_discount * 10 AS t FROM lineitem) SELECT round(t, 6) AS t, " + ", ".join(f"round({x}, 6) + 0.0 AS {k}" for k, x in _EASE.items()) + " FROM g")
def easing_curves(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("t")).distinct()
    return rounded(g.select("t", *(f(F.col("t")).alias(k) for k, f in easings.CURVES.items())))


_ACT = {"sigmoid": "1/(1+exp(-x))", "logistic": "1/(1+exp(-x))", "relu": "greatest(x,0)", "leaky_relu": "CASE WHEN x>0 THEN x ELSE 0.01*x END", "elu": "CASE WHEN x>0 THEN x ELSE exp(x)-1 END", "selu": "1.0507009873554805*(CASE WHEN x>0 THEN x ELSE 1.6732632423543772*(exp(x)-1) END)", "gelu": "x/2*(1+tanh(sqrt(2/pi())*(x+0.044715*x*x*x)))", "tanh": "tanh(x)", "softplus": "greatest(x,0)+ln(1+exp(-abs(x)))", "softsign": "x/(1+abs(x))"}


@query("WITH g AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 5 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({x}, 6) + 0.0 AS {k}" for k, x in _ACT.items()) + " FROM g")
def activations(spark, sf_dir):
    x = F.col("x")
    return rounded(_grid(spark, sf_dir, (F.col("l_quantity") - 25) / 5, **{k: f(x) for k, f in scalars.ACTIVATIONS.items()}))


@query("WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(1 + x * (-2 + x * (0.5 + x)), 6) + 0.0 AS p, round(-2 + x + 3 * x * x, 6) + 0.0 AS d FROM g")
def polynomial(spark, sf_dir):
    c = F.array(*(F.lit(v) for v in (1.0, -2.0, 0.5, 1.0)))
    both = polynomials.evaluate_derivatives(c, F.col("x"), 2)
    return rounded(_grid(spark, sf_dir, F.col("l_quantity") / 10, p=both[0], d=both[1]))


@query("SELECT l_orderkey, l_linenumber, round(-b / 2 - sqrt(b * b / 4 - c), 6) + 0.0 AS low, round(-b / 2 + sqrt(b * b / 4 - c), 6) + 0.0 AS high FROM (SELECT *, l_quantity + 5 AS b, l_discount AS c FROM lineitem)")
def quadratic_roots(spark, sf_dir):
    r = polynomials.solve_quadratic(F.lit(1.0), F.col("l_quantity") + 5, F.col("l_discount"))
    return rounded(_grid(spark, sf_dir, F.lit(0.0), low=r[0], high=r[1]))


@query("SELECT l_orderkey, l_linenumber, round(w * 0.5 - x * 0.1 - y * 0.2 - z * 0.3, 6) + 0.0 AS w, round(w * 0.1 + x * 0.5 + y * 0.3 - z * 0.2, 6) + 0.0 AS x, round(w * 0.2 - x * 0.3 + y * 0.5 + z * 0.1, 6) + 0.0 AS y, round(w * 0.3 + x * 0.2 - y * 0.1 + z * 0.5, 6) + 0.0 AS z, round(w * w + x * x + y * y + z * z, 6) AS norm FROM (SELECT *, l_quantity AS w, l_discount AS x, l_tax AS y, 1.0 AS z FROM lineitem)")
def quaternion_product(spark, sf_dir):
    q = quaternions.quaternion(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), 1.0)
    m = quaternions.mul(q, quaternions.quaternion(0.5, 0.1, 0.2, 0.3))
    return rounded(_grid(spark, sf_dir, F.lit(0.0), w=m["w"], x=m["x"], y=m["y"], z=m["z"], norm=quaternions.norm(q)))


@query()
def quaternion_slerp(spark, sf_dir):
    a = quaternions.from_axis_angle(F.col("l_quantity") / 50, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    b = quaternions.from_axis_angle(F.col("l_quantity") / 25, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    s = quaternions.slerp(a, b, F.lit(0.5))
    return rounded(_grid(spark, sf_dir, F.lit(0.0), s=s).select("l_orderkey", "l_linenumber", "s.w", "s.z"))


@query("SELECT l_orderkey, l_linenumber, round((a * 3 + b * 2) / 13, 6) + 0.0 AS div_re, round((b * 3 - a * 2) / 13, 6) + 0.0 AS div_im, round(sqrt(a * a + b * b), 6) AS abs, round(atan2(b, a), 6) + 0.0 AS arg, round(exp(a / 10) * cos(b), 5) + 0.0 AS exp_re FROM (SELECT *, l_quantity AS a, l_discount AS b FROM lineitem)")
def complex_arithmetic(spark, sf_dir):
    z = complexes.complex_(F.col("l_quantity"), F.col("l_discount"))
    d = complexes.div(z, complexes.complex_(3.0, 2.0))
    e = complexes.exp(complexes.complex_(F.col("l_quantity") / 10, F.col("l_discount")))
    return rounded(rounded(_grid(spark, sf_dir, F.lit(0.0), div_re=d["re"], div_im=d["im"], abs=complexes.abs_(z), arg=complexes.arg(z), exp_re=e["re"]), 6, "div_re", "div_im", "abs", "arg"), 5, "exp_re")


@query("WITH g AS (SELECT DISTINCT l_quantity AS x FROM lineitem) SELECT x, round(lgamma(x), 6) + 0.0 AS log_gamma, round(gamma(x / 10), 5) AS gamma FROM g")
def gamma_functions(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x")).distinct()
    return g.select("x", (F.round(special.column("log_gamma", F.col("x")), 6) + 0.0).alias("log_gamma"), F.round(special.column("gamma", F.col("x") / 10), 5).alias("gamma"))


@query()
def special_functions(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x")).distinct()
    names = ["digamma", "erf", "erfc", "erfcx", "j0", "j1", "y0", "y1", "i0", "i1", "k0", "k1"]
    return rounded(g.select("x", *(special.column(n, F.col("x")).alias(n) for n in names), special.column("jn", F.col("x"), 3).alias("j3"), special.column2("beta", F.col("x"), F.lit(2.0)).alias("beta")), 8)


@query()
def noise(spark, sf_dir):
    x, y = F.col("l_quantity") / 7, F.col("l_extendedprice") / 1000
    return rounded(_grid(spark, sf_dir, F.lit(0.0), perlin=noise_functions.perlin2d(x, y), simplex=noise_functions.simplex2d(x, y)), 8)


@query("SELECT l_linenumber, n::INT AS n, round(exp(lgamma(13) - lgamma(n + 1) - lgamma(13 - n)))::DOUBLE AS choose, f AS fib, n IN (2, 3, 5, 7, 11) AS prime FROM (SELECT DISTINCT l_linenumber, l_linenumber + 4 AS n FROM lineitem) JOIN (SELECT * FROM (VALUES (5, 5), (6, 8), (7, 13), (8, 21), (9, 34), (10, 55), (11, 89), (12, 144)) v(k, f)) ON k = n")
def small_numbers(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().withColumn("n", (F.col("l_linenumber") + 4).cast("int"))
    return g.select("l_linenumber", "n", scalars.choose(F.lit(12), F.col("n")).alias("choose"), scalars.fibonacci(F.col("n")).alias("fib"), scalars.is_prime(F.col("n")).alias("prime"))


# --- generators, files, iteration --------------------------------------------------------------------------------------


@query("WITH n AS (SELECT range AS p FROM range(2, 2000)) SELECT p FROM n WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(d) WHERE d * d <= p AND p % d = 0)")
def primes(spark, sf_dir):
    return generators.primes(spark, 2000)


@query("SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS idx, a::INT AS a, b::INT AS b, c::INT AS c FROM range(8) x(a), range(8) y(b), range(8) z(c) WHERE a < b AND b < c")
def combinations(spark, sf_dir):
    return generators.combinations(spark, 8, 3).select("idx", *(F.col("val")[i].alias(n) for i, n in enumerate("abc")))


@query("SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS idx, a::INT AS a, b::INT AS b, c::INT AS c, d::INT AS d FROM range(4) w(a), range(4) x(b), range(4) y(c), range(4) z(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d")
def permutations(spark, sf_dir):
    return generators.permutations(spark, 4).select("idx", *(F.col("val")[i].alias(n) for i, n in enumerate("abcd")))


@query("SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS idx, a::INT AS a, b::INT AS b, c::INT AS c FROM range(3) x(a), range(4) y(b), range(5) z(c)")
def index_product(spark, sf_dir):
    return generators.product(spark, [3, 4, 5]).select("idx", *(F.col("val")[i].alias(n) for i, n in enumerate("abc")))


@query("SELECT i AS idx, 10 - 3 * i AS val, round(0.5::DOUBLE + i * 0.25::DOUBLE, 6) AS f FROM range(7) r(i)")
def ranges(spark, sf_dir):
    return generators.int_range(spark, 10, -9, -3).join(generators.float_range(spark, 0.5, 2.2, 0.25).select("idx", F.round("val", 6).alias("f")), "idx")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS \"row\", o_orderkey::DOUBLE AS a, round(o_totalprice, 2) AS b FROM orders")
def csv_lines(spark, sf_dir):
    """Lines as a CSV file has them, with comments and blank lines in between, parsed again."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit(' "'), F.col("o_orderkey").cast("string"), F.lit('" ; '), F.format_string("%.6f", "o_totalprice"))
    lines = o.select((F.col("o_orderkey") * 3).alias("n"), line.alias("value")).unionByName(o.select((F.col("o_orderkey") * 3 + 1).alias("n"), F.when(F.col("o_orderkey") % 2 == 0, "# note").otherwise("  ").alias("value")))
    return csv.parse_lines(lines, delimiter=";").select("row", F.col("vals")[0].alias("a"), F.round(F.col("vals")[1], 2).alias("b"))


@query()
def derivatives_and_roots(spark, sf_dir):
    rows = []
    for name, f, df, a, b in (("cubic", lambda x: x**3 - x - 2, lambda x: 3 * x * x - 1, 1.0, 2.0), ("cosine", lambda x: math.cos(x) - x, lambda x: -math.sin(x) - 1, 0.0, 1.0)):
        rows.append((name, round(numerics.bisection(f, a, b), 9), round(numerics.brent(f, a, b), 9), round(numerics.newton(f, df, b), 9), round(numerics.newton_bisection(f, df, a, b), 9), round(numerics.central(f, b)[0], 6)))
    return spark.createDataFrame(rows, "name string, bisection double, brent double, newton double, safeguarded double, derivative double")
