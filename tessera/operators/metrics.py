"""Classification and regression metrics: aggregations, and curves from running sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import or_zero, prefix_sums


def positive(c: str) -> Column:
    """Labels and predictions count as 1 from 0.5 on."""
    return F.col(c) >= 0.5


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """tn, fp, fn, tp."""
    a, b = positive(y), positive(p)
    return df.agg(F.count_if(~a & ~b).alias("tn"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(a & b).alias("tp"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, precision, recall, f1; what has no cases is 0."""
    m = confusion_matrix(df, y, p)
    pr, re = or_zero(F.col("tp"), F.col("tp") + F.col("fp")), or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    m = m.select(((F.col("tp") + F.col("tn")) / F.nullif(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.lit(0))).alias("accuracy"), pr.alias("precision"), re.alias("recall"))
    return m.withColumn("f1", or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _metric(name: str):
    def metric(df: DataFrame, y: str, p: str) -> float:
        return classification_report(df, y, p).first()[name]

    metric.__name__ = f"{name}_score"
    return metric


accuracy_score, precision_score, recall_score, f1_score = (_metric(m) for m in ("accuracy", "precision", "recall", "f1"))


def score_counts(df: DataFrame, y: str, score: str, descending: bool = True) -> DataFrame:
    """(score, pos, neg, tp, fp) of distinct scores with running sums."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(positive(y)).alias("pos"), F.count_if(~positive(y)).alias("neg"))
    return prefix_sums(counts, "score", {"tp": "pos", "fp": "neg"}, descending=descending)


def _totals(df: DataFrame, y: str) -> tuple[int, int]:
    row = df.agg(F.count_if(positive(y)).alias("p"), F.count_if(~positive(y)).alias("n")).first()
    return row.p, row.n


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at score >= threshold for each distinct score, and one threshold above all. Both classes must occur."""
    p, n = _totals(df, y)
    if not p or not n:
        raise ValueError("both classes must occur")
    c = score_counts(df, y, score)
    top = df.agg((F.max(score).cast("double") + 1).alias("threshold")).select("threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return top.unionByName(c.select(F.col("score").alias("threshold"), (F.col("fp") / n).alias("fpr"), (F.col("tp") / p).alias("tpr")))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """auc and gini. The trapezoid between two thresholds needs only the class counts of one: no ordering of the points."""
    p, n = _totals(df, y)
    if not p or not n:
        raise ValueError("both classes must occur")
    c = score_counts(df, y, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (float(p) * n)
    return c.agg(area.alias("auc")).withColumn("gini", 2 * F.col("auc") - 1)


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) of the distinct scores; recall is 0 without positives."""
    p, _ = _totals(df, y)
    c = score_counts(df, y, score)
    recall = F.col("tp") / p if p else F.lit(0.0)
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum of recall steps times precision without the first threshold's; 0 with fewer than two thresholds."""
    p, _ = _totals(df, y)
    c = score_counts(df, y, score)
    first = c.agg(F.max("score").alias("first"))
    step = F.col("pos") / float(max(p, 1)) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.join(F.broadcast(first), c.score < F.col("first")).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def ks_statistic(df: DataFrame, y: str, score: str) -> DataFrame:
    """Largest difference of the classes' distribution functions over the scores."""
    p, n = _totals(df, y)
    if not p or not n:
        raise ValueError("both classes must occur")
    return score_counts(df, y, score, descending=False).agg(F.max(F.abs(F.col("tp") / p - F.col("fp") / n)).alias("ks"))


def log_loss(y: str, p: str) -> Column:
    """Mean cross-entropy with probabilities kept within 1e-15 of 0 and 1."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def mean_squared_error(y: str, p: str) -> Column:
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def root_mean_squared_error(y: str, p: str) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def mean_absolute_error(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2_score(y: str, p: str) -> Column:
    """1 - SSR / SST; for a constant truth 1 if all is exact, else 0."""
    ssr = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst == 0, F.when(ssr == 0, 1.0).otherwise(0.0)).otherwise(1 - ssr / F.nullif(sst, F.lit(0.0)))


def mean_absolute_percentage_error(y: str, p: str) -> Column:
    """In percent, over rows whose truth isn't 0; an error if there are none."""
    some = F.avg(F.when(F.col(y) != 0, F.abs((F.col(y) - F.col(p)) / F.nullif(F.col(y), F.lit(0.0))))) * 100
    return F.coalesce(some, F.raise_error(F.lit("no truth other than 0")).cast("double"))


def explained_variance(y: str, p: str) -> Column:
    """1 - var(residual) / var(truth); 1 for a constant truth."""
    return F.when(F.var_pop(y) == 0, 1.0).otherwise(1 - F.var_pop(F.col(y) - F.col(p)) / F.nullif(F.var_pop(y), F.lit(0.0)))


def max_error(y: str, p: str) -> Column:
    return F.max(F.abs(F.col(y) - F.col(p)))


def median_absolute_error(df: DataFrame, y: str, p: str) -> float:
    """Exact median by order statistics: nothing holds the whole column."""
    from tessera.core import order_statistics

    e = df.select(F.abs(F.col(y) - F.col(p)).alias("e")).filter("e IS NOT NULL")
    n = e.count()
    if not n:
        raise ValueError("no rows")
    a, b = order_statistics(e, "e", [(n - 1) // 2, n // 2])
    return (a + b) / 2


def mean_squared_log_error(y: str, p: str) -> Column:
    """Negative values are an error."""
    bad = F.raise_error(F.lit("negative value")).cast("double")
    d = F.log1p(F.col(y)) - F.log1p(F.col(p))
    return F.avg(F.when((F.col(y) < 0) | (F.col(p) < 0), bad).otherwise(d * d))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(truth, predicted, n) of any labels."""
    return df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
