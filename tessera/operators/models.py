"""Linear, logistic, clustering, neighbour, tree and kernel models.

Linear models are fitted from sufficient statistics: one aggregation gives the Gram matrix, whose size depends on the
columns alone, and the rest is small algebra on the driver. Logistic regression and k-means run one aggregation per
epoch. Trees, forests and support vector machines are sequential by definition and take a group of rows per model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import NotFitted, total
from tessera.functions.scalars import sigmoid


@dataclass
class Gram:
    """Sums over rows: n, x, xx, xy, y, yy."""

    n: int
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    y: float
    yy: float


def gram(df: DataFrame, features: Sequence[str], target: str) -> Gram:
    """One aggregation for all of it; rows with a null are left out."""
    df = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y")).dropna()
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cells = [F.count("*")] + [F.sum(f"x{i}") for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(d)] + [F.sum("y"), F.sum(F.col("y") * F.col("y"))]
    row = df.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells))).first()
    if not row[0]:
        raise ValueError("no rows")
    v = np.array(row[1:], float)
    xx = np.zeros((d, d))
    for (i, j), s in zip(pairs, v[d : d + len(pairs)]):
        xx[i, j] = xx[j, i] = s
    rest = v[d + len(pairs) :]
    return Gram(row[0], v[:d], xx, rest[:d], rest[d], rest[d + 1])


@dataclass
class Linear:
    """bias + x . theta, with a cost of its kind."""

    features: list[str]
    theta: np.ndarray | None = None
    bias: float = 0.0
    penalty: float = 0.0

    def decision(self) -> Column:
        if self.theta is None:
            raise NotFitted("train comes first")
        return F.lit(float(self.bias)) + total([F.col(c) * float(t) for c, t in zip(self.features, self.theta)])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.decision())

    def squares(self, df: DataFrame, target: str) -> tuple[int, float]:
        e = self.decision() - F.col(target)
        row = df.agg(F.count("*"), F.sum(e * e)).first()
        return row[0], row[1] or 0.0

    def gradients(self, df: DataFrame, target: str) -> tuple[np.ndarray, float]:
        """Of the half mean squared error with its ridge penalty: (by theta, by bias)."""
        e = self.decision() - F.col(target)
        row = df.agg(F.avg(e), *(F.avg(e * F.col(c)) for c in self.features)).first()
        return np.array(row[1:], float) + self.penalty / max(1, df.count()) * self.theta, row[0]


class Ridge(Linear):
    """Closed form on centred sums, (Xc'Xc + lambda I) theta = Xc'yc; the bias isn't penalised. Without lambda: least squares."""

    def train(self, df: DataFrame, target: str, penalty: float = 0.0) -> "Ridge":
        g = gram(df, self.features, target)
        a = g.xx - np.outer(g.x, g.x) / g.n + penalty * np.eye(len(g.x))
        if abs(np.linalg.det(a)) == 0:
            raise ValueError("singular normal equations")
        self.penalty, self.theta = penalty, np.linalg.solve(a, g.xy - g.x * g.y / g.n)
        self.bias = (g.y - g.x @ self.theta) / g.n
        return self

    def cost(self, df: DataFrame, target: str) -> float:
        n, rss = self.squares(df, target)
        return rss / (2 * n) + self.penalty / (2 * n) * float(self.theta @ self.theta)


class LinearRegression(Ridge):
    """Least squares."""


def _soft(r: float, t: float) -> float:
    return r - t if r > t else r + t if r < -t else 0.0


class Lasso(Linear):
    """RSS / m + lambda |theta|: coordinate descent for fixed epochs on the Gram matrix; the bias follows every coordinate."""

    def train(self, df: DataFrame, target: str, epochs: int = 1000, penalty: float = 1.0) -> "Lasso":
        g = gram(df, self.features, target)
        self.penalty, self.theta, self.bias = penalty, np.zeros(len(g.x)), g.y / g.n
        for _ in range(epochs):
            for j in range(len(g.x)):
                rho = g.xy[j] - self.bias * g.x[j] - g.xx[j] @ self.theta + g.xx[j, j] * self.theta[j]
                self.theta[j] = _soft(rho, penalty * g.n / 2) / g.xx[j, j] if g.xx[j, j] > 0 else 0.0
                self.bias += (g.y - g.x @ self.theta) / g.n - self.bias
        return self

    def cost(self, df: DataFrame, target: str) -> float:
        n, rss = self.squares(df, target)
        return rss / n + self.penalty * float(np.abs(self.theta).sum())


class ElasticNet(Linear):
    """RSS / 2m + alpha (l1 |theta| + (1 - l1) / 2 |theta|^2); the bias moves once an epoch, damped by the rate."""

    def train(self, df: DataFrame, target: str, epochs: int = 1000, alpha: float = 1.0, l1_ratio: float = 0.5, rate: float = 1.0) -> "ElasticNet":
        g = gram(df, self.features, target)
        self.theta, self.bias, self.alpha, self.l1_ratio = np.zeros(len(g.x)), g.y / g.n, alpha, l1_ratio
        l1, l2 = alpha * l1_ratio * g.n, alpha * (1 - l1_ratio) * g.n
        for _ in range(epochs):
            for j in range(len(g.x)):
                rho = g.xy[j] - self.bias * g.x[j] - g.xx[j] @ self.theta + g.xx[j, j] * self.theta[j]
                d = g.xx[j, j] + l2
                self.theta[j] = _soft(rho, l1) / d if d > 0 else 0.0
            self.bias += rate * ((g.y - g.x @ self.theta) / g.n - self.bias)
        return self

    def cost(self, df: DataFrame, target: str) -> float:
        n, rss = self.squares(df, target)
        return rss / (2 * n) + self.alpha * (self.l1_ratio * float(np.abs(self.theta).sum()) + (1 - self.l1_ratio) / 2 * float(self.theta @ self.theta))


class LogisticRegression(Linear):
    """Batch gradient descent from zero with a fixed rate and number of epochs: one aggregation each."""

    def probability(self) -> Column:
        return sigmoid(self.decision())

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.probability())

    def cost(self, df: DataFrame, target: str) -> float:
        z, y = self.decision(), F.col(target)
        row = df.agg(F.count("*"), F.avg(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) + (1 - y) * z)).first()
        return row[1] + self.penalty / (2 * row[0]) * float(self.theta @ self.theta)

    def gradients(self, df: DataFrame, target: str) -> tuple[np.ndarray, float]:
        e = self.probability() - F.col(target)
        row = df.agg(F.avg(e), F.count("*"), *(F.avg(e * F.col(c)) for c in self.features)).first()
        return np.array(row[2:], float) + self.penalty / row[1] * self.theta, row[0]

    def train(self, df: DataFrame, target: str, epochs: int = 100, rate: float = 0.1, penalty: float = 0.0) -> "LogisticRegression":
        self.theta, self.bias, self.penalty = np.zeros(len(self.features)), 0.0, penalty
        df = df.select(*self.features, target).dropna().persist()
        try:
            for _ in range(epochs):
                g, b = self.gradients(df, target)
                self.theta, self.bias = self.theta - rate * g, self.bias - rate * b
        finally:
            df.unpersist()
        return self


@dataclass
class KMeans:
    """Lloyd's algorithm from given centroids; the lowest index wins ties, an empty class becomes the zero vector."""

    features: list[str]
    centroids: np.ndarray
    iterations: int = 0

    def closest(self) -> Column:
        d = F.array(*(total([(F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(self.features, row)]) for row in self.centroids))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def assign(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        return df.withColumn(out, self.closest())

    def update(self, df: DataFrame) -> np.ndarray:
        rows = df.groupBy(self.closest().alias("k")).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(self.features))).collect()  # one row per class
        out = np.zeros_like(self.centroids)
        for r in rows:
            out[r.k] = r[1:]
        return out

    def train(self, df: DataFrame, epochs: int = 100, tol: float = 1e-9) -> "KMeans":
        self.centroids = np.array(self.centroids, float)
        df = df.select(*self.features).persist()
        try:
            for self.iterations in range(epochs):
                new = self.update(df)
                moved = float(np.linalg.norm(new - self.centroids))
                self.centroids = new
                if moved < tol:
                    break
        finally:
            df.unpersist()
        return self


def knn_predict(queries: DataFrame, train: DataFrame, k: int, query_id: str = "query_id", row_id: str = "id", label: str = "label", vector: str = "features", weights: dict[float, float] | None = None, block: int = 512) -> DataFrame:
    """(query_id, prediction): vote of the k nearest by Euclidean distance over the class weight; a tie is voted again
    with k - 1. Equal distances go by row id.

    Training rows are packed into blocks and met with blocks of queries; each meeting gives at most k rows a query, and the
    merge sees only those. Matrix products find the rows that may be among them, with a bound of their rounding, so all
    rows that tie at the cut are compared exactly.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if weights and any(w == 0 for w in weights.values()):
        raise ZeroDivisionError("a class weight is 0")
    n = max(1, -(-queries.count() // block))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v")).withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    q = q.groupBy("b").agg(F.collect_list("query_id").alias("ids"), F.collect_list("v").alias("vs"))  # about `block` queries each
    parts = max(1, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int")
    t = train.select(salt.alias("p"), F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"), F.col(vector).alias("v"))
    grid = q.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right):
            x = np.stack(right.v).astype(float)
            w = np.array([(weights or {}).get(c, 1.0) for c in right.label])
            xx = (x * x).sum(1)
            for ids, vs in zip(left.ids, left.vs):
                y = np.stack(vs).astype(float)
                yy = (y * y).sum(1)[:, None]
                square, slack = xx - 2 * y @ x.T + yy, 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + yy)
                ends = np.sqrt(np.maximum(square - slack, 0)) / w, np.sqrt(np.maximum(square, 0) + slack) / w
                low, high = np.minimum(*ends), np.maximum(*ends)
                for i, v, lo, hi in zip(ids, y, low, high):
                    cut = np.partition(hi, k - 1)[k - 1] if len(hi) > k else np.inf
                    near = np.flatnonzero(~(lo > cut + 1e-14 * abs(cut)))
                    exact = np.sqrt(((x[near] - v) ** 2).sum(1)) / w[near]
                    best = np.lexsort((right.id.to_numpy()[near], exact))[:k]
                    out += [(i, float(exact[j]), right.id.iloc[near[j]], float(right.label.iloc[near[j]])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "d", "id", "label"])

    qt, it = queries.schema[query_id].dataType.simpleString(), train.schema[row_id].dataType.simpleString()
    near = grid.groupBy("p").cogroup(t.groupBy("p")).applyInPandas(meet, f"query_id {qt}, d double, id {it}, label double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    near = near.withColumn("r", rank).filter(F.col("r") <= k)
    votes = near.select("query_id", "label", "r", F.explode(F.sequence("r", F.lit(k))).alias("kk")).groupBy("query_id", "kk", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id", "kk").agg(F.max("n").alias("top"), F.max_by("label", "n").alias("prediction"), F.collect_list("n").alias("ns"))
    untied = best.filter(F.size(F.filter("ns", lambda x: x == F.col("top"))) == 1)
    return untied.groupBy("query_id").agg(F.max_by("prediction", "kk").alias("prediction"))


def bounded(df: DataFrame, max_rows: int = 1_000_000) -> pd.DataFrame:
    """All rows on the driver, for models that are one task's work by definition; more than max_rows are an error, never
    a silent sample."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows, more than {max_rows}: fit per group with applyInPandas, or raise max_rows")
    return df.toPandas()


# --- models of one group of rows -----------------------------------------------------------------------------------


def _impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    p = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return 1 - (p * p).sum(-1) if criterion == "gini" else -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def _majority(y: np.ndarray) -> float:
    values, first, n = np.unique(y, return_index=True, return_counts=True)
    return float(values[np.lexsort((first, -n))[0]])


@dataclass
class DecisionTree:
    """Binary splits at midpoints of neighbouring sorted values; the first feature and lowest threshold win ties."""

    max_depth: int = 10
    min_samples_split: int = 2
    criterion: str = "gini"
    nodes: list[tuple] = field(default_factory=list)
    min_samples_leaf: int = 1

    def fit(self, x: np.ndarray, y: np.ndarray) -> "DecisionTree":
        self.nodes = []
        if len(y):
            self._grow(np.asarray(x, float), np.asarray(y, float), 0)
        return self

    def _best(self, x: np.ndarray, y: np.ndarray):
        if len(y) < self.min_samples_split:
            return None
        values, code = np.unique(y, return_inverse=True)
        hot = np.eye(len(values))[code]
        parent, best = float(_impurity(hot.sum(0), self.criterion)), None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(hot[order], 0)
            cut = (v[:-1] + v[1:]) / 2
            at = np.searchsorted(v, cut, side="right")
            ok = (at >= self.min_samples_leaf) & (len(v) - at >= self.min_samples_leaf)
            n = at[ok].astype(float)
            a = left[at[ok] - 1]
            b = left[-1] - a
            w = (n * _impurity(a, self.criterion) + (len(v) - n) * _impurity(b, self.criterion)) / len(v)
            if len(w) and (best is None or w.min() < best[0] - 1e-15):
                best = (float(w.min()), f, float(cut[ok][w.argmin()]))
        return best if best and best[0] < parent - 1e-15 else None

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = self._best(x, y) if depth < self.max_depth and len(set(y.tolist())) > 1 else None
        if split is None:
            self.nodes[at] = (-1, 0.0, -1, -1, _majority(y))
            return at
        _, f, cut = split
        go = x[:, f] <= cut
        low = self._grow(x[go], y[go], depth + 1)
        high = self._grow(x[~go], y[~go], depth + 1)
        self.nodes[at] = (f, cut, low, high, 0.0)
        return at

    def predict(self, columns: Sequence[Column], at: int = 0) -> Column:
        """The tree as nested conditions over columns."""
        if not self.nodes:
            raise NotFitted("fit comes first")
        f, cut, low, high, value = self.nodes[at]
        return F.lit(value) if f < 0 else F.when(columns[f] <= cut, self.predict(columns, low)).otherwise(self.predict(columns, high))


def bootstrap(n: int, tree: int) -> list[int]:
    """Row indices of a tree's sample by the 31-bit linear congruential recurrence, seeded by the tree's number."""
    s, out = tree, []
    for _ in range(n):
        s = (s * 1103515245 + 12345) % (1 << 32) % (1 << 31)
        out.append(s % n)
    return out


@dataclass
class RandomForest:
    """Trees on bootstrap samples, grown in parallel, one task per tree over a bounded table of rows."""

    n_trees: int = 10
    max_depth: int = 10
    min_samples_split: int = 2
    criterion: str = "gini"
    trees: list[DecisionTree] = field(default_factory=list)
    width: int = 0

    def train(self, df: DataFrame, features: Sequence[str], target: str, row_id: str, max_rows: int = 200_000) -> "RandomForest":
        """Rows are sent to every tree; more than max_rows are an error rather than a silent sample."""
        rows = bounded(df.select(row_id, *features, target), max_rows).sort_values(row_id)
        x, y = rows[list(features)].to_numpy(float), rows[target].to_numpy(float)
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((x, y))
        depth, least, criterion = self.max_depth, self.min_samples_split, self.criterion

        def grow(batches):
            a, b = shared.value
            for pdf in batches:
                out = []
                for t in pdf["tree"]:
                    at = bootstrap(len(b), int(t))
                    for i, node in enumerate(DecisionTree(depth, least, criterion).fit(a[at], b[at]).nodes):
                        out.append((int(t), i, *node))
                yield pd.DataFrame(out, columns=["tree", "i", "f", "cut", "low", "high", "value"])

        seeds = spark.range(self.n_trees).withColumnRenamed("id", "tree").repartition(max(1, min(self.n_trees, 64)))
        got = seeds.mapInPandas(grow, "tree long, i int, f int, cut double, low int, high int, value double").orderBy("tree", "i").collect()
        self.trees = [DecisionTree(depth, least, criterion, []) for _ in range(self.n_trees)]
        for r in got:
            self.trees[r.tree].nodes.append((r.f, r.cut, r.low, r.high, r.value))
        self.width = len(features)
        return self

    def votes(self, columns: Sequence[Column]) -> Column:
        if not self.trees:
            raise NotFitted("train comes first")
        return F.array(*(t.predict(columns) for t in self.trees))

    def predict(self, columns: Sequence[Column]) -> Column:
        """The most frequent vote; the first seen wins ties."""
        v = self.votes(columns)
        counted = F.transform(v, lambda x: F.size(F.filter(v, lambda y: y == x)))
        return F.get(v, F.array_position(counted, F.array_max(counted)).cast("int") - 1)

    def predict_proba(self, columns: Sequence[Column]) -> Column:
        v = self.votes(columns)
        return F.size(F.filter(v, lambda x: x == 1.0)) / F.size(v)

    def feature_importance(self) -> list[float]:
        """Not computed: zeros."""
        return [0.0] * self.width


@dataclass
class SVM:
    """Sequential minimal optimisation whose second index is always the next row; a bounded table on the driver."""

    kernel: str = "linear"
    c: float = 1.0
    gamma: float = 1.0
    degree: int = 3
    support: list[tuple[np.ndarray, float]] = field(default_factory=list)
    bias: float = 0.0
    trained: bool = False

    def gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":
            return np.exp(-self.gamma * ((a[:, None] - b[None]) ** 2).sum(2))
        d = a @ b.T
        return d if self.kernel == "linear" else (self.gamma * d) ** self.degree

    def train(self, x: np.ndarray, y: np.ndarray, max_passes: int = 100, tol: float = 1e-3) -> "SVM":
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, k, c = len(y), self.gram(x, x), self.c
        alpha, bias = np.zeros(n), 0.0
        for _ in range(max_passes):
            changed = 0
            for i in range(n):
                error = lambda r: bias + (alpha * y * (alpha > 1e-10)) @ k[r] - y[r]
                ei = error(i)
                j = (i + 1) % n
                if j == i or not ((y[i] * ei < -tol and alpha[i] < c) or (y[i] * ei > tol and alpha[i] > 0)):
                    continue
                ej = error(j)
                s = alpha[i] + alpha[j] if y[i] == y[j] else alpha[j] - alpha[i]
                low, high = (max(0.0, s - c), min(c, s)) if y[i] == y[j] else (max(0.0, s), min(c, c + s))
                eta = k[i, i] + k[j, j] - 2 * k[i, j]
                if abs(high - low) < 1e-10 or eta <= 0:
                    continue
                new = min(max(alpha[j] + y[j] * (ei - ej) / eta, low), high)
                dj, di = new - alpha[j], y[i] * y[j] * (alpha[j] - new)
                alpha[i], alpha[j] = alpha[i] + di, new
                b1, b2 = (bias - e - y[i] * di * k[i, r] - y[j] * dj * k[r, j] for e, r in ((ei, i), (ej, j)))
                bias = b1 if 0 < alpha[i] < c else b2 if 0 < alpha[j] < c else (b1 + b2) / 2
                changed += 1
            if not changed:
                break
        self.support = [(x[i], float(alpha[i] * y[i])) for i in range(n) if alpha[i] > 1e-10]
        self.bias, self.trained = float(bias), True
        return self

    def decision(self, columns: Sequence[Column]) -> Column:
        if not self.trained:
            raise NotFitted("train comes first")
        out = F.lit(self.bias)
        for v, a in self.support:
            dot = total([x * float(w) for x, w in zip(columns, v)])
            if self.kernel == "rbf":
                dot = F.exp(-self.gamma * total([(x - float(w)) * (x - float(w)) for x, w in zip(columns, v)]))
            elif self.kernel == "polynomial":
                dot = F.pow(self.gamma * dot, F.lit(float(self.degree)))
            out = out + a * dot
        return out

    def predict(self, columns: Sequence[Column]) -> Column:
        return F.when(self.decision(columns) >= 0, 1.0).otherwise(-1.0)
