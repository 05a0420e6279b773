"""Classifiers over (id, cls, features): nearest neighbours, diagonal Gaussians, a small perceptron, boosting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import arrays as A
from quillspark.operators.neighbours import nearest

def knn_posterior(neighbours): return neighbours.groupBy("id", "cls").agg((F.count(F.lit(1)) / F.first(F.lit(1))).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("id"))).drop("n")
def knn_classify(posterior): return posterior.groupBy("id").agg(F.max(F.struct("share", (-F.col("cls")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("cls"))


def leave_one_out_error(data: DataFrame) -> DataFrame:
    """The share of rows whose nearest other row has another class."""
    n = nearest(data, data, 1).select("id", F.col("cls").alias("near"))
    return data.join(n, "id").agg(F.sum((F.col("cls") != F.col("near")).cast("long")).alias("wrong"), F.count(F.lit(1)).alias("total"))


def gaussian_fit(data: DataFrame) -> DataFrame:
    """(cls, mean, var) of every class; a variance below 1e-6 becomes the mean variance, then 1."""
    long = data.select("cls", F.posexplode("features").alias("k", "v"))
    m = long.groupBy("cls", "k").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.var_pop(F.col("v").cast("double")).alias("var"))
    m = m.withColumn("all", F.avg("var").over(Window.partitionBy("cls")))
    m = m.withColumn("var", F.when(F.col("var") >= 1e-6, F.col("var")).when(F.col("all") >= 1e-6, F.col("all")).otherwise(1.0))
    return m.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "var"))).alias("p")).select("cls", F.col("p.mean").alias("mean"), F.col("p.var").alias("var"))


def gaussian_costs(data: DataFrame, model: DataFrame) -> DataFrame:
    """(id, cls, cost): sum of squared deviations over variances, for each class; the model has a row for each class."""
    m = model.agg(F.collect_list(F.struct("cls", "mean", "var")).alias("models"))
    rows = data.select("id", "features").join(F.broadcast(m))  # one row
    each = rows.select("id", "features", F.explode("models").alias("m"))
    cost = F.aggregate(F.zip_with(F.zip_with("features", "m.mean", lambda x, c: (x - c) * (x - c)), "m.var", lambda d, v: d / v), F.lit(0.0), lambda s, x: s + x)
    return each.select("id", "m.cls", cost.alias("cost"))


class Perceptron:
    """Two-layer sigmoid network, fitted on the driver on a bounded sample, applied in Arrow batches."""

    def __init__(self, hidden: int = 24, rate: float = 0.5, epochs: int = 40, seed: int = 7):
        self.hidden, self.rate, self.epochs, self.seed = hidden, rate, epochs, seed

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Perceptron:
        rng = np.random.default_rng(self.seed)
        self.classes = np.unique(y)
        target = (y[:, None] == self.classes[None]).astype(float)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.sd
        self.w1, self.b1 = rng.normal(0, 0.3, (x.shape[1], self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, 0.3, (self.hidden, len(self.classes))), np.zeros(len(self.classes))
        weight = np.ones(len(x)) if weight is None else weight / weight.mean()
        for _ in range(self.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
                h = 1 / (1 + np.exp(-(z[at] @ self.w1 + self.b1)))
                o = 1 / (1 + np.exp(-(h @ self.w2 + self.b2)))
                d2 = (o - target[at]) * weight[at, None] / len(at)
                d1 = d2 @ self.w2.T * h * (1 - h)
                self.w2 -= self.rate * h.T @ d2
                self.b2 -= self.rate * d2.sum(0)
                self.w1 -= self.rate * z[at].T @ d1
                self.b1 -= self.rate * d1.sum(0)
        return self

    def outputs(self, x: np.ndarray) -> np.ndarray:
        h = 1 / (1 + np.exp(-((x - self.mean) / self.sd @ self.w1 + self.b1)))
        return 1 / (1 + np.exp(-(h @ self.w2 + self.b2)))

    def classify(self, x): return self.classes[self.outputs(x).argmax(1)]


class Boosting:
    """Multi-class boosting of small perceptrons: alpha = ln((1 - e) / e) + ln(K - 1)."""

    def __init__(self, rounds: int = 5, **kind):
        self.rounds, self.kind = rounds, kind

    def fit(self, x, y):
        self.classes, self.members = np.unique(y), []
        w = np.full(len(x), 1 / len(x))
        for k in range(self.rounds):
            m = Perceptron(seed=k, **self.kind).fit(x, y, w)
            bad = m.classify(x) != y
            e = min(max(float(w[bad].sum()), 1e-6), 1 - 1e-6)
            alpha = np.log((1 - e) / e) + np.log(max(len(self.classes) - 1, 1))
            if alpha <= 0:
                break
            self.members.append((alpha, m))
            w = w * np.exp(alpha * bad)
            w /= w.sum()
        return self

    def outputs(self, x): return sum(a * (m.classify(x)[:, None] == self.classes[None]) for a, m in self.members)
    def classify(self, x): return self.classes[self.outputs(x).argmax(1)]


def sample(data: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(features, classes) of at most `most` labelled rows, those of the smallest hash."""
    rows = data.where("cls >= 0").orderBy(F.xxhash64("id"), "id").limit(most).select("features", "cls").collect()
    return np.array([r["features"] for r in rows], dtype=float), np.array([r["cls"] for r in rows])


def predict(data: DataFrame, model) -> DataFrame:
    """(id, cls, predicted) of every row by any model with classify()."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "cls": pdf["cls"], "predicted": model.classify(np.stack(pdf["features"].to_numpy()).astype(float))})

    return data.select("id", "cls", "features").mapInPandas(run, "id long, cls int, predicted int")


def agglomerate(values: DataFrame, gap: float, by: str) -> DataFrame:
    """1-D clusters (by, value): values closer than `gap` to the one before stay together."""
    w = Window.partitionBy(by).orderBy("value")
    start = F.when(F.col("value") - F.lag("value").over(w) <= gap, 0).otherwise(1)
    return values.withColumn("s", start).withColumn("cluster", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s")


normalize = {"l1": A.normalize1, "l2": A.normalize2, "max": lambda a: F.transform(a, lambda x: x / F.array_max(A.absolute(a)))}
