"""Linear and logistic regression over DataFrames.

A linear fit needs the data once: XᵀX, Xᵀy and yᵀy are one aggregate of (d + 1)(d + 2) / 2 + d + 2 sums, whatever the number of rows. Normal
equations and gradient descent both go on from these sums; lazy() keeps even that inside the plan. A logistic epoch is one aggregate over the
cached columns. Predictions are column expressions with the weights as literals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.linalg import solve


class NotFitted(RuntimeError):
    """predict before fit."""


def _affine(weights: Sequence[float], features: Sequence[str]) -> Column:
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features):
        z = z + F.lit(float(w)) * F.col(f)
    return z


def gram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row: n, g (row-major XᵀX with a leading column of ones), c = Xᵀy, yy."""
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y = F.col(target).cast("double")
    d = len(x)
    named = {f"g{i}_{j}": F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)} | {f"c{i}": F.sum(x[i] * y) for i in range(d)} | {"yy": F.sum(y * y), "n": F.count("*")}
    sums = df.agg(*[v.alias(k) for k, v in named.items()])
    g = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
    return sums.select("n", g.alias("g"), F.array(*[F.col(f"c{i}") for i in range(d)]).alias("c"), "yy")


def descend(g: np.ndarray, c: np.ndarray, n: int, lr: float, epochs: int) -> np.ndarray:
    """Full-batch gradient descent of the squared error from zero weights, on the sums."""
    w = np.zeros(len(c))
    for _ in range(epochs):
        w = w - lr * (g @ w - c) / n
    return w


def lazy_fit(df: DataFrame, features: Sequence[str], target: str, lr: float | None = None, epochs: int = 1000) -> DataFrame:
    """(feature string, idx int, weight double), idx 0 the intercept; by normal equations, or by gradient descent if lr is given. Nothing runs on the driver."""
    names = ["(intercept)", *features]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, g, c in zip(f.n, f.g, f.c):
                g, c = np.array(g).reshape(len(c), -1), np.array(c)
                w = solve(g, c) if lr is None else descend(g, c, n, lr, epochs)
                yield pd.DataFrame({"feature": names, "idx": np.arange(len(w), dtype=np.int32), "weight": w})

    return gram(df, features, target).mapInPandas(run, "feature string, idx int, weight double")


class LinearRegression:
    def __init__(self):
        self.weights: np.ndarray | None = None
        self.features: list[str] = []

    def _sums(self, df: DataFrame, features: Sequence[str], target: str):
        row = gram(df, features, target).first()
        if not row["n"]:
            raise ValueError("no rows")
        self.features = list(features)
        return row["n"], np.array(row["g"]).reshape(len(row["c"]), -1), np.array(row["c"])

    def fit_normal_equation(self, df: DataFrame, features: Sequence[str], target: str) -> LinearRegression:
        _, g, c = self._sums(df, features, target)
        self.weights = solve(g, c)
        return self

    def fit_gradient_descent(self, df: DataFrame, features: Sequence[str], target: str, lr: float = 0.01, epochs: int = 1000) -> LinearRegression:
        n, g, c = self._sums(df, features, target)
        self.weights = descend(g, c, n, lr, epochs)
        return self

    def prediction(self) -> Column:
        if self.weights is None:
            raise NotFitted("fit first")
        return _affine(self.weights, self.features)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if missing := [f for f in self.features if f not in df.columns]:
            raise NotFitted(f"fitted with other columns; missing: {missing}")
        return df.withColumn(out, self.prediction())

    def mse(self, df: DataFrame, target: str) -> float:
        d = self.prediction() - F.col(target)
        return df.agg(F.avg(d * d)).first()[0]


class LogisticRegression:
    def __init__(self):
        self.weights: np.ndarray | None = None
        self.features: list[str] = []

    def fit(self, df: DataFrame, features: Sequence[str], target: str, lr: float = 0.1, epochs: int = 1000) -> LogisticRegression:
        """Full-batch gradient descent of the cross-entropy from zero weights. Rows stay where they are, spilling to disk; d + 1 sums an epoch reach the driver."""
        base = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("__y")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, w = base.count(), np.zeros(len(features) + 1)
            if not n:
                raise ValueError("no rows")
            for _ in range(epochs):
                err = F.lit(1.0) / (F.lit(1.0) + F.exp(-_affine(w, features))) - F.col("__y")
                w = w - lr * np.array(base.agg(F.sum(err), *[F.sum(err * F.col(f)) for f in features]).first()) / n
        finally:
            base.unpersist()
        self.weights, self.features = w, list(features)
        return self

    def probability(self) -> Column:
        if self.weights is None:
            raise NotFitted("fit first")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-_affine(self.weights, self.features)))

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        if missing := [f for f in self.features if f not in df.columns]:
            raise NotFitted(f"fitted with other columns; missing: {missing}")
        return df.withColumn(out, self.probability())

    def predict(self, df: DataFrame, threshold: float = 0.5, out: str = "prediction") -> DataFrame:
        return self.predict_proba(df, "__p").withColumn(out, (F.col("__p") >= threshold).cast("int")).drop("__p")

    def accuracy(self, df: DataFrame, target: str, threshold: float = 0.5) -> float:
        return self.predict(df, threshold, "__hat").agg(F.avg((F.col("__hat") == F.col(target)).cast("double"))).first()[0]
