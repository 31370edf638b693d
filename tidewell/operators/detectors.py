"""Anomaly scores and ensembles over window features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .metrics import exact_percentiles

MAD_SCALE = 1.4826


def robust_parameters(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(median, MAD) of each feature, exact, without a task that holds a feature."""
    medians = {f: m[0] for f, m in exact_percentiles(train, features, [50]).items()}
    gaps = train.select(*[F.abs(F.col(f) - F.lit(m)).alias(f) for f, m in medians.items()])
    return {f: (medians[f], s[0]) for f, s in exact_percentiles(gaps, features, [50]).items()}


def robust_z(df: DataFrame, parameters: dict[str, tuple[float, float]], name: str = "score") -> DataFrame:
    """The largest robust z of a row's features."""
    parts = [F.abs(F.col(f) - F.lit(m)) / F.lit(MAD_SCALE * s + 1e-8) for f, (m, s) in parameters.items() if m is not None]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast("double")
    return df.withColumn(name, score)


def standard_parameters(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}_m"), F.stddev_pop(f).alias(f"{f}_s"))]).first()
    return {f: (row[f"{f}_m"], row[f"{f}_s"]) for f in features}


def standardize(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s + 1e-8) for f, (m, s) in parameters.items()})


def pca_basis(train: DataFrame, features: list[str], components: int | float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) from the covariance, which Spark sums: one pass, features squared in size.

    ``components``: how many, or the share of variance to explain.
    """
    f = [F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in features]
    k = len(f)
    sums = train.agg(F.count("*"), *[F.sum(x) for x in f], *[F.sum(f[i] * f[j]) for i in range(k) for j in range(i, k)]).first()
    n = max(1, sums[0])
    mean = np.array(sums[1 : 1 + k], float) / n
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = np.array(sums[1 + k :], float) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    if isinstance(components, float):
        components = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), components - 1e-12) + 1)
    return mean, vectors[:, : min(components, k)].T


def pca_error(df: DataFrame, features: list[str], basis: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """Mean squared reconstruction error, as one expression."""
    mean, parts = basis
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(float(m)) for f, m in zip(features, mean, strict=True)]
    scores = [sum((c * F.lit(float(v)) for c, v in zip(x, p, strict=True)), F.lit(0.0)) for p in parts]
    back = [sum((s * F.lit(float(p[i])) for s, p in zip(scores, parts, strict=True)), F.lit(0.0)) for i in range(len(x))]
    return df.withColumn(name, sum(((a - b) * (a - b) for a, b in zip(x, back, strict=True)), F.lit(0.0)) / len(x))


class IsolationForest:
    """Isolation trees on bounded samples; scores follow the average path length."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        depth = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._grow(sample[rng.permutation(len(sample))[: self.size]], depth, rng) for _ in range(trees)]

    @staticmethod
    def _usual(n: float) -> float:
        return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng) -> list[tuple]:
        """Nodes (feature, cut, left, right) or (-1, path length, 0, 0)."""
        nodes: list = [None]
        todo = [(0, x, 0)]
        while todo:
            at, rows, level = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if level >= depth or len(rows) < 2 or not len(spread):
                nodes[at] = (-1, level + self._usual(len(rows)), 0, 0)
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            nodes[at] = (f, cut, len(nodes), len(nodes) + 1)
            nodes += [None, None]
            todo += [(nodes[at][2], rows[rows[:, f] < cut], level + 1), (nodes[at][3], rows[rows[:, f] >= cut], level + 1)]
        return nodes

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 is anomalous."""
        total = np.zeros(len(x))
        for nodes in self.trees:
            f, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                i = np.flatnonzero(inner)
                go = x[i, f[at[i]]] < cut[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
            total += cut[at]
        return 2 ** (-total / len(self.trees) / max(self._usual(self.size), 1e-9))


def fit_isolation_forest(train: DataFrame, features: list[str], order: str, trees: int = 100, size: int = 256, seed: int = 42) -> IsolationForest:
    """Trees on at most ``64 * size`` rows, chosen by a hash of ``order``."""
    some = train.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.xxhash64(F.lit(seed), order).alias("_h"))
    return IsolationForest(some.orderBy("_h").limit(64 * size).drop("_h").toPandas().to_numpy(float), trees, size, seed)


def score_rows(df: DataFrame, features: list[str], score, name: str = "score") -> DataFrame:
    """``score(array of rows) -> array``, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: score(batch[features].fillna(0.0).to_numpy(float))})

    from pyspark.sql import types as T

    ship(df.sparkSession)
    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def not_run(df_or_spark, model: str, reason: str) -> DataFrame:
    """The row a model leaves that could not run."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.range(1).select(F.lit(model).alias("model_name"), F.lit("NOT_RUN").alias("status"), F.lit(reason).alias("failure_reason"))


def or_ensemble(predictions: DataFrame, key: str = "window_id") -> DataFrame:
    """Flagged by any model; the highest score."""
    return predictions.groupBy(key).agg(F.max("y_true").alias("y_true"), F.max("y_pred").alias("y_pred"), F.max("score").alias("score"), F.count("*").alias("models"))


def majority(predictions: DataFrame, key: str = "window_id", votes: int = 2, digits: int = 6) -> DataFrame:
    """Flagged by ``votes`` models at least; the mean score."""
    return predictions.groupBy(key).agg(F.max("y_true").alias("y_true"), F.when(F.sum("y_pred") >= votes, 1).otherwise(0).alias("y_pred"), F.round(F.avg("score"), digits).alias("score"), F.count("*").alias("models"))


def stacked(train: DataFrame, test: DataFrame, scores: list[str], y: str, c: float = 1.0, name: str = "score") -> DataFrame:
    """Logistic regression on model scores; the L2 weight matches inverse strength ``c``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=scores, outputCol="_x", handleInvalid="skip")
    rows = train.select(*scores, F.col(y).cast("double").alias("_y"))
    n = max(1, rows.count())
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * n), standardization=False, maxIter=1000).fit(made.transform(rows))
    out = model.transform(made.transform(test))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def moments(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population spread) of each feature, in one pass."""
    row = train.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}|m"), F.stddev_pop(f).alias(f"{f}|s"))]).first()
    return {f: (row[f"{f}|m"] or 0.0, row[f"{f}|s"] or 0.0) for f in features}


def score_columns(predictions: DataFrame, key: str, names: list[str], model: str = "name", digits: int = 6) -> DataFrame:
    """A column for each model's score, for keys that all of them have scored: one aggregation instead of a chain of joins."""
    wide = predictions.filter(F.col(model).isin(names)).groupBy(key).agg(*[F.round(F.max(F.when(F.col(model) == n, F.col("score"))), digits).alias(n) for n in names], F.count_distinct(model).alias("_n"))
    return wide.filter(F.col("_n") == len(names)).drop("_n")


def vote_of_best(predictions: DataFrame, model: str, key: str, best: int = 3, votes: int = 2, digits: int = 6) -> DataFrame:
    """The majority of the ``best`` models by F1; of equals the first by name. Models are few."""
    from .metrics import evaluate

    rated = evaluate(predictions, [model], F.col("y_true") == 1, F.col("y_pred") == 1)
    chosen = rated.orderBy(F.desc("f1"), model).limit(best).select(model)
    return majority(predictions.join(chosen, model, "left_semi"), key, votes, digits)


def smoke(anomalous: Column, u: Column, digits: int = 4) -> dict[str, Column]:
    """A score over the threshold for what is anomalous and below it for the rest, by a number in [0, 1)."""
    return {"score": F.round(F.when(anomalous, 0.55 + 0.40 * u).otherwise(0.05 + 0.40 * u), digits), "y_pred": anomalous.cast("int")}
