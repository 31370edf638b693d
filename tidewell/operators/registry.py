"""Fitted detectors as rows of a table: one dispatch by kind, and one pass over the data for all of them.

A row names a model and its configuration, its kind, features, parameters (a VARIANT), and the threshold
frozen when it was fitted; scoring never looks at the scored rows to find one. Models of a grid are fitted side by
side: trees of forests in tasks of their own on a bounded sample, bases from moments that Spark sums. A model
that could not be fitted has a row too, that says why, and leaves it in the scores.

Parameters are bounded by the grid, not by the data, and are broadcast. NULL features count as 0; NaN scores flag nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .detectors import MAD_SCALE, IsolationForest, moments, pca_basis, robust_parameters, standardize
from .intervals import settled
from .metrics import confusion, percentiles_by, rates

#: Trees that one task grows, rows they are grown from at most.
CHUNK, SAMPLE = 25, 16_384
_ROW = "model_name string, config string, place int, kind string, features array<string>, parameters string, failure_reason string"
_LONG = "model_name string, config string, place int, score double"
#: The grids, as (name of the configuration, settings).
FORESTS = (("100_0.01", 100, 0.01), ("100_0.05", 100, 0.05), ("300_0.02", 300, 0.02), ("300_0.05", 300, 0.05), ("300_0.10", 300, 0.10), ("500_0.02", 500, 0.02))
BASES = (("variance_0.90", 0.90), ("variance_0.95", 0.95), ("variance_0.99", 0.99), ("components_5", 5), ("components_10", 10), ("components_20", 20))


def _table(spark, rows: list[tuple]) -> DataFrame:
    """Rows (model, config, place, kind, features, parameters, reason) with the parameters as VARIANT and no threshold yet."""
    made = [(m, c, p, k, f, None if x is None else json.dumps(x), why) for m, c, p, k, f, x, why in rows]
    return spark.createDataFrame(made, _ROW).withColumn("parameters", F.parse_json("parameters"))


def z_models(train: DataFrame, features: list[str]) -> DataFrame:
    """Largest distance in robust and in standard deviations, and the length of the standardised row."""
    robust, standard = robust_parameters(train, features), moments(train, features)
    centred = {"centre": [standard[f][0] for f in features], "scale": [standard[f][1] if standard[f][1] > 1e-8 else 1.0 for f in features]}
    rows = [
        ("robust_z", "primary", 0, "z", features, {"centre": [robust[f][0] or 0.0 for f in features], "scale": [MAD_SCALE * (robust[f][1] or 0.0) + 1e-8 for f in features]}, None),
        ("standard_z", "primary", 0, "z", features, {"centre": [standard[f][0] for f in features], "scale": [standard[f][1] + 1e-8 for f in features]}, None), ("distance", "primary", 0, "distance", features, centred, None),
    ]
    return _table(train.sparkSession, rows)


def pca_models(train: DataFrame, features: list[str], grid: tuple = BASES) -> DataFrame:
    """A basis for each share of variance or number of components; numbers that leave nothing out are not run."""
    parameters = moments(train, features)
    scaled = standardize(train, parameters)
    rows = []
    for place, (name, wanted) in enumerate(grid):
        if isinstance(wanted, int) and wanted >= len(features):
            rows.append(("pca", name, place, "pca", features, None, f"{wanted} components of {len(features)} features"))
            continue
        mean, parts = pca_basis(scaled, features, wanted)
        found = {"centre": [parameters[f][0] for f in features], "scale": [parameters[f][1] + 1e-8 for f in features], "mean": mean.tolist(), "components": parts.tolist()}
        rows.append(("pca", name, place, "pca", features, found, None))
    return _table(train.sparkSession, rows)


def forest_models(train: DataFrame, features: list[str], order: str, grid: tuple = FORESTS, size: int = 256, seed: int = 42) -> DataFrame:
    """Forests of a grid, ``CHUNK`` trees a task, on the ``SAMPLE`` rows with the smallest hash of ``order``."""
    spark, parameters = train.sparkSession, moments(train, features)
    ship(spark)
    some = train.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.xxhash64(F.lit(seed), order).alias("_h")).orderBy("_h", *features).limit(SAMPLE)
    sample = some.drop("_h").toPandas().to_numpy(float).reshape(-1, len(features))
    if not len(sample):
        return _table(spark, [("isolation_forest", name, place, "isolation_forest", features, None, "no training rows") for place, (name, _, _) in enumerate(grid)])
    centre, scale = np.array([parameters[f][0] for f in features]), np.array([parameters[f][1] + 1e-8 for f in features])
    shared = spark.sparkContext.broadcast((sample - centre) / scale)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [json.dumps(_packed(IsolationForest(shared.value, n, size, seed + 1000 * chunk).trees)) for chunk, n in zip(batch["chunk"], batch["n"], strict=True)]
            yield batch.assign(trees=made)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        trees = [t for chunk in rows.sort_values("chunk")["trees"] for t in json.loads(chunk)]
        found = {"centre": centre.tolist(), "scale": scale.tolist(), "size": min(size, len(shared.value)), "trees": trees, "shift": 0.0}
        score = SCORERS["isolation_forest"](found, shared.value * scale + centre, {})
        # as far as the expected share of outliers reaches, a score counts as negative
        found["shift"] = float(np.percentile(score, 100 * (1 - rows["contamination"].iloc[0])))
        return pd.DataFrame({"model_name": ["isolation_forest"], "config": rows["config"].iloc[:1].to_numpy(), "place": rows["place"].iloc[:1].to_numpy(), "kind": ["isolation_forest"], "features": [features], "parameters": [json.dumps(found)], "failure_reason": [None]})

    parts = [(name, place, contamination, chunk, min(CHUNK, n - chunk * CHUNK)) for place, (name, n, contamination) in enumerate(grid) for chunk in range(-(-n // CHUNK))]
    todo = spark.createDataFrame(parts, "config string, place int, contamination double, chunk int, n int").repartition(len(parts), "config", "chunk")
    grown = todo.mapInPandas(grow, "config string, place int, contamination double, chunk int, n int, trees string")
    return grown.groupBy("config").applyInPandas(whole, _ROW).withColumn("parameters", F.parse_json("parameters"))


def _packed(trees: list[list[tuple]]) -> list[dict]:
    """Nodes as arrays; the right child of a node follows its left one."""
    return [{"f": [int(n[0]) for n in nodes], "cut": [float(n[1]) for n in nodes], "left": [int(n[2]) for n in nodes]} for nodes in trees]


def not_run(spark, model: str, reason: str) -> DataFrame:
    return _table(spark, [(model, "primary", 0, "none", [], None, reason)])


def _z(p: dict, x: np.ndarray, _: dict) -> np.ndarray:
    return np.abs((x - np.array(p["centre"])) / np.array(p["scale"])).max(axis=1)


def _distance(p: dict, x: np.ndarray, _: dict) -> np.ndarray:
    return np.sqrt((((x - np.array(p["centre"])) / np.array(p["scale"])) ** 2).sum(axis=1))


def _pca(p: dict, x: np.ndarray, _: dict) -> np.ndarray:
    parts = np.array(p["components"])
    z = (x - np.array(p["centre"])) / np.array(p["scale"]) - np.array(p["mean"])
    return ((z - z @ parts.T @ parts) ** 2).mean(axis=1)


def _forest(p: dict, x: np.ndarray, _: dict) -> np.ndarray:
    z, total = (x - np.array(p["centre"])) / np.array(p["scale"]), np.zeros(len(x))
    for tree in p["trees"]:
        f, cut, left = np.array(tree["f"]), np.array(tree["cut"]), np.array(tree["left"])
        at = np.zeros(len(z), int)
        while len(i := np.flatnonzero(f[at] >= 0)):
            at[i] = left[at[i]] + (z[i, f[at[i]]] >= cut[at[i]])
        total += cut[at]
    return 2 ** (-total / len(p["trees"]) / max(IsolationForest._usual(p["size"]), 1e-9)) - p["shift"]


def _logistic(p: dict, x: np.ndarray, others: dict) -> np.ndarray:
    inputs = np.stack([others[name] for name in p["inputs"]], axis=1)
    return 1 / (1 + np.exp(-(inputs @ np.array(p["weights"]) + p["intercept"])))


#: (parameters, rows of features, scores of models before) to scores, by kind.
SCORERS: dict[str, Callable[[dict, np.ndarray, dict], np.ndarray]] = {"z": _z, "distance": _distance, "pca": _pca, "isolation_forest": _forest, "logistic": _logistic}


def scores(rows: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, model_name, config, place, score): every model that was fitted on every row, in one pass."""
    spark = rows.sparkSession
    ship(spark)
    held = [r.asDict() for r in models.filter("failure_reason is null").select("model_name", "config", "place", "kind", "features", F.to_json("parameters").alias("parameters")).collect()]
    fitted = sorted(((r["kind"] == "logistic", r["model_name"], r["place"], r["config"], r["kind"], list(r["features"]), json.loads(r["parameters"])) for r in held), key=lambda r: r[:4])
    features = sorted({f for r in fitted for f in r[5]})
    shared = spark.sparkContext.broadcast(fitted)
    kept = rows.select(*[F.col(c) for c in keep], *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f_{f}") for f in features])
    fields = T.StructType([*(rows.schema[c] for c in keep), *T._parse_datatype_string(_LONG).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            others: dict[str, np.ndarray] = {}
            for _, model, place, config, kind, names, parameters in shared.value:
                x = batch[[f"_f_{f}" for f in names]].to_numpy(float)
                others[model] = SCORERS[kind](parameters, x, others)
                yield batch[keep].assign(model_name=model, config=config, place=place, score=others[model])

    return kept.mapInPandas(run, fields)


def thresholds(scored: DataFrame, y: str = "y", percents: tuple[float, ...] = (80, 85, 90, 95, 97, 99), digits: int = 6) -> DataFrame:
    """(model_name, config, place, threshold, tp, fp, tn, fn, f1, selected): of each configuration its best percentile, of each model its best configuration; the first of equals."""
    by = ["model_name", "config", "place"]
    cuts = percentiles_by(scored, by, "score", list(percents)).select(*by, F.posexplode("percentiles").alias("_i", "threshold"))
    counts = scored.select(*by, "score", y).join(F.broadcast(cuts), by).groupBy(*by, "_i", "threshold").agg(*confusion(F.col(y) == 1, F.col("score") >= F.col("threshold")))
    rated = rates(counts, digits)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "_i"))
    best = rated.withColumn("_r", first).filter("_r = 1")
    chosen = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc("f1"), "place")) == 1
    return best.withColumn("selected", chosen).select(*by, "threshold", "tp", "fp", "tn", "fn", "f1", "selected")


def frozen(models: DataFrame, cuts: DataFrame, path: str) -> DataFrame:
    """The models with their thresholds, of each the selected configuration (those that failed whole), written to ``path`` and read back."""
    chosen = cuts.filter("selected").select("model_name", "config", "threshold")
    able = models.filter("failure_reason is null").join(chosen, ["model_name", "config"])
    failed = models.filter("failure_reason is not null").join(chosen, "model_name", "left_anti").withColumn("threshold", F.lit(None).cast("double"))
    able.unionByName(failed).write.mode("append").parquet(path)
    return models.sparkSession.read.parquet(path)


def stacked_model(scored: DataFrame, key: str, y: str, name: str = "stacked", c: float = 1.0) -> DataFrame:
    """A logistic model on the selected models' scores, which Spark fits."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    inputs = sorted(r["model_name"] for r in scored.select("model_name").distinct().collect())
    wide = scored.groupBy(key).pivot("model_name", inputs).agg(F.max("score")).join(scored.select(key, F.col(y).cast("double").alias("_y")).distinct(), key)
    wide = settled(wide.select(*inputs, "_y"), "stacked")
    # a score that hardly varies is no input, and would be blown up by its own scale
    inputs = [name for name, (centre, spread) in moments(wide, inputs).items() if spread > 1e-9 * max(1.0, abs(centre))]
    if not inputs:
        return not_run(scored.sparkSession, name, "scores do not vary")
    rows = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="skip").transform(wide)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * max(1, rows.count())), standardization=False, maxIter=1000).fit(rows)
    weights = [float(w) for w in model.coefficients]
    if not all(map(math.isfinite, [*weights, model.intercept])):
        return not_run(scored.sparkSession, name, "labels of one class")
    return _table(scored.sparkSession, [(name, "primary", 0, "logistic", [], {"inputs": inputs, "weights": weights, "intercept": float(model.intercept)}, None)])


def judge(rows: DataFrame, models: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """(key, model_name, score, y_pred, failure_reason): frozen models with their frozen thresholds; one row for each that was not fitted."""
    scored = scores(rows, models, [key]).join(F.broadcast(models.select("model_name", "config", "threshold")), ["model_name", "config"])
    able = scored.select(key, "model_name", F.round("score", digits).alias("score"), F.coalesce(F.col("score") >= F.col("threshold") - 1e-9, F.lit(False)).cast("int").alias("y_pred"), F.lit(None).cast("string").alias("failure_reason"))
    lost = models.filter("failure_reason is not null").select("model_name", "failure_reason").distinct()
    return able.unionByName(lost, allowMissingColumns=True)


def attempted(spark, models: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(model_name, status, failure_reason, scored): each model run in turn, its failure caught; a missing library is NOT_RUN, anything else FAILED."""
    rows = []
    for name, run in models.items():
        try:
            rows.append((name, "PASS", None, run().count()))
        except ImportError as e:
            rows.append((name, "NOT_RUN", str(e), None))
        except Exception as e:  # noqa: BLE001 - one model's failure must not end the others
            rows.append((name, "FAILED", f"{type(e).__name__}: {e}", None))
    return spark.createDataFrame(rows, "model_name string, status string, failure_reason string, scored bigint")
