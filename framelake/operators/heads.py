"""Classifier heads on frozen vectors: standardised features, then a small trainable model.

``linear`` solves the ridge problem from one Gram pass, ``logreg`` and ``mlp`` are Spark ML
estimators. Labels of any numbering are mapped to 0..K-1 for fitting and back for predictions.
No head stores a scaled copy of the training set unless it passes over it many times: ``linear``
scales inside its one pass and ``logreg`` lets the estimator standardise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, persisted
from .gram import collect_gram, grouped_gram
from .grouped_logreg import fit_groups
from .scaling import SCALED, VECTOR, PopulationScaler, scale, with_vector

_INDEX = "class_index"
#: Rows that a task of the perceptron's training takes at least: below, its start costs more than its step.
STEP_ROWS = 2048


def _class_array(classes: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


@dataclass(frozen=True)
class HeadModel:
    """A fitted head. ``weights`` is set for the linear head, ``classifier`` for the others.

    ``scaler`` is absent where the classifier works on the original scale.
    """

    name: str
    classes: tuple[int, ...]
    scaler: PipelineModel | None = None
    classifier: Any = None
    weights: np.ndarray | None = None
    meta: dict[str, str] = field(default_factory=dict)

    @property
    def _scale(self) -> str:
        return VECTOR if self.scaler is None else SCALED

    def _input(self, rows: DataFrame) -> DataFrame:
        vectors = with_vector(rows)
        return vectors if self.scaler is None else scale(vectors, self.scaler)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``y_pred``; row-wise, so it works on batch and streaming input alike."""
        scaled = self._input(rows)
        if self.weights is not None:
            index = _linear_index(self.weights)(vector_to_array(self._scale, "float32"))
            found = scaled.withColumn(_INDEX, index)
        else:
            found = self.classifier.transform(scaled).withColumn(
                _INDEX, F.col("prediction").cast("int")
            )
        label = F.element_at(_class_array(self.classes), F.col(_INDEX) + 1)
        return found.withColumn("y_pred", label).select(*rows.columns, "y_pred")

    def scores(self, rows: DataFrame) -> DataFrame:
        """Add ``scores ARRAY<DOUBLE>`` (one per class) and ``y_pred``."""
        scaled = self._input(rows)
        if self.weights is not None:
            found = scaled.withColumn(
                "scores", _linear_scores(self.weights)(vector_to_array(self._scale, "float32"))
            )
        else:
            found = self.classifier.transform(scaled).withColumn(
                "scores", vector_to_array("rawPrediction")
            )
        best = F.array_position("scores", F.array_max("scores")).cast("int")
        label = F.element_at(_class_array(self.classes), best)
        return found.withColumn("y_pred", label).select(*rows.columns, "scores", "y_pred")

    def save(self, path: str) -> None:
        """Write scaler, classifier and a one-row description below ``path``."""
        spark = SparkSession.getActiveSession()
        if self.scaler is not None:
            self.scaler.write().overwrite().save(f"{path}/scaler")
        if self.classifier is not None:
            PipelineModel([self.classifier]).write().overwrite().save(f"{path}/classifier")
        weights = None if self.weights is None else self.weights.tolist()
        row = (self.name, list(self.classes), json.dumps(self.meta), weights, self.scaler is not None)
        spark.createDataFrame(
            [row],
            "name string, classes array<int>, meta string, weights array<array<double>>, scaled boolean",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HeadModel:
        row = spark.read.parquet(f"{path}/head").first()
        classifier = None
        if row["weights"] is None:
            classifier = PipelineModel.load(f"{path}/classifier").stages[0]
        return HeadModel(
            name=row["name"],
            classes=tuple(row["classes"]),
            scaler=PipelineModel.load(f"{path}/scaler") if row["scaled"] else None,
            classifier=classifier,
            weights=None if row["weights"] is None else np.asarray(row["weights"]),
            meta=json.loads(row["meta"]),
        )


def _product(x: pa.Array, weights: np.ndarray) -> np.ndarray:
    """x W + b for a list column of equal widths; the last row of ``weights`` is b."""
    block = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return block @ weights[:-1] + weights[-1]


def _linear_scores(weights: np.ndarray) -> Callable[..., Column]:
    @F.arrow_udf("array<double>")
    def scores(x: pa.Array) -> pa.Array:
        return pa.array(list(_product(x, weights)), pa.list_(pa.float64()))

    return scores


def _linear_index(weights: np.ndarray) -> Callable[..., Column]:
    @F.arrow_udf("int")
    def index(x: pa.Array) -> pa.Array:
        return pa.array(_product(x, weights).argmax(axis=1), pa.int32())

    return index


@dataclass(frozen=True)
class _TrainingSet:
    """Vectors with a 0-based class index, and how often each class occurs."""

    rows: DataFrame
    classes: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def n(self) -> int:
        return sum(self.counts)

    def scaled(self) -> tuple[PipelineModel, DataFrame, int]:
        """Fitted scaler, lazily scaled rows and their width; one pass for the statistics."""
        scaler = PopulationScaler(self.n).fit(self.rows)
        return scaler, scale(self.rows, scaler).select(SCALED, _INDEX), scaler.stages[0].mean.size


def _fit_ridge(train: _TrainingSet, seed: int, alpha: float = 1.0) -> dict[str, Any]:
    """Ridge regression on +-1 targets, one column per class, from one Gram pass.

    The scaled features have mean 0, so the intercept is the mean target.
    """
    k = len(train.classes)
    index = F.col(_INDEX)
    scaler, rows, d = train.scaled()
    targets = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda c: F.when(index == c, F.lit(1.0)).otherwise(F.lit(-1.0)),
    )
    joint = rows.select(F.concat(vector_to_array(SCALED), targets).alias("joint"))
    gram = collect_gram(joint, "joint", d + k)
    intercept = (2.0 * np.asarray(train.counts) - train.n) / train.n
    coefficients = np.linalg.solve(gram[:d, :d] + alpha * np.eye(d), gram[:d, d:])
    return {"scaler": scaler, "weights": np.vstack([coefficients, intercept])}


def _fit_logreg(
    train: _TrainingSet,
    seed: int,
    C: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
    fit_intercept: bool = True,
) -> dict[str, Any]:
    """Multinomial logistic regression on standardised features, L2 penalty 1 / (C n).

    The estimator standardises by the sample deviation and keeps its own blocks of the data; the
    factor (n - 1) / n turns its penalty into the one for the population deviation.
    """
    n = train.n
    estimator = LogisticRegression(
        featuresCol=VECTOR,
        labelCol=_INDEX,
        family="multinomial",
        regParam=(n - 1) / n / (C * n),
        elasticNetParam=0.0,
        standardization=True,
        maxIter=max_iter,
        tol=tol,
        fitIntercept=fit_intercept,
    )
    return {"classifier": estimator.fit(train.rows)}


def _fit_mlp(
    train: _TrainingSet,
    seed: int,
    hidden_layer_sizes: tuple[int, ...] = (256,),
    max_iter: int = 300,
    early_stopping: bool = True,
    round_iter: int = 25,
    patience: int = 2,
    tol: float = 1e-4,
) -> dict[str, Any]:
    """Multilayer perceptron; with early stopping it trains in rounds from the last weights.

    A tenth of the rows, chosen by a hash of their vector, is held out. Training ends when the
    held-out accuracy has not risen for ``patience`` rounds, and the best round is kept. The
    rounds share one scaled copy of the training set, dealt to all cores: a step is work on every row,
    and a scan has as few tasks as there are files.
    """
    scaler, scaled, width = train.scaled()
    scaled = dealt(scaled, -(-train.n // STEP_ROWS))
    layers = [width, *hidden_layer_sizes, len(train.classes)]

    def estimator(iterations: int) -> MultilayerPerceptronClassifier:
        return MultilayerPerceptronClassifier(
            featuresCol=SCALED, labelCol=_INDEX, layers=layers, maxIter=iterations, seed=seed
        )

    if not early_stopping:
        return {"scaler": scaler, "classifier": estimator(max_iter).fit(scaled)}
    kept = persisted(scaled)
    try:
        draw = F.pmod(F.xxhash64(F.lit(seed), vector_to_array(SCALED)), F.lit(10))
        fit_rows, held_out = kept.where(draw != 0), kept.where(draw == 0)
        if held_out.isEmpty():
            return {"scaler": scaler, "classifier": estimator(max_iter).fit(kept)}
        best, best_score, stale, weights = None, -1.0, 0, None
        for done in range(0, max_iter, round_iter):
            step = estimator(min(round_iter, max_iter - done))
            if weights is not None:
                step = step.setInitialWeights(weights)
            model = step.fit(fit_rows)
            weights = model.weights
            hits = (F.col("prediction") == F.col(_INDEX)).cast("double")
            score = model.transform(held_out).agg(F.avg(hits)).first()[0]
            if score > best_score + tol:
                best, best_score, stale = model, score, 0
            else:
                stale += 1
                if stale >= patience:
                    break
        return {"scaler": scaler, "classifier": best}
    finally:
        kept.unpersist()


#: Register another builder here: (training set, seed, **params) -> fitted parts.
BUILDERS: dict[str, Callable[..., dict[str, Any]]] = {
    "linear": _fit_ridge,
    "logreg": _fit_logreg,
    "mlp": _fit_mlp,
}


def list_heads() -> list[str]:
    return sorted(BUILDERS)


@dataclass(frozen=True)
class Head:
    """An unfitted head: name, seed and parameters."""

    name: str
    seed: int = 0
    params: dict[str, Any] = field(default_factory=dict)

    def fit(self, rows: DataFrame, **meta: str) -> HeadModel:
        """Fit on rows of (features, y); every row needs a label.

        Counting the classes reads the label column only.
        """
        labelled = rows.select(F.col("features"), F.col("y").cast("int").alias("y"))
        # A row per class, as many as the model has outputs.
        by_class = labelled.groupBy("y").count().orderBy("y").collect()
        if not by_class or by_class[0]["y"] is None:
            raise ValueError("the training set has no labels or only some")
        classes = tuple(r["y"] for r in by_class)
        index = (F.array_position(_class_array(classes), F.col("y")) - 1).cast("int")
        train = _TrainingSet(
            rows=with_vector(labelled).select(VECTOR, index.alias(_INDEX)),
            classes=classes,
            counts=tuple(r["count"] for r in by_class),
        )
        parts = BUILDERS[self.name](train, self.seed, **self.params)
        return HeadModel(name=self.name, classes=classes, meta=dict(meta), **parts)


def make_head(name: str = "logreg", *, seed: int = 0, **params: Any) -> Head:
    """A head by name; ``params`` go to its builder (``C``, ``alpha``, ``hidden_layer_sizes``...)."""
    if name not in BUILDERS:
        raise ValueError(f"no head is called {name!r}; there are {list_heads()}")
    return Head(name, seed, params)


def fit_per_group(
    rows: DataFrame, head: Head, column: str, groups: tuple[str, ...]
) -> dict[str, HeadModel]:
    """One head per named group, e.g. per phone location (a fixed short list).

    ``linear`` heads of all groups come from one pass, and ``logreg`` heads from one pass per step for all
    groups together; the estimator behind ``mlp`` fits one data set at a time.
    """
    if head.name == "linear":
        return _ridge_per_group(rows, column, groups, **head.params)
    if head.name == "logreg" and set(head.params) <= {"C", "max_iter", "tol"}:
        fitted = fit_groups(rows, column, groups, **head.params)
        return {g: HeadModel(name="logreg", classes=c, weights=w) for g, (c, w) in fitted.items()}
    return {g: head.fit(rows.where(F.col(column) == g)) for g in groups}


def _ridge_per_group(
    rows: DataFrame, column: str, groups: tuple[str, ...], alpha: float = 1.0
) -> dict[str, HeadModel]:
    """Ridge heads from one Gram matrix per group of [features, 1, one column per class].

    The matrix holds the sums, counts and products that standardising and solving need.
    """
    labelled = rows.where(F.col(column).isin(list(groups)))
    found = labelled.groupBy(F.col(column).alias("g"), F.col("y").cast("int").alias("y")).count().collect()
    if any(r["y"] is None for r in found) or len({r["g"] for r in found}) < len(groups):
        raise ValueError("the training set has no labels or only some")
    classes = sorted({r["y"] for r in found})
    marks = F.transform(_class_array(tuple(classes)), lambda c: F.when(c == F.col("y"), 1.0).otherwise(0.0))
    joint = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)), marks)
    table: dict[str, dict[int, list[float]]] = {g: {} for g in groups}
    for r in grouped_gram(labelled.select(F.col(column).alias("g"), joint.alias("x")), "x", "g").collect():
        table[r["g"]][r["i"]] = r["products"]
    models = {}
    for g, parts in table.items():
        gram = np.array([parts[i] for i in range(len(parts))])
        d = len(gram) - 1 - len(classes)
        n, sums = gram[d, d], gram[:d, d]
        own = [k for k in range(len(classes)) if gram[d, d + 1 + k] > 0]
        counts = gram[d, d + 1 :][own]
        mean = sums / n
        spread = np.sqrt(np.maximum(np.diag(gram)[:d] / n - mean**2, 0))
        scale_by = np.divide(1.0, spread, out=np.zeros(d), where=spread > 1e-12 * np.maximum(np.abs(mean), 1e-300))
        covered = (gram[:d, :d] - n * np.outer(mean, mean)) * np.outer(scale_by, scale_by)
        # Targets are +1 for the class and -1 for the rest.
        targets = 2.0 * gram[:d, d + 1 :][:, own] - sums[:, None]
        bias = (2.0 * counts - n) / n
        crossed = (targets - np.outer(mean, n * bias)) * scale_by[:, None]
        weights = np.linalg.solve(covered + alpha * np.eye(d), crossed) * scale_by[:, None]
        models[g] = HeadModel(
            name="linear",
            classes=tuple(classes[k] for k in own),
            weights=np.vstack([weights, bias - mean @ weights]),
        )
    return models


def predict_per_group(rows: DataFrame, models: dict[str, HeadModel], column: str) -> DataFrame:
    """Predict each group with its own head; partition filters keep every scan to its group.

    Rows of a group without a head stay, with a NULL prediction.
    """
    rest = rows.where(F.col(column).isNull() | ~F.col(column).isin(list(models)))
    parts = [m.predict(rows.where(F.col(column) == g)) for g, m in models.items()]
    parts.append(rest.withColumn("y_pred", F.lit(None).cast("int")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
