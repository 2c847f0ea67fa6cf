"""Scoring of a fitted head on a labelled set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASSES
from ..sources.vector_cache import EmbeddingSet
from .heads import HeadModel
from .metrics import EvalResult, evaluate_predictions, score


def predicted_pairs(model: HeadModel, rows: DataFrame) -> DataFrame:
    """Rows with y_true next to y_pred: prediction is row-wise, so nothing is joined."""
    return model.predict(rows).withColumnRenamed("y", "y_true")


def evaluate(
    model: HeadModel, eval_set: EmbeddingSet | DataFrame, labels: Sequence[int] = CLASSES
) -> EvalResult:
    """Predict on a labelled set and score it; a set without labels is refused."""
    if isinstance(eval_set, EmbeddingSet):
        if not eval_set.has_labels:
            raise ValueError(f"{eval_set.split!r} has no labels to score against")
        eval_set = eval_set.df
    return evaluate_predictions(predicted_pairs(model, eval_set).select("y_true", "y_pred"), labels)


def evaluate_by(
    model: HeadModel, rows: DataFrame, by: Sequence[str], labels: Sequence[int] = CLASSES
) -> DataFrame:
    """Scores per group, e.g. per user or location."""
    pairs = predicted_pairs(model, rows).select(*by, "y_true", "y_pred")
    return score(pairs.where(F.col("y_true").isNotNull()), labels, by)
