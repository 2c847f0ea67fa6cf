"""Alignment of two tables by frame key and comparison of two runs.

Both sides are stacked and grouped by key instead of joined: one shuffle, partial aggregation
before it, and a key that is repeated on both sides cannot multiply into all its pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import max_abs_diff


def align(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str
) -> DataFrame:
    """(keys, left_value, right_value, n_left, n_right): a full outer match on ``keys``."""
    nothing = F.lit(None)
    stacked = left.select(
        *keys,
        F.lit(True).alias("is_left"),
        F.col(left_value).alias("a"),
        nothing.cast(right.schema[right_value].dataType).alias("b"),
    ).unionByName(
        right.select(
            *keys,
            F.lit(False).alias("is_left"),
            nothing.cast(left.schema[left_value].dataType).alias("a"),
            F.col(right_value).alias("b"),
        )
    )
    return stacked.groupBy(*keys).agg(
        F.max("a").alias(left_value),
        F.max("b").alias(right_value),
        F.count_if("is_left").alias("n_left"),
        F.count_if(~F.col("is_left")).alias("n_right"),
    )


def unmatched(aligned: DataFrame) -> DataFrame:
    """Keys that are missing or repeated on one side."""
    return aligned.where((F.col("n_left") != 1) | (F.col("n_right") != 1))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """One row: keys, those only left, only right, and repeated."""
    return aligned.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n_right") == 0).alias("only_left"),
        F.count_if(F.col("n_left") == 0).alias("only_right"),
        F.count_if((F.col("n_left") > 1) | (F.col("n_right") > 1)).alias("repeated"),
    )


def join_truth(truth: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y_true, y_pred) of frames present exactly once on both sides."""
    aligned = align(truth, predictions, keys, "y_true", "y_pred")
    return aligned.where((F.col("n_left") == 1) & (F.col("n_right") == 1)).select(
        *keys, "y_true", "y_pred"
    )


def require_aligned(truth: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`join_truth`, but any unmatched or repeated frame is an error."""
    counts = alignment_summary(align(truth, predictions, keys, "y_true", "y_pred")).first()
    if counts["only_left"] or counts["only_right"] or counts["repeated"]:
        raise ValueError(
            f"truth and predictions differ: {counts['only_left']} frames without prediction, "
            f"{counts['only_right']} without truth, {counts['repeated']} repeated"
        )
    return join_truth(truth, predictions, keys)


def compare_runs(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reproduction check of two score tables (keys, scores ARRAY<DOUBLE>, y_pred).

    One row: matched and unmatched frames, frames that a side repeats, matched frames whose score
    vectors differ in width, and over the others the largest absolute score difference and the
    number of frames whose predicted class differs. A frame that is repeated is not matched.
    """
    both = ["scores", "y_pred"]
    packed = [
        side.select(*keys, F.struct(*both).alias(name))
        for side, name in ((first, "a"), (second, "b"))
    ]
    aligned = align(packed[0], packed[1], keys, "a", "b")
    matched = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    repeated = (F.col("n_left") > 1) | (F.col("n_right") > 1)
    wide = matched & ~F.size("a.scores").eqNullSafe(F.size("b.scores"))
    gap = max_abs_diff(F.col("a.scores"), F.col("b.scores"))
    return aligned.agg(
        F.count_if(matched).alias("n_matched"),
        F.count_if(~matched).alias("n_unmatched"),
        F.count_if(repeated).alias("n_repeated"),
        F.count_if(wide).alias("n_width_diff"),
        F.max(F.when(matched & ~wide, gap)).alias("max_abs_diff"),
        F.count_if(matched & (F.col("a.y_pred") != F.col("b.y_pred"))).alias("n_argmax_diff"),
    )
