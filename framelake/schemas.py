"""Explicit schemas, so that no read infers a type (revision ``007`` stays text)."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import CHANNELS, RUN_COLUMNS

CACHE_KEYS = ("fm", "revision", "split", "location")

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("frame_idx", T.LongType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
        T.StructField("y", T.ShortType()),
        T.StructField("pooling", T.StringType()),
        T.StructField("fm", T.StringType()),
        T.StructField("revision", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("location", T.StringType()),
    ]
)

#: What the log of a cache keeps of each slice and write.
SLICE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in CACHE_KEYS]
    + [
        T.StructField("n", T.LongType()),
        T.StructField("n_labelled", T.LongType()),
        T.StructField("min_dim", T.IntegerType()),
        T.StructField("max_dim", T.IntegerType()),
        T.StructField("pooling", T.StringType()),
        T.StructField("other_pooling", T.StringType()),
        T.StructField("files", T.LongType()),
        T.StructField("commit", T.StringType()),
        T.StructField("slices", T.LongType()),
    ]
)

FRAME_SCHEMA = T.StructType(
    [T.StructField("frame_idx", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.FloatType())) for c in CHANNELS]
    + [
        T.StructField("y", T.ShortType()),
        T.StructField("split", T.StringType()),
        T.StructField("location", T.StringType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [T.StructField("frame_idx", T.LongType()), T.StructField("y_pred", T.IntegerType())]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

EXPERIMENT_SCHEMA = T.StructType(
    [T.StructField("experiment_id", T.StringType()), T.StructField("name", T.StringType())]
)

RUN_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("step", T.LongType()),
    ]
)

_LEADERBOARD_TYPES = {
    "macro_f1": T.DoubleType(),
    "accuracy": T.DoubleType(),
    "start_time": T.TimestampType(),
}

LEADERBOARD_SCHEMA = T.StructType(
    [T.StructField(c, _LEADERBOARD_TYPES.get(c, T.StringType())) for c in RUN_COLUMNS]
)
