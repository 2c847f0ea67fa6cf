"""Feature fusion: vectors of several models side by side."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import FRAME_KEYS


def fuse_models(
    cache: DataFrame, models: Sequence[tuple[str, str]], keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """(keys, y, features): vectors of (model, revision) pairs concatenated in the given order.

    Frames that lack one of the pairs are left out. One shuffle on the frame key serves any
    number of models.
    """
    own = [(F.col("fm") == fm) & (F.col("revision") == revision) for fm, revision in models]
    rows = cache.where(functools.reduce(operator.or_, own))
    # A task of the scan holds one model's rows of a frame: combining there would only sort them twice.
    wide = rows.repartition(*[F.col(k) for k in keys]).groupBy(*keys).agg(
        F.max("y").alias("y"),
        *[F.any_value(F.when(mine, F.col("features")), ignoreNulls=True).alias(f"m{i}") for i, mine in enumerate(own)],
    )
    parts = [f"m{i}" for i in range(len(models))]
    return wide.dropna(subset=parts).select(*keys, "y", F.concat(*parts).alias("features"))
