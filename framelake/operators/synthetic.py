"""Class-separable vectors for trying the pipeline before real embeddings exist.

Every draw is a hash of the seed and the keys it belongs to, so the same seed gives the same
rows whatever the number of partitions, also when a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASSES, N_CLASSES, POOLED_LOCATION, TEST_LOCATIONS, TRAIN_LOCATIONS
from ..functions.vectors import add, normal_vector, uniform
from ..sources.vector_cache import write_cache

SHIFT_SCALE = 0.3


def _centroids(spark: SparkSession, dim: int, separation: float, seed: int) -> DataFrame:
    """(class, centroid): one row per class."""
    classes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class"))
    draws = normal_vector(seed, dim, F.lit("centroid"), F.col("class"))
    return classes.select("class", F.transform(draws, lambda x: x * separation).alias("centroid"))


def _shifts(spark: SparkSession, dim: int, seed: int) -> DataFrame:
    """(location, shift): one row per location, and their mean over the test locations."""
    places = spark.range(1).select(
        F.explode(F.array(*[F.lit(p) for p in TRAIN_LOCATIONS])).alias("location")
    )
    draws = normal_vector(seed, dim, F.lit("shift"), F.col("location"))
    single = places.select(
        "location", F.transform(draws, lambda x: x * SHIFT_SCALE).alias("shift")
    )
    # Three short rows: the element-wise mean of the shifts that occur at test time.
    stacked = single.where(F.col("location").isin(list(TEST_LOCATIONS))).agg(
        F.collect_list("shift").alias("shifts")
    )
    mean = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: F.aggregate("shifts", F.lit(0.0), lambda acc, v: acc + F.get(v, d))
        / F.size("shifts"),
    )
    return single.unionByName(stacked.select(F.lit(POOLED_LOCATION).alias("location"), mean.alias("shift")))


def synthetic_vectors(
    keys: DataFrame, *, dim: int = 32, separation: float = 2.5, seed: int = 0
) -> DataFrame:
    """Add ``features`` to rows with (split, location, frame_idx, class).

    centroid of the class + shift of the location + unit noise. The two lookup tables have one
    row per class and per location, so they are broadcast.
    """
    spark = keys.sparkSession
    noise = normal_vector(
        seed, dim, F.lit("noise"), F.col("split"), F.col("location"), F.col("frame_idx")
    )
    joined = keys.join(F.broadcast(_centroids(spark, dim, separation, seed)), "class").join(
        F.broadcast(_shifts(spark, dim, seed)), "location"
    )
    vector = add(add(F.col("centroid"), F.col("shift")), noise)
    return joined.select(*keys.columns, vector.cast("array<float>").alias("features"))


def synthetic_keys(
    spark: SparkSession, *, n_per_class: int = 64, n_test: int = 256, seed: int = 0
) -> DataFrame:
    """(split, location, frame_idx, class, y): balanced train and validation, unlabelled test."""
    places = F.array(*[F.lit(p) for p in TRAIN_LOCATIONS])

    def labelled(split: str, n_each: int) -> DataFrame:
        frames = spark.range(N_CLASSES * n_each)
        label = (F.col("id") % N_CLASSES + 1).cast("int")
        return frames.select(
            F.lit(split).alias("split"),
            F.explode(places).alias("location"),
            F.col("id").alias("frame_idx"),
            label.alias("class"),
            label.alias("y"),
        )

    drawn = F.floor(uniform(seed, F.lit("test class"), F.col("id")) * N_CLASSES).cast("int") + 1
    test = spark.range(n_test).select(
        F.lit("test").alias("split"),
        F.lit(POOLED_LOCATION).alias("location"),
        F.col("id").alias("frame_idx"),
        drawn.alias("class"),
        F.lit(None).cast("int").alias("y"),
    )
    return (
        labelled("train", n_per_class)
        .unionByName(labelled("validation", max(8, n_per_class // 4)))
        .unionByName(test)
    )


def make_synthetic_cache(
    spark: SparkSession,
    root: str,
    *,
    fm: str = "synthetic",
    revision: str = "v1",
    dim: int = 32,
    n_per_class: int = 64,
    n_test: int = 256,
    separation: float = 2.5,
    seed: int = 0,
) -> str:
    """Write a learnable cache below ``root``."""
    keys = synthetic_keys(spark, n_per_class=n_per_class, n_test=n_test, seed=seed)
    rows = synthetic_vectors(keys, dim=dim, separation=separation, seed=seed)
    tagged = rows.drop("class").withColumns({"fm": F.lit(fm), "revision": F.lit(revision)})
    return write_cache(tagged, root)
