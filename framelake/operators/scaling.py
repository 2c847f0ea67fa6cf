"""Feature statistics and the scaler in front of every head."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "feature_vector"
SCALED = "scaled_vector"


def with_vector(rows: DataFrame, features: str = "features") -> DataFrame:
    """Add the ML vector column; the only place where arrays become vectors."""
    return rows.withColumn(VECTOR, array_to_vector(F.col(features).cast("array<double>")))


def scaler_stats(rows: DataFrame, features: str = "features") -> DataFrame:
    """(dim, mean, std): mean and population deviation per feature.

    One keyless vector aggregate: each task sends one pair of vectors to the shuffle.
    """
    wanted = Summarizer.metrics("mean", "variance", "count")
    summary = with_vector(rows, features).select(wanted.summary(F.col(VECTOR)).alias("s"))
    unbias = F.try_divide(F.col("n") - 1, F.col("n"))
    pairs = F.arrays_zip("mean", "variance")
    return (
        summary.select(
            vector_to_array("s.mean").alias("mean"),
            vector_to_array("s.variance").alias("variance"),
            F.col("s.count").alias("n"),
        )
        .select("n", F.posexplode(pairs).alias("dim", "m"))
        .select(
            F.col("dim").cast("int").alias("dim"),
            F.col("m.mean").alias("mean"),
            F.sqrt(F.col("m.variance") * unbias).alias("std"),
        )
    )


def vector_mean(rows: DataFrame, features: str = "features", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, dim, mean): element-wise mean of vectors."""
    summary = (
        with_vector(rows, features)
        .groupBy(*by)
        .agg(vector_to_array(Summarizer.mean(F.col(VECTOR))).alias("mean"))
    )
    return summary.select(*by, F.posexplode("mean").alias("dim", "mean"))


class PopulationScaler(Estimator):
    """Zero mean and unit population deviation per feature; constant features become 0.

    Spark's scaler divides by the sample deviation, so a constant factor follows it. ``n`` is the
    number of rows where the caller has counted them already.
    """

    def __init__(self, n: int | None = None) -> None:
        super().__init__()
        self.n = n

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        sample = StandardScaler(inputCol=VECTOR, outputCol="sample_scaled", withMean=True, withStd=True)
        model = sample.fit(dataset)
        n = dataset.count() if self.n is None else self.n
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        width = model.mean.size
        rescale = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * width), inputCol="sample_scaled", outputCol=SCALED
        )
        return PipelineModel([model, rescale])


def scale(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the scaled vector to rows that already have the vector column."""
    return model.transform(rows).drop("sample_scaled")
