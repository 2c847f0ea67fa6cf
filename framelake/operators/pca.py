"""Principal components of standardised vectors, from the same Gram pass as the ridge head."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gram import collect_gram
from .scaling import SCALED, VECTOR, PopulationScaler, scale, with_vector


@dataclass(frozen=True)
class Pca:
    """A fitted projection: scaler, components (width x k, orthonormal) and the variance along each."""

    scaler: object
    components: np.ndarray
    variances: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features`` replaced by their components."""
        components = self.components

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def project(x: pa.Array) -> pa.Array:
            block = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            return pa.array(list((block @ components).astype(np.float32)), pa.list_(pa.float32()))

        scaled = scale(with_vector(rows), self.scaler)
        reduced = scaled.withColumn("features", project(vector_to_array(SCALED)))
        return reduced.select(*rows.columns)


def fit_pca(rows: DataFrame, k: int) -> Pca:
    """The ``k`` directions of largest variance of the standardised ``features``.

    The matrix of products is summed on the executors; only its eigenvectors are found on the driver.
    The sign of a component is that of its largest element.
    """
    vectors = with_vector(rows).select(VECTOR)
    scaler = PopulationScaler().fit(vectors)
    width = scaler.stages[0].mean.size
    scaled = scale(vectors, scaler).select(vector_to_array(SCALED).alias("x"))
    values, found = np.linalg.eigh(collect_gram(scaled, "x", width) / rows.count())
    order = np.argsort(values)[::-1][:k]
    components = found[:, order]
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(len(order))])
    return Pca(scaler, components * signs, values[order])
