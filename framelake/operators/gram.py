"""Gram matrix of a feature table, the one pass behind the ridge head."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial matrices are added in so many groups per row first, so that no task adds those of all tasks.
BUCKETS = 64


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """X'X of the groups of one task, emitted as one row per group and matrix row."""
    bucket = TaskContext.get().partitionId() % BUCKETS
    totals, kind = {}, None
    for batch in batches:
        column, groups = batch.column("x"), batch.column("g")
        if len(column) == 0:
            continue
        kind = groups.type
        block = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        places = groups.dictionary_encode()
        own = places.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(places.dictionary.to_pylist()):
            part = block if len(places.dictionary) == 1 else block[own == k]
            product = part.T @ part
            totals[name] = product if name not in totals else totals[name] + product
    for name, total in totals.items():
        n = len(total)
        columns = [pa.array([name] * n, kind), pa.array(range(n), pa.int32()), pa.array([bucket] * n, pa.int32())]
        columns.append(pa.array(list(total), pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(columns, ["g", "i", "bucket", "products"])


def gram_rows(rows: DataFrame, values: str) -> DataFrame:
    """(i, products ARRAY<DOUBLE>): row i of X'X for an array column of equal widths.

    Each task of the scan multiplies its rows block by block, and the partial matrices are added row
    by row in two steps: a matrix row's partial rows meet in ``BUCKETS`` groups before the last sum.
    """
    return grouped_gram(rows.withColumn("g", F.lit(0)), values, "g").drop("g")


def grouped_gram(rows: DataFrame, values: str, group: str) -> DataFrame:
    """(group, i, products): a Gram matrix per group, all from one pass."""
    wide = rows.select(F.col(group).alias("g"), F.col(values).cast("array<double>").alias("x"))
    kind = wide.schema["g"].dataType.simpleString()
    partial = wide.mapInArrow(_partial_products, f"g {kind}, i int, bucket int, products array<double>")
    return summed_rows(partial).withColumnRenamed("g", group)


def summed_rows(partial: DataFrame) -> DataFrame:
    """(g, i, products): partial rows (g, i, bucket, products) of tasks added up, in two steps."""
    some = partial.groupBy("g", "i", "bucket").agg(Summarizer.sum(array_to_vector("products")).alias("s"))
    summed = some.groupBy("g", "i").agg(Summarizer.sum(F.col("s")).alias("s"))
    return summed.select("g", "i", vector_to_array("s").alias("products"))


def gram_matrix(rows: DataFrame, values: str = "features") -> DataFrame:
    """(i, j, value) of X'X."""
    return gram_rows(rows, values).select("i", F.posexplode("products").alias("j", "value"))


def collect_gram(rows: DataFrame, values: str, width: int) -> np.ndarray:
    """The matrix itself, width squared doubles on the driver, where it is solved."""
    matrix = np.zeros((width, width))
    for row in gram_rows(rows, values).toLocalIterator():
        matrix[row["i"]] = row["products"]
    return matrix
