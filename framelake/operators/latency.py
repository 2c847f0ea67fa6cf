"""Latency of a model per window, timed where it runs.

Executors time every batch that they give to the model, and only that: reading, shuffling and scheduling do not
count. The times, one small row per batch, are merged as a quantile sketch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHANNELS, SAMPLES_PER_FRAME
from .embed import Embedder, stack_channels
from .heads import HeadModel

BATCH = 256
_TIMES = "windows long, ms double"


def _timed(rows: DataFrame, load: Callable[[], Callable], block: Callable[[pa.RecordBatch], np.ndarray], batch_rows: int) -> DataFrame:
    """(windows, ms): a row per batch, ``ms`` per window. The first batch of a task, which warms the model, is run twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            windows, times = [], []
            for start in range(0, batch.num_rows, batch_rows):
                part = block(batch.slice(start, batch_rows))
                if model is None:
                    model = load()
                    model(part)
                began = time.perf_counter()
                model(part)
                windows.append(len(part))
                times.append(1000.0 * (time.perf_counter() - began) / len(part))
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.int64()), pa.array(times, pa.float64())], names=["windows", "ms"])

    return rows.mapInArrow(run, _TIMES)


def latency_summary(times: DataFrame) -> DataFrame:
    """One row (n, mean_ms, p50_ms, p95_ms); quantiles over batches. Without windows all but ``n`` are NULL."""
    points = F.percentile_approx("ms", [0.5, 0.95], 10_000)
    found = times.agg(
        F.coalesce(F.sum("windows"), F.lit(0)).alias("n"),
        (F.sum(F.col("ms") * F.col("windows")) / F.sum("windows")).alias("mean_ms"),
        points.alias("p"),
    )
    return found.select("n", "mean_ms", F.get("p", F.lit(0)).alias("p50_ms"), F.get("p", F.lit(1)).alias("p95_ms"))


def embed_latency(
    frames: DataFrame,
    load: Callable[[], Embedder],
    *,
    channels: Sequence[str] = CHANNELS,
    n_samples: int = SAMPLES_PER_FRAME,
    batch_rows: int = BATCH,
) -> DataFrame:
    """The latency of an embedding model over frames, see :func:`latency_summary`."""
    names = list(channels)
    block = lambda batch: stack_channels(batch, names, n_samples)
    return latency_summary(_timed(frames.select(*names), load, block, batch_rows))


def numpy_scorer(model: HeadModel) -> Callable[[np.ndarray], np.ndarray]:
    """The scores of a head for a block of features, by its own weights."""
    centre = spread = None
    if model.scaler is not None:
        sample, factor = model.scaler.stages
        centre = sample.mean.toArray()
        std = sample.std.toArray()
        spread = np.divide(factor.getScalingVec().toArray(), std, out=np.zeros_like(std), where=std > 0)
    layers: list[np.ndarray] = []
    if model.weights is not None:
        layers = [np.asarray(model.weights)]
    elif hasattr(model.classifier, "coefficientMatrix"):
        fitted = model.classifier
        layers = [np.vstack([fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()])]
    else:
        flat, sizes, at = model.classifier.weights.toArray(), model.classifier.getLayers(), 0
        for wide, narrow in zip(sizes, sizes[1:]):
            table = flat[at : at + wide * narrow].reshape(wide, narrow)
            layers.append(np.vstack([table, flat[at + wide * narrow : at + (wide + 1) * narrow]]))
            at += (wide + 1) * narrow

    def score(block: np.ndarray) -> np.ndarray:
        x = block if centre is None else (block - centre) * spread
        for k, layer in enumerate(layers):
            x = x @ layer[:-1] + layer[-1]
            if k + 1 < len(layers):
                x = 1.0 / (1.0 + np.exp(-x))
        return x

    return score


def head_latency(model: HeadModel, rows: DataFrame, batch_rows: int = BATCH) -> DataFrame:
    """The latency of a head over feature rows, see :func:`latency_summary`."""
    score = numpy_scorer(model)

    def block(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)

    return latency_summary(_timed(rows.select("features"), lambda: score, block, batch_rows))
