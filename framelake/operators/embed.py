"""Embedding stage: frames to vectors, with a pluggable batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHANNELS, SAMPLES_PER_FRAME
from ..functions.samples import summary

#: (frames, channels, samples) float32 -> (frames, dim) or (frames, patches, dim).
Embedder = Callable[[np.ndarray], np.ndarray]


def embed_statistics(frames: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Built-in embedder without weights: mean, deviation, minimum, maximum per channel."""
    keep = [c for c in frames.columns if c not in channels]
    return frames.select(*keep, F.concat(*[summary(F.col(c)) for c in channels]).alias("features"))


def stack_channels(batch: pa.RecordBatch, channels: Sequence[str], width: int) -> np.ndarray:
    """(rows, channels, width) from list columns; absent or short channels end in zeros."""
    lengths = [pc.fill_null(pc.list_value_length(batch.column(c)), 0) for c in channels]
    longest = max(pc.max(n).as_py() or 0 for n in lengths)
    if longest > width:
        raise ValueError(f"a channel of {longest} samples does not fit frames of {width}")
    block = np.zeros((batch.num_rows, len(channels), width), dtype=np.float32)
    for j, (name, n) in enumerate(zip(channels, lengths, strict=True)):
        values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
        filled = np.arange(width) < n.to_numpy(zero_copy_only=False)[:, None]
        block[:, j, :][filled] = values
    return block


def embed_frames(
    frames: DataFrame,
    load: Callable[[], Embedder],
    *,
    channels: Sequence[str] = CHANNELS,
    n_samples: int = SAMPLES_PER_FRAME,
    batch_rows: int = 256,
) -> DataFrame:
    """Run a frozen model over frames of ``n_samples``, batch by batch on the executors.

    Every frame enters with that width, whatever its neighbours: shorter channels end in zeros,
    longer ones are refused.

    ``load`` opens the model once per task that has frames, from a pinned place that executors
    can reach. A result
    with patches is mean-pooled over them. A missing channel enters as zeros.
    """
    names = list(channels)
    keep = [c for c in frames.columns if c not in names]
    schema = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                vectors = np.asarray(model(stack_channels(part, names, n_samples)), dtype=np.float32)
                if vectors.ndim == 3:
                    vectors = vectors.mean(axis=1)
                columns = [part.column(c) for c in keep]
                columns.append(pa.array(list(vectors), pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "features"])

    return frames.select(*keep, *names).mapInArrow(run, f"{schema}, features array<float>")
