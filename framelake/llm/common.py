"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import scratch_path

ROWS_AT_ONCE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that Python objects of only so many rows exist at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; a null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def worker_memory(key: str, make: Callable):
    """A value that a reused Python worker keeps between tasks, built on first use.

    Task functions are sent by value, so a module's own globals start anew with each task.
    """
    module = sys.modules.setdefault("_framelake_worker", types.ModuleType("_framelake_worker"))
    if key not in module.__dict__:
        module.__dict__[key] = make()
    return module.__dict__[key]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are. Whole-string ``lower`` is the fast way for ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the driver and all executors share, as a URI with a scheme."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, attempt: str, final: str) -> None:
    """Give a finished file its name in one step, so a task that runs twice leaves one whole file."""
    fs.move(attempt, final)


def attempt_path(folder: str, name: str, attempt: int) -> str:
    return os.path.join(folder, f".{name}.{attempt}")
