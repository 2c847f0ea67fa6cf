"""Append-only tables of small records, merged when they are read.

A write adds one file, which is there whole or not at all; a write of many records adds a file per task, and each
record is there whole or not at all. Records carry a sequence number, one above
what their writer saw, and the id of their write; of the records of one key the greatest (sequence, write
id) counts, so two writers that saw the same state still leave one answer, the same for every reader.
Compaction rewrites what counts and then removes the files that it read. A reader in between sees
records twice, which changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP = [T.StructField("sequence", T.LongType()), T.StructField("write_id", T.StringType())]


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """All records with their stamp; None when there is no table. Other errors are raised."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, *STAMP])).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The record of each key that counts, stamp included; records without a stamp come before all others."""
    rest = [c for c in records.columns if c not in keys]
    stamp = F.struct(F.coalesce("sequence", F.lit(0)), F.coalesce("write_id", F.lit("")))
    picked = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("r"))
    return picked.select(*keys, "r.*").select(records.columns)


def next_sequence(records: DataFrame | None) -> int:
    return 1 + ((records.agg(F.max("sequence")).first()[0] or 0) if records is not None else 0)


def append(rows: DataFrame, path: str, sequence: int, write_id: str, *, one_file: bool = True) -> None:
    """Add records in one file, or as the tasks of ``rows`` write them, for records too many for one task."""
    stamped = rows.withColumns({"sequence": F.lit(sequence).cast("long"), "write_id": F.lit(write_id)})
    (stamped.coalesce(1) if one_file else stamped).write.mode("append").parquet(path)


def new_write_id() -> str:
    return uuid.uuid4().hex


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, pattern: str) -> list[tuple[str, float]]:
    """(path, seconds since 1970 of the last change) of what matches a pattern of one level."""
    fs, at = _hadoop(spark, pattern)
    return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in fs.globStatus(at) or []]


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], rows: DataFrame | None = None) -> int:
    """Replace the files of a table by one with the records that count; how many files went.

    ``rows`` are the records to keep, if not the latest of each key. Files added meanwhile stay.
    """
    records = read_records(spark, path, schema)
    if records is None:
        return 0
    old = records.inputFiles()
    if len(old) < 2:
        return 0
    kept = rows if rows is not None else latest(records, keys)
    kept.coalesce(1).write.mode("append").parquet(path)
    for name in old:
        remove(spark, name)
    return len(old)
