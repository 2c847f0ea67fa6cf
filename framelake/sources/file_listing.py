"""Files below a folder and their SHA-256 digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import without_scheme
from ..session import materialise

CHUNK = 1 << 20
#: Bytes per hashing task, and what opening a file costs in bytes.
TASK_BYTES = 256 << 20
FILE_COST = 64 << 10


def list_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, rel, length) of regular files at any depth; contents are not read."""
    base = F.regexp_replace(without_scheme(F.lit(str(root))), "/+$", "")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(str(root))
    )
    local = without_scheme(F.col("path"))
    rel = local.substr(F.length(base) + 2, F.length(local))
    return files.select("path", rel.alias("rel"), "length")


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            # A plain local path keeps characters that a URI would have to escape.
            if path.startswith("file:"):
                fs, name = pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
            elif path.startswith("/"):
                fs, name = pafs.LocalFileSystem(), path
            else:
                fs, name = pafs.FileSystem.from_uri(path)
            state = hashlib.sha256()
            with fs.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("rel"), pa.array(digests, pa.string())], ["rel", "digest"]
        )


def packed(files: DataFrame, target: int | None = None) -> tuple[DataFrame, int]:
    """(path, rel, task) of (path, rel, length), longest files first, and the number of tasks.

    A task gets files of about ``target`` bytes, each counted with ``FILE_COST`` for opening it; a longer file
    is a task of its own. Files are sorted by ranges and numbered by running sums: those inside a
    range, and one sum per range for all before it.
    """
    sized = files.select("path", "rel", (F.col("length") + FILE_COST).alias("cost"))
    order = [F.desc("cost"), "path"]
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("place", F.monotonically_increasing_id()), "file-order")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sums = placed.groupBy("part").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return placed.select("path", "rel", F.lit(0).alias("task")), 1
    if target is None:
        # Smaller tasks while cores would be idle.
        target = min(TASK_BYTES, max(1, total["cost"] // files.sparkSession.sparkContext.defaultParallelism))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("earlier", F.coalesce(F.sum("cost").over(within), F.lit(0)))
    start = F.col("offset") + F.col("earlier")
    task = F.floor(start / F.lit(target)).cast("int").alias("task")
    return inside.join(offsets, "part").select("path", "rel", task), total["cost"] // target + 1


def digest_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(rel, digest) of (path, rel, length): every file streamed in 1 MiB pieces by the task that got its path.

    SHA-256 is sequential, so the unit of work is one file of any size in constant memory. Tasks get
    files by their bytes, see :func:`packed`, or are as many as given. Adaptive execution would merge
    paths, a few bytes each, into one task.
    """
    if tasks is None:
        dealt, many = packed(files)
        spread = dealt.repartitionById(many, "task").select("path", "rel")
    else:
        spread = files.select("path", "rel").repartition(tasks)
    return spread.mapInArrow(_hash_batches, "rel string, digest string")


def digest_text(rows: DataFrame, content: str) -> DataFrame:
    """Digest file contents that are already a column."""
    return rows.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).drop(content)
