"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while an intermediate table is written: a text or a set of shingles is some kB.
ARROW_ROWS = 1000
CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A lookup side is broadcast only when it is measured to stay below both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20

_local_scratch: dict[str, str] = {}


def build_session(app: str = "framelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC timestamps on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # A frame of nine channels is 18 kB: batches of this size stay below 20 MB.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names.

    Only a local session without the setting gets a folder of its own, since there every
    task runs on this machine. On a cluster a missing setting is an error: a folder on one
    machine would be lost with it, and the other machines could not read it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="framelake-", dir="/tmp")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/framelake/{name}-{uuid.uuid4().hex}"


class TableError(ValueError):
    """A check found faults; ``rows`` is the table of all of them and ``path`` where it was written."""

    def __init__(self, message: str, rows: DataFrame, path: str):
        super().__init__(f"{message}; all of them in {path}")
        self.rows, self.path = rows, path


def refuse(faults: DataFrame, name: str, message: str) -> None:
    """Raise :class:`TableError` if there are faults; every fault is written, the message has their number."""
    path = scratch_path(faults.sparkSession, name)
    faults.write.parquet(path)
    rows = faults.sparkSession.read.schema(faults.schema).parquet(path)
    n = rows.count()
    if n:
        raise TableError(message % n, rows, path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Plans run inside send at most ``rows`` rows at once to Python workers; wide rows fill the memory of both sides."""
    before = int(spark.conf.get(ARROW_CONF))
    if 0 < before <= rows:
        yield
        return
    spark.conf.set(ARROW_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_CONF, str(before))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan must not be evaluated twice (line numbers depend on the file splits)
    and where iterations would otherwise grow the lineage.
    """
    path = scratch_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, columns: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """The same, with the rows of each task filed by a hash of ``columns`` into ``buckets``.

    By default there are as many as shuffle partitions, or as tasks write if that is fewer.

    Writing moves no row to another task. A later join or group on these columns reads the table bucket by
    bucket, so only the other side is shuffled. The catalogue entry goes again, the files stay.
    """
    spark = df.sparkSession
    path, entry = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    many = buckets or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()))
    df.write.format("parquet").bucketBy(many, *columns).option("path", path).saveAsTable(entry)
    rows = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return rows


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup table with one aggregate; no limit, which would gather rows in one task."""
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b"),
    ).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str] | str,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    size: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a lookup table that is unique on ``on``.

    A table measured to stay within ``rows`` and ``size`` is broadcast, so hot keys of ``facts``
    need no shuffle. A larger one is joined by shuffle and adaptive execution splits the hot
    partitions of ``facts``.
    """
    return facts.join(F.broadcast(dim) if fits_broadcast(dim, rows, size) else dim, on, how)


def dealt(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of few bytes and much work, dealt evenly to all cores, or to ``tasks`` tasks if that is fewer.

    A scan makes its tasks by bytes and row groups, and adaptive execution merges partitions by bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores if tasks is None else max(1, min(tasks, cores)))


def persisted(df: DataFrame) -> DataFrame:
    """Keep a training set for repeated passes; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
