"""The run store: one row per run, metrics also as a long table.

Both are append-only logs. A run that is logged again under its id, as after a retry, is merged when it is
read: the last write counts, with its own metrics and no others. A run's row is written after its
metrics, so a writer that is killed in between leaves what was there before.
"""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EXPERIMENT_SCHEMA, RUN_METRIC_SCHEMA, RUN_SCHEMA
from . import commit_log


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    records = commit_log.read_records(spark, path, schema)
    return spark.createDataFrame([], T.StructType([*schema.fields, *commit_log.STAMP])) if records is None else records


def _merged_runs(spark: SparkSession, store: str) -> DataFrame:
    return commit_log.latest(_stored(spark, f"{store}/runs", RUN_SCHEMA), ["run_id"])


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """All runs, one row per id; an empty typed table when none was logged yet. Other errors are raised."""
    return _merged_runs(spark, store).select(RUN_SCHEMA.names)


def read_experiments(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/experiments", EXPERIMENT_SCHEMA)


def _merged_metrics(spark: SparkSession, store: str) -> DataFrame:
    rows = _stored(spark, f"{store}/run_metrics", RUN_METRIC_SCHEMA)
    counts = _merged_runs(spark, store).select(F.col("run_id").alias("winner_run"), F.col("write_id").alias("winner"))
    joined = rows.join(counts, F.col("run_id") == F.col("winner_run"), "left")
    kept = joined.where(F.col("write_id").isNull() | (F.col("write_id") == F.col("winner"))).select(rows.columns)
    # A compaction that is still under way shows rows of a write twice.
    written = kept.where("write_id IS NOT NULL").dropDuplicates()
    return kept.where("write_id IS NULL").unionByName(written)


def read_run_metrics(spark: SparkSession, store: str) -> DataFrame:
    """(run_id, metric, value, step) of the writes that count, and what was appended beside them."""
    return _merged_metrics(spark, store).select(RUN_METRIC_SCHEMA.names)


def compact_runs(spark: SparkSession, store: str) -> int:
    """One file each for runs and metrics, without what later writes replaced; how many files went.

    Metrics go first: until the runs follow, both old and new rows name the same writes.
    """
    gone = commit_log.compact(spark, f"{store}/run_metrics", RUN_METRIC_SCHEMA, [], _merged_metrics(spark, store))
    return gone + commit_log.compact(spark, f"{store}/runs", RUN_SCHEMA, ["run_id"])


def merge_tags(auto: Column, explicit: Column) -> Column:
    """Explicit tags win over automatic ones; tags without a value are dropped."""
    kept = F.map_filter(auto, lambda k, v: ~F.map_contains_key(explicit, k))
    return F.map_filter(F.map_concat(kept, explicit), lambda k, v: v.isNotNull())


def eval_metrics_long(scores: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """(keys, metric, value) from a score table with macro_f1, accuracy, per_class_f1."""
    named = F.map_concat(
        F.create_map(
            F.lit(f"{prefix}macro_f1"),
            F.col("macro_f1"),
            F.lit(f"{prefix}accuracy"),
            F.col("accuracy"),
        ),
        F.transform_keys(
            "per_class_f1",
            lambda k, v: F.concat(F.lit(f"{prefix}class_"), k.cast("string"), F.lit("_f1")),
        ),
    )
    return scores.select(*keys, F.explode(named).alias("metric", "value"))


def _metric_rows(metrics: DataFrame) -> DataFrame:
    step = F.col("step") if "step" in metrics.columns else F.lit(0)
    return metrics.select(
        F.col("run_id").cast("string").alias("run_id"),
        "metric",
        F.col("value").cast("double").alias("value"),
        step.cast("bigint").alias("step"),
    )


def append_metrics(metrics: DataFrame, store: str) -> None:
    """Append (run_id, metric, value[, step]) rows, beside what runs log themselves."""
    none = {"sequence": F.lit(None).cast("long"), "write_id": F.lit(None).cast("string")}
    _metric_rows(metrics).withColumns(none).write.mode("append").parquet(f"{store}/run_metrics")


def as_text(value: Any) -> str | None:
    """A tag or parameter as the store keeps it; booleans are ``true`` and ``false``."""
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def log_run(
    spark: SparkSession,
    store: str,
    experiment: str,
    *,
    run_name: str | None = None,
    params: Mapping[str, Any] | None = None,
    tags: Mapping[str, Any] | None = None,
    auto_tags: Mapping[str, Any] | None = None,
    metrics: Mapping[str, float] | None = None,
    series: Sequence[tuple[str, float, int]] = (),
    run_id: str | None = None,
    start_time: dt.datetime | None = None,
) -> str:
    """Log one finished run and return its id; the experiment name is its id as well.

    Under an id that was logged before, the run replaces the earlier one. ``metrics`` are values of step 0 and ``series`` (metric, value, step) of any step. The run row
    holds the value of each metric's last step.
    """
    run_id = run_id or uuid.uuid4().hex
    points = [(k, float(v), 0) for k, v in (metrics or {}).items()]
    points += [(k, float(v), int(step)) for k, v, step in series]
    last = {k: v for k, v, _ in sorted(points, key=lambda p: p[2])}
    row = (
        run_id,
        experiment,
        start_time or dt.datetime.now(dt.timezone.utc),
        {k: as_text(v) for k, v in (params or {}).items()},
        {k: as_text(v) for k, v in (auto_tags or {}).items()},
        {"run_name": run_name} | {k: as_text(v) for k, v in (tags or {}).items()},
        last,
    )
    tag_map = T.MapType(T.StringType(), T.StringType())
    fields = list(RUN_SCHEMA.fields)
    raw = T.StructType(
        fields[:4] + [T.StructField("auto", tag_map), T.StructField("given", tag_map)] + fields[5:]
    )
    merged = merge_tags(F.col("auto"), F.col("given")).alias("tags")
    run = spark.createDataFrame([row], raw).select(
        "run_id", "experiment_id", "start_time", "params", merged, "metrics"
    )
    known_runs = commit_log.read_records(spark, f"{store}/runs", RUN_SCHEMA)
    same = None if known_runs is None else known_runs.where(F.col("run_id") == run_id)
    sequence, write_id = commit_log.next_sequence(same), commit_log.new_write_id()
    if points:
        rows = spark.createDataFrame([(run_id, *p) for p in points], RUN_METRIC_SCHEMA)
        commit_log.append(_metric_rows(rows), f"{store}/run_metrics", sequence, write_id)
    commit_log.append(run, f"{store}/runs", sequence, write_id)
    # Two writers may both add an experiment: readers take one row per id.
    known = read_experiments(spark, store).where(F.col("experiment_id") == experiment)
    if known.isEmpty():
        spark.createDataFrame([(experiment, experiment)], EXPERIMENT_SCHEMA).write.mode(
            "append"
        ).parquet(f"{store}/experiments")
    return run_id


def result_points(result: Any, prefix: str = "", step: int = 0) -> list[tuple[str, float, int]]:
    """An evaluation as (metric, value, step): macro-F1, accuracy and the F1 of every class."""
    classes = {f"class_{c}_f1": v for c, v in result.per_class_f1.items()}
    named = {"macro_f1": result.macro_f1, "accuracy": result.accuracy} | classes
    return [(prefix + k, float(v), step) for k, v in named.items()]


@dataclass
class track:  # noqa: N801  used as a statement: with track(...) as run
    """A run that is written when its block ends, also after an error.

    The block adds to ``params``, ``tags`` and ``series``. A store that cannot be written is a warning:
    it must not cost the work of the block, nor hide the block's own error.
    """

    spark: SparkSession
    store: str
    experiment: str
    run_name: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    tags: dict[str, Any] = field(default_factory=dict)
    auto_tags: dict[str, Any] = field(default_factory=dict)
    seed: int | None = None
    series: list[tuple[str, float, int]] = field(default_factory=list)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: dt.datetime | None = None

    def log(self, result: Any = None, /, step: int = 0, prefix: str = "", **values: float) -> None:
        """Note an evaluation, single values, or both, at a step."""
        if result is not None:
            self.series += result_points(result, prefix, step)
        self.series += [(prefix + k, float(v), step) for k, v in values.items()]

    def __enter__(self) -> track:
        self.started = dt.datetime.now(dt.timezone.utc)
        return self

    def __exit__(self, *error: object) -> None:
        params = dict(self.params) if self.seed is None else {"seed": self.seed} | self.params
        try:
            log_run(
                self.spark, self.store, self.experiment, run_name=self.run_name, params=params, tags=self.tags,
                auto_tags=self.auto_tags, series=self.series, run_id=self.run_id, start_time=self.started,
            )
        except Exception as exc:
            warnings.warn(f"run {self.run_id} was not written to {self.store}: {exc}", stacklevel=2)
