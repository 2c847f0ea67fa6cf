"""The six stages as functions. They hand data over through tables, so a stage can be repeated."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_POOLING, EXPECTED_ROWS, POOLED_LOCATION, SAMPLES_PER_FRAME
from ..operators.embed import Embedder, embed_frames, embed_statistics
from ..operators.evaluation import evaluate
from ..operators.frames import (
    FRAME_KEYS,
    assemble_frames,
    check_counts,
    line_stats,
    normalise,
    repeated_lines,
    write_frames,
    zscore,
)
from ..operators.heads import HeadModel, make_head
from ..operators.integrity import folder_digest, manifest_summary, messages, verify_manifest
from ..operators.latency import head_latency
from ..operators.metrics import EvalResult
from ..operators.submission import ValidationReport, write_submission
from ..schemas import CACHE_KEYS, FRAME_SCHEMA, PREDICTION_SCHEMA
from ..session import materialise, refuse
from ..sources.file_listing import digest_files, list_files
from ..sources.matrix import read_text_predictions
from ..sources.raw_files import PLAIN_LAYOUT, read_raw, unexpected_files
from ..sources.runs import log_run
from ..sources.vector_cache import cached_slices, embeddings, write_cache


def verify_raw(spark: SparkSession, manifest: str, root: str) -> int:
    """Re-hash the listed files; any difference stops the pipeline."""
    statuses = materialise(verify_manifest(spark, manifest, root), "manifest-check")
    n = manifest_summary(statuses).first()["n"]
    refuse(messages(statuses), "manifest-differences", f"%d/{n} files diverged")
    return n


def window_features(
    spark: SparkSession,
    raw_root: str,
    out: str,
    *,
    scope: str = "train",
    n_samples: int = SAMPLES_PER_FRAME,
    layout: str = PLAIN_LAYOUT,
    check: bool = True,
) -> None:
    """Raw files to normalised frames, written per split and location.

    Lines are stored once, with the moments of their samples; statistics come from those, and frames are
    assembled, normalised and written in one job. Test frames are numbered over all locations.
    """
    raw = read_raw(spark, raw_root, layout, facts=True, pool_test=True)
    if check:
        refuse(unexpected_files(spark, raw_root, layout), "unexpected-files", "%d files are no raw files")
        check_counts(raw, n_samples)
    frames = assemble_frames(raw)
    if scope == "train":
        train = raw.where(F.col("split") == "train")
        if train.isEmpty():
            raise ValueError("normalisation is fitted on train frames, and there are none")
        frames = zscore(frames, line_stats(train))
    else:
        frames = normalise(frames, scope)
    write_frames(frames, out)


def pool_test_frames(frames: DataFrame) -> DataFrame:
    """Give test frames the pooled location under which the cache keeps them.

    The window stage numbers them over all locations. Frames from elsewhere may be numbered per location,
    and what :func:`repeated_lines` finds then has to be refused.
    """
    place = F.when(F.col("split") == "test", F.lit(POOLED_LOCATION)).otherwise(F.col("location"))
    return frames.withColumn("location", place)


def frozen_embeddings(
    spark: SparkSession,
    frames_root: str,
    *,
    fm: str,
    revision: str,
    load: Callable[[], Embedder] | None = None,
    root: str | None = None,
    refresh: bool = False,
) -> None:
    """Embed all frames with a frozen model and cache the vectors.

    Without ``load`` the built-in channel statistics are used. Slices already in the cache are
    left alone unless ``refresh``: the expensive step runs once per model revision.
    """
    frames = pool_test_frames(spark.read.schema(FRAME_SCHEMA).parquet(frames_root))
    if not refresh:
        # One row per cached slice. As a filter on partition columns it keeps the files of
        # finished slices from being opened, and no join is needed.
        done = (
            cached_slices(spark, root)
            .where((F.col("fm") == fm) & (F.col("revision") == revision))
            .select(F.concat_ws("/", "split", "location").alias("slice"))
            .collect()
        )
        here = F.concat_ws("/", "split", "location")
        frames = frames.where(~here.isin([r["slice"] for r in done]))
    refuse(
        repeated_lines(frames.where(F.col("split") == "test"), FRAME_KEYS),
        "repeated-test-frames",
        "%d test frames occur in several locations",
    )
    vectors = embed_statistics(frames) if load is None else embed_frames(frames, load)
    keyed = vectors.withColumns(
        {"fm": F.lit(fm), "revision": F.lit(revision), "pooling": F.lit(DEFAULT_POOLING)}
    )
    write_cache(
        keyed.select("frame_idx", "features", "y", "pooling", *CACHE_KEYS), root, rebalance=False
    )


def train_head(
    spark: SparkSession,
    fm: str,
    head: str = "logreg",
    *,
    revision: str | None = None,
    seed: int = 0,
    locations: Sequence[str] | None = None,
    experiment: str = "cli",
    root: str | None = None,
    store: str | None = None,
    out: str | None = None,
    tags: Mapping[str, Any] | None = None,
    **params: Any,
) -> tuple[HeadModel, EvalResult]:
    """Fit on train, score on validation, log the run, save the head.

    The latencies of a run are those of the head itself, timed per batch on the executors.
    """
    train = embeddings(spark, fm, "train", locations=locations, revision=revision, root=root)
    held = embeddings(
        spark, fm, "validation", locations=locations, revision=train.revision, root=root
    )
    started = time.perf_counter()
    model = make_head(head, seed=seed, **params).fit(train.df, fm=fm, revision=train.revision)
    fitted = time.perf_counter()
    result = evaluate(model, held)
    if store:
        latency = head_latency(model, held.df).first()
        metrics = {"macro_f1": result.macro_f1, "accuracy": result.accuracy}
        metrics |= {f"class_{c}_f1": v for c, v in result.per_class_f1.items()}
        metrics |= {
            "fit_seconds": fitted - started,
            "latency_ms_per_window": latency["mean_ms"],
            "latency_p50_ms": latency["p50_ms"],
            "latency_p95_ms": latency["p95_ms"],
        }
        log_run(
            spark,
            store,
            experiment,
            run_name=f"{fm}|{'all' if locations is None else f'{len(locations)}loc'}|{head}",
            params={"seed": seed, "fm": fm, "head": head, "revision": train.revision, **params},
            tags=tags,
            metrics=metrics,
        )
    if out:
        model.save(out)
    return model, result


def predict_test(
    spark: SparkSession,
    head_path: str,
    out: str,
    *,
    revision: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Apply a saved head to the test split of its own model revision, or of the given one."""
    model = HeadModel.load(spark, head_path)
    test = embeddings(
        spark, model.meta["fm"], "test", revision=revision or model.meta["revision"], root=root
    )
    model.predict(test.df).select("frame_idx", "y_pred").write.mode("overwrite").parquet(out)
    return spark.read.schema(PREDICTION_SCHEMA).parquet(out)


def format_submission(
    spark: SparkSession,
    predictions: str,
    out: str,
    expected_rows: int = EXPECTED_ROWS,
    *,
    text: bool = False,
    store: str | None = None,
    experiment: str = "cli",
    tags: Mapping[str, Any] | None = None,
) -> ValidationReport:
    """Turn saved frame predictions into the checked matrix; a faulty matrix is an error.

    Predictions are Parquet, or with ``text`` a text file of class ids with any number per line, which
    are numbered in reading order. With ``store`` a run is logged whose tag ``submission_sha256`` is
    the digest of the written matrix.
    """
    if text:
        table = read_text_predictions(spark, predictions)
    else:
        table = spark.read.schema(PREDICTION_SCHEMA).parquet(predictions)
    report = write_submission(table, out, expected_rows=expected_rows)
    if not report.ok:
        raise ValueError("; ".join(report.messages))
    if store:
        digest = folder_digest(digest_files(list_files(spark, out, "part-*"))).first()["digest"]
        logged = {"submission_sha256": digest} | dict(tags or {})
        log_run(spark, store, experiment, run_name="submission", params={"out": out}, tags=logged)
    return report
