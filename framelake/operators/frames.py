"""Frames: channels gathered into one row, shape checks, normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CHANNELS,
    EXPECTED_SHARDS,
    FRAMES_PER_FILE,
    FRAMES_PER_SPLIT,
    LABEL_CHANNEL,
    LABELLED_SPLITS,
    POOLED_LOCATION,
    SAMPLES_PER_FRAME,
)
from ..functions.samples import is_unreadable, moments, standardise, standardise_within
from ..functions.vectors import array_mode
from ..schemas import FRAME_SCHEMA
from ..session import refuse

FRAME_KEYS = ("split", "location", "frame_idx")
SHARD_KEYS = ("split", "location")


def assemble_frames(
    raw: DataFrame, channels: Sequence[str] = CHANNELS, keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """One row per frame with one array column per channel and its label ``y``.

    One shuffle on the frame key for all files together; a channel that lacks the frame is NULL.
    The label of a frame is the most frequent of its sample labels, the smallest on a tie.
    Lines that repeat a frame of a channel are what :func:`repeated_lines` lists.
    """
    # A map task rarely holds two channels of a frame: combining there would only sort the samples twice.
    wide = (
        raw.repartition(*[F.col(k) for k in keys])
        .groupBy(*keys)
        .pivot("channel", [*channels, LABEL_CHANNEL])
        .agg(F.any_value("samples", ignoreNulls=True))
    )
    label = array_mode(F.col(LABEL_CHANNEL)).cast("smallint")
    return wide.withColumn("y", label).drop(LABEL_CHANNEL)


def repeated_lines(raw: DataFrame, keys: Sequence[str] = (*FRAME_KEYS, "channel")) -> DataFrame:
    """(keys, n) of every key that occurs more than once; samples are not read."""
    return raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def write_frames(frames: DataFrame, root: str) -> None:
    """Write frames partitioned by split and location; large slices use many tasks."""
    typed = frames.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FRAME_SCHEMA])
    (
        typed.hint("rebalance", *[F.col(k) for k in SHARD_KEYS])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SHARD_KEYS)
        .parquet(root)
    )


def shape_table(raw: DataFrame, by: Sequence[str] = ("split", "location", "channel")) -> DataFrame:
    """(by, n_frames, min_len, max_len, n_unreadable) per raw file; stored facts of the lines are used."""
    stored = {"length", "unreadable"} <= set(raw.columns)
    length = F.col("length") if stored else F.coalesce(F.size("samples"), F.lit(0))
    unreadable = F.col("unreadable") if stored else is_unreadable(F.col("samples"))
    return raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        F.count_if(unreadable).alias("n_unreadable"),
    )


def frame_sanity(
    raw: DataFrame,
    n_samples: int = SAMPLES_PER_FRAME,
    channels: Sequence[str] = CHANNELS,
    frames_per_file: Mapping[str, int] | None = None,
    shards: Sequence[tuple[str, str]] | None = None,
    labelled: Sequence[str] = (),
    frames_per_split: Mapping[str, int] | None = None,
) -> DataFrame:
    """Violations only: (split, location, check, detail, found, expected).

    Checks per (split, location): every channel present, equally many frames in all channels,
    the published number of frames when given, every line of the right length and readable. In the
    ``labelled`` splits the label file is one of the channels. With ``shards``, each (split,
    location) of that list has to be there. ``frames_per_split`` are numbers of frames of all locations
    of a split together; a violation of one has the location ``all``.
    """
    label_file = (F.col("channel") == LABEL_CHANNEL) & F.col("split").isin(list(labelled))
    per_file = shape_table(raw.where(F.col("channel").isin(list(channels)) | label_file))
    # At most one entry per listed channel and shard is collected.
    found = per_file.groupBy(*SHARD_KEYS).agg(
        F.collect_list(
            F.struct("channel", "n_frames", "min_len", "max_len", "n_unreadable")
        ).alias("files"),
        F.max("n_frames").alias("most"),
    )
    wanted = F.col("most")
    if frames_per_file:
        table = F.create_map(*[F.lit(v) for kv in frames_per_file.items() for v in kv])
        wanted = F.coalesce(F.try_element_at(table, F.col("split")).cast("bigint"), wanted)

    def issue(check, detail, found, expected):
        return F.struct(
            F.lit(check).alias("check"),
            detail.alias("detail"),
            found.cast("bigint").alias("found"),
            expected.cast("bigint").alias("expected"),
        )

    names = F.array(*[F.lit(c) for c in channels])
    names = F.when(F.col("split").isin(list(labelled)), F.array_append(names, LABEL_CHANNEL)).otherwise(names)
    size = F.lit(n_samples)
    absent = F.transform(
        F.array_except(names, F.transform("files", lambda f: f["channel"])),
        lambda c: issue("channel missing", c, F.lit(0), F.lit(1)),
    )
    count = F.transform(
        F.filter("files", lambda f: f["n_frames"] != F.col("wanted")),
        lambda f: issue("frame count", f["channel"], f["n_frames"], F.col("wanted")),
    )
    short = F.transform(
        F.filter("files", lambda f: f["min_len"] != size),
        lambda f: issue("shortest line", f["channel"], f["min_len"], size),
    )
    long = F.transform(
        F.filter("files", lambda f: f["max_len"] > size),
        lambda f: issue("longest line", f["channel"], f["max_len"], size),
    )
    unreadable = F.transform(
        F.filter("files", lambda f: f["n_unreadable"] > 0),
        lambda f: issue("unreadable lines", f["channel"], f["n_unreadable"], F.lit(0)),
    )
    violations = found.withColumn("wanted", wanted).select(
        *SHARD_KEYS, F.inline(F.concat(absent, count, short, long, unreadable))
    )
    if frames_per_split:
        table = F.create_map(*[F.lit(v) for kv in frames_per_split.items() for v in kv])
        whole = found.groupBy("split").agg(F.sum("most").alias("n"))
        whole = whole.withColumn("wanted", F.try_element_at(table, F.col("split")).cast("bigint")).where("n <> wanted")
        v = issue("frame count", F.lit("all locations"), F.col("n"), F.col("wanted")).alias("v")
        violations = violations.unionByName(whole.select("split", F.lit(POOLED_LOCATION).alias("location"), v).select(*SHARD_KEYS, "v.*"))
    if not shards:
        return violations
    listed = [F.struct(F.lit(s).alias("split"), F.lit(p).alias("location")) for s, p in shards]
    wanted_shards = raw.sparkSession.range(1).select(F.inline(F.array(*listed)))
    lost = wanted_shards.join(found.select(*SHARD_KEYS), list(SHARD_KEYS), "left_anti")
    lost = lost.select(*SHARD_KEYS, issue("location missing", F.col("location"), F.lit(0), F.lit(1)).alias("v"))
    return violations.unionByName(lost.select(*SHARD_KEYS, "v.*"))


def incomplete_frames(
    frames: DataFrame, n_samples: int = SAMPLES_PER_FRAME, channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """(frame key, channel, n_samples) of every channel of a frame that is absent or too short."""
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"), F.coalesce(F.size(c), F.lit(0)).alias("n_samples")
            )
            for c in channels
        ]
    )
    return frames.select(*FRAME_KEYS, F.inline(parts)).where(F.col("n_samples") != n_samples)


def channel_stats(frames: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One row with the mean and population deviation of every channel, as struct columns.

    The samples of a frame become a count, a mean and a sum of squares around it in Arrow batches;
    only those travel on, one row per channel and number of samples from each task.
    """
    own = [F.struct(F.lit(c).alias("channel"), moments(F.col(c)).alias("m")) for c in channels]
    return _merged_moments(frames.select(F.inline(F.array(*own))).select("channel", "m.*"), channels)


def line_stats(raw: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """The same from raw lines whose moments were stored as they were read; no sample is read."""
    cells = raw.where(F.col("channel").isin(list(channels))).select("channel", "moments.*")
    return _merged_moments(cells, channels)


def _merged_moments(cells: DataFrame, channels: Sequence[str]) -> DataFrame:
    parts = cells.where("n > 0").groupBy("channel", "n").agg(
        (F.col("n") * F.count(F.lit(1))).cast("double").alias("w"),
        F.avg("mean").alias("mean"),
        F.var_pop("mean").alias("spread"),
        F.sum("squares").alias("squares"),
    )
    # One entry per number of samples that occurs.
    merged = parts.groupBy("channel").agg(F.collect_list(F.struct("w", "mean", "spread", "squares")).alias("parts"))

    def total(value):
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + value(p))

    merged = merged.withColumn("w", total(lambda p: p["w"]))
    merged = merged.withColumn("mean", total(lambda p: p["w"] * p["mean"]) / F.col("w"))
    gap = lambda p: p["spread"] + (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))
    merged = merged.withColumn("std", F.sqrt(total(lambda p: p["squares"] + p["w"] * gap(p)) / F.col("w")))
    none = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
    found = F.struct("mean", "std")
    return merged.agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, found)), none).alias(c) for c in channels])


def channel_stats_long(stats: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                F.col(f"{c}.mean").alias("mean"),
                F.col(f"{c}.std").alias("std"),
            )
            for c in channels
        ]
    )
    return stats.select(F.inline(rows))


def zscore(frames: DataFrame, stats: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Normalise every channel with the statistics of another table (usually the train split).

    The single statistics row enters the plan as a scalar subquery, so no join is needed.
    """
    packed = stats.select(F.struct(*channels)).scalar()
    ready = frames.withColumn("stats", packed)
    return ready.withColumns(
        {
            c: standardise(F.col(c), F.col(f"stats.{c}.mean"), F.col(f"stats.{c}.std"))
            for c in channels
        }
    ).drop("stats")


def normalise(
    frames: DataFrame, scope: str = "train", channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """Per-channel z-score, fitted on the train split or inside every frame (``scope="frame"``)."""
    if scope == "frame":
        return frames.withColumns({c: standardise_within(F.col(c)) for c in channels})
    if scope != "train":
        raise ValueError(f"unknown scope {scope!r}; expected 'train' or 'frame'")
    return zscore(frames, channel_stats(frames.where(F.col("split") == "train"), channels), channels)


def check_counts(raw: DataFrame, n_samples: int = SAMPLES_PER_FRAME) -> None:
    """Stop with the table of all violations when raw files do not have the published shape.

    The published number of test frames is that of all test locations together.
    """
    found = frame_sanity(
        raw, n_samples, frames_per_file=FRAMES_PER_FILE, shards=EXPECTED_SHARDS, labelled=LABELLED_SPLITS,
        frames_per_split=FRAMES_PER_SPLIT,
    )
    refuse(found, "shape-violations", "%d violations of the published shape")
