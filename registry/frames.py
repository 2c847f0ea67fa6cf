"""Queries over raw channels and frames."""

from __future__ import annotations

import numpy as np
from framelake.constants import CHANNELS
from framelake.operators.embed import embed_frames, embed_statistics
from framelake.operators.frames import (
    assemble_frames,
    channel_stats,
    channel_stats_long,
    frame_sanity,
    incomplete_frames,
    normalise,
    repeated_lines,
    shape_table,
)
from framelake.plans import jobs
from framelake.schemas import FRAME_SCHEMA
from framelake.sources.raw_files import PARTITIONED_LAYOUT, read_raw, unexpected_files
from pyspark.sql import functions as F

from .views import EMB, RAW, READINGS, SAMPLES, once, raw_channels, readings, table, with_cte


def _long(frames, digits=None):
    """(frame key, pos, one column per channel) so that every sample is compared."""
    filled = [F.coalesce(c, F.array().cast(frames.schema[c].dataType)) for c in CHANNELS]
    zipped = F.posexplode(F.arrays_zip(*filled)).alias("pos", "s")
    rows = frames.select("split", "location", "frame_idx", zipped)

    def cell(i):
        value = F.col(f"s.{i}").cast("double")
        return value if digits is None else F.round(value, digits)

    return rows.select(
        "split", "location", "frame_idx", "pos", *[cell(i).alias(c) for i, c in enumerate(CHANNELS)]
    )


def frames_assemble(spark, sf):
    return _long(assemble_frames(raw_channels(spark, sf)))


def frame_labels(spark, sf):
    frames = assemble_frames(raw_channels(spark, sf))
    return frames.select("split", "location", "frame_idx", F.col("y").cast("int").alias("y"))


def _raw_folder(spark, sf):
    def write(path):
        lines = raw_channels(spark, sf).select(
            "split", "location", "channel", "frame_idx",
            F.array_join(F.col("samples").cast("array<string>"), " ").alias("value"),
        )
        keys = ["split", "location", "channel"]
        ordered = lines.repartitionByRange(*keys, "frame_idx").sortWithinPartitions(*keys, "frame_idx")
        ordered.select("value", *keys).write.partitionBy(*keys).text(path)

    return once(spark, sf, "raw", write)


def frames_from_files(spark, sf):
    """Channel files written as text, read back, lines numbered; every sample."""
    raw = read_raw(spark, _raw_folder(spark, sf), PARTITIONED_LAYOUT)
    cells = raw.where(F.col("channel") != "Label").select(
        "split", "location", "channel", "frame_idx", F.posexplode("samples").alias("pos", "value")
    )
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


def test_frame_numbers(spark, sf):
    """Every line of the test files under the number it has over all test locations."""
    raw = read_raw(spark, _raw_folder(spark, sf), PARTITIONED_LAYOUT, pool_test=True).where("split = 'test'")
    first = F.round(F.col("samples")[0].cast("double"), 6).alias("first")
    return raw.select("location", "channel", "frame_idx", F.size("samples").alias("n_samples"), first)


def frame_shards(spark, sf):
    """Channel files windowed, normalised on train and written as frame shards; every sample read back."""
    raw = _raw_folder(spark, sf)

    def write(path):
        jobs.window_features(spark, raw, path, n_samples=SAMPLES, layout=PARTITIONED_LAYOUT, check=False)

    frames = spark.read.schema(FRAME_SCHEMA).parquet(once(spark, sf, "frame-shards", write))
    return _long(frames, 4)


def q_channel_stats(spark, sf):
    frames = assemble_frames(raw_channels(spark, sf)).where("split = 'train'")
    stats = channel_stats_long(channel_stats(frames))
    return stats.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def channel_zscore(spark, sf):
    return _long(normalise(assemble_frames(raw_channels(spark, sf))), 6)


def frame_zscore(spark, sf):
    return _long(normalise(assemble_frames(raw_channels(spark, sf)), "frame"), 5)


def file_shapes(spark, sf):
    return shape_table(readings(spark, sf))


def q_frame_sanity(spark, sf):
    """Lines of two samples instead of three, uneven channels, two channels that never occur."""
    return frame_sanity(readings(spark, sf), n_samples=3)


def q_incomplete_frames(spark, sf):
    return incomplete_frames(assemble_frames(raw_channels(spark, sf)), SAMPLES)


def embed_stats(spark, sf):
    vectors = embed_statistics(assemble_frames(raw_channels(spark, sf)))
    cells = vectors.select("split", "location", "frame_idx", F.posexplode("features").alias("dim", "value"))
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 4))


def _load_patch_model():
    """A stand-in for a frozen model: mean and largest value of each patch, two patches."""

    def embed(block: np.ndarray) -> np.ndarray:
        half = block.shape[2] // 2
        patches = [block[:, :, :half], block[:, :, half : 2 * half]]
        parts = [np.concatenate([p.mean(axis=2), p.max(axis=2)], axis=1) for p in patches]
        return np.stack(parts, axis=1)

    return embed


def embed_udf(spark, sf):
    frames = assemble_frames(raw_channels(spark, sf)).drop("y")
    vectors = embed_frames(frames, _load_patch_model, n_samples=SAMPLES)
    cells = vectors.select("split", "location", "frame_idx", F.posexplode("features").alias("dim", "value"))
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 4))


def frame_repeats(spark, sf):
    """Lines that give a frame of a channel once more."""
    return repeated_lines(readings(spark, sf))


def raw_unexpected_files(spark, sf):
    """Notes per source beside the channel files, and files of unknown splits, places and channels."""

    def write(path):
        docs = table(spark, sf, "documents").select(F.col("source").alias("place"), F.col("n_chars").cast("string").alias("value"))
        odd = ["train/Bag/Acc_x.txt", "train/Bag/Temp.txt", "train/Moon/Acc_x.txt", "sunday/Bag/Acc_x.txt"]
        few = docs.where("place = 'src0'").withColumn("place", F.explode(F.array(*[F.lit(o) for o in odd])))
        counted = docs.unionByName(few).groupBy("place").agg(F.count("value").cast("string").alias("value"))
        # One line, so one file, per place.
        counted = counted.repartition("place").select("value", "place")
        for name in odd:
            counted.where(F.col("place") == name).coalesce(1).select("value").write.text(f"{path}/{name}")
        counted.where(~F.col("place").isin(odd)).write.mode("append").partitionBy("place").text(path)

    found = unexpected_files(spark, once(spark, sf, "odd-raw", write))
    folder = F.regexp_replace(F.substring_index("rel", "/", 1), "^place=", "")
    return found.groupBy(folder.alias("folder"), "fault").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "frame_repeats": frame_repeats,
    "raw_unexpected_files": raw_unexpected_files,
    "frames_assemble": frames_assemble,
    "frame_labels": frame_labels,
    "frames_from_files": frames_from_files,
    "test_frame_numbers": test_frame_numbers,
    "frame_shards": frame_shards,
    "channel_stats": q_channel_stats,
    "channel_zscore": channel_zscore,
    "frame_zscore": frame_zscore,
    "file_shapes": file_shapes,
    "frame_sanity": q_frame_sanity,
    "incomplete_frames": q_incomplete_frames,
    "embed_stats": embed_stats,
    "embed_udf": embed_udf,
}


def _pivot_sql(source: str, digits: int | None = None) -> str:
    cell = "v" if digits is None else f"round(v, {digits})"
    cols = ",\n       ".join(f"max({cell}) FILTER (channel = '{c}') AS {c}" for c in CHANNELS)
    return f"SELECT split, location, frame_idx, pos,\n       {cols}\nFROM {source} GROUP BY ALL"


def _stats_sql(source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT split, location, frame_idx, {4 * i + j} AS dim, "
        f"coalesce(max(CASE WHEN channel = '{c}' THEN {v} END), 0) AS value FROM {source} GROUP BY ALL"
        for i, c in enumerate(CHANNELS)
        for j, v in enumerate(("mean", "std", "low", "high"))
    )
    return rows


PER_CHANNEL = """per_channel AS (
  SELECT split, location, frame_idx, channel, avg(v) AS mean, stddev_pop(v) AS std,
         min(v) AS low, max(v) AS high,
         avg(v) FILTER (pos < 4) AS mean0, avg(v) FILTER (pos BETWEEN 4 AND 7) AS mean1,
         max(v) FILTER (pos < 4) AS max0, max(v) FILTER (pos BETWEEN 4 AND 7) AS max1
  FROM raw_long GROUP BY ALL)"""


def _patch_sql() -> str:
    rows = []
    for i, c in enumerate(CHANNELS):
        for j, v in ((0, "(mean0 + mean1) / 2"), (1, "(max0 + max1) / 2")):
            rows.append(
                f"SELECT split, location, frame_idx, {9 * j + i} AS dim, "
                f"coalesce(max(CASE WHEN channel = '{c}' THEN {v} END), 0) AS value "
                "FROM per_channel GROUP BY ALL"
            )
    return " UNION ALL ".join(rows)


#: Lines under the numbers that files give them: a channel without a frame moves up, and the locations
#: of the test split follow each other, each as long as its longest channel.
NUMBERED = """ranked AS (
  SELECT split, location, channel, pos, v,
         dense_rank() OVER (PARTITION BY split, location, channel ORDER BY frame_idx) - 1 AS n FROM raw_long),
places AS (
  SELECT split, location, CASE WHEN split = 'test' THEN coalesce(sum(longest) OVER (
           PARTITION BY split ORDER BY list_position(['Bag', 'Hips', 'Torso', 'Hand'], location)
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS start
  FROM (SELECT split, location, max(n) + 1 AS longest FROM ranked GROUP BY ALL)),
numbered AS (
  SELECT split, location, channel, CAST(n + start AS BIGINT) AS frame_idx, pos, v FROM ranked JOIN places USING (split, location))"""

ORACLES = {
    "test_frame_numbers": with_cte(RAW, NUMBERED, select="""
SELECT location, channel, frame_idx, CAST(count(*) AS INTEGER) AS n_samples, round(max(v) FILTER (pos = 0), 6) AS first
FROM numbered WHERE split = 'test' GROUP BY ALL"""),
    "frame_shards": with_cte(RAW, NUMBERED, """stats AS (
  SELECT channel, avg(v) AS m, stddev_pop(v) AS s FROM numbered WHERE split = 'train' GROUP BY channel),
scaled AS (
  SELECT split, location, frame_idx, pos, channel,
         CAST(CAST(CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS FLOAT) AS DOUBLE) AS v
  FROM numbered JOIN stats USING (channel))""", select=_pivot_sql("scaled", 4)),
    "frames_assemble": with_cte(RAW, select=_pivot_sql("raw_long")),
    "frame_labels": with_cte(EMB, select="SELECT split, location, frame_idx, y FROM emb"),
    "frames_from_files": with_cte(RAW, select="""
SELECT split, location, channel,
       dense_rank() OVER (PARTITION BY split, location, channel ORDER BY frame_idx) - 1 AS frame_idx,
       pos, round(v, 6) AS value FROM raw_long"""),
    "frame_repeats": with_cte(READINGS, select="""
SELECT split, location, channel, frame_idx, count(*) AS n FROM readings GROUP BY ALL HAVING count(*) > 1"""),
    "raw_unexpected_files": """
SELECT source AS folder, 'layout' AS fault, CAST(1 AS BIGINT) AS n FROM documents GROUP BY source
UNION ALL SELECT 'train', 'channel', CAST(1 AS BIGINT) FROM documents GROUP BY 1
UNION ALL SELECT 'train', 'location', CAST(1 AS BIGINT) FROM documents GROUP BY 1
UNION ALL SELECT 'sunday', 'split', CAST(1 AS BIGINT) FROM documents GROUP BY 1""",
    "channel_stats": with_cte(RAW, select="""
SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM raw_long
WHERE split = 'train' GROUP BY channel"""),
    "channel_zscore": with_cte(RAW, """stats AS (
  SELECT channel, avg(v) AS m, stddev_pop(v) AS s FROM raw_long WHERE split = 'train' GROUP BY channel),
scaled AS (
  SELECT split, location, frame_idx, pos, channel, CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS v
  FROM raw_long JOIN stats USING (channel))""", select=_pivot_sql("scaled", 6)),
    "frame_zscore": with_cte(RAW, """stats AS (
  SELECT split, location, frame_idx, channel, avg(v) AS m, stddev_pop(v) AS s FROM raw_long GROUP BY ALL),
scaled AS (
  SELECT split, location, frame_idx, pos, channel, CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS v
  FROM raw_long JOIN stats USING (split, location, frame_idx, channel))""", select=_pivot_sql("scaled", 5)),
    "file_shapes": with_cte(READINGS, select="""
SELECT split, location, channel, count(*) AS n_frames, CAST(min(len) AS INTEGER) AS min_len,
       CAST(max(len) AS INTEGER) AS max_len, CAST(0 AS BIGINT) AS n_unreadable
FROM readings GROUP BY ALL"""),
    "frame_sanity": with_cte(READINGS, """shapes AS (
  SELECT split, location, channel, count(*) AS n, min(len) AS lo, max(len) AS hi
  FROM readings GROUP BY ALL),
most AS (SELECT split, location, max(n) AS most FROM shapes GROUP BY ALL)""", select="""
SELECT split, location, 'channel missing' AS "check", c AS detail, CAST(0 AS BIGINT) AS found, CAST(1 AS BIGINT) AS expected
FROM most, (VALUES ('Acc_x'),('Acc_y'),('Acc_z'),('Gyr_x'),('Gyr_y'),('Gyr_z'),('Magn_x'),('Magn_y'),('Magn_z')) AS a(c)
WHERE NOT EXISTS (SELECT 1 FROM shapes s WHERE s.split = most.split AND s.location = most.location AND s.channel = c)
UNION ALL SELECT split, location, 'frame count', channel, n, most FROM shapes JOIN most USING (split, location) WHERE n <> most
UNION ALL SELECT split, location, 'shortest line', channel, lo, 3 FROM shapes WHERE lo <> 3
UNION ALL SELECT split, location, 'longest line', channel, hi, 3 FROM shapes WHERE hi > 3"""),
    "incomplete_frames": with_cte(EMB, select="""
SELECT split, location, frame_idx, 'Gyr_z' AS channel, CAST(0 AS INTEGER) AS n_samples
FROM emb WHERE frame_idx % 50 = 3"""),
    "embed_stats": with_cte(RAW, PER_CHANNEL, f"cells AS ({_stats_sql('per_channel')})", select="""
SELECT split, location, frame_idx, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM cells"""),
    "embed_udf": with_cte(RAW, PER_CHANNEL, f"cells AS ({_patch_sql()})", select="""
SELECT split, location, frame_idx, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM cells"""),
}
