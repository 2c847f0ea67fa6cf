"""Raw channel files: one text line per frame, samples separated by white space.

A frame is identified by its line number within (split, location, channel), and Spark rows have
no order, so the numbers are rebuilt: the lines are read once with their file, block start and
an increasing id, and written to the shared folder in buckets of their block; the table of line
counts per block gives each block its first number and meets the lines bucket by bucket. Lines never
leave the task that read them, the table of blocks may grow as it likes, and no step gathers a whole file.

Test frames are one sequence over all locations, whatever place a frame was recorded in: a location
starts where the one before it, in the fixed order, has ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CHANNELS, LABEL_CHANNEL, SPLITS, TRAIN_LOCATIONS
from ..functions.samples import line_facts
from ..functions.text import split_words, uncomment, without_scheme
from ..session import materialise_bucketed
from .file_listing import list_files

#: Below the root: ``<split>/<location>/<channel>.txt``, one file or a folder of ordered part files.
PLAIN_LAYOUT = r"^([^/]+)/([^/]+)/([^/]+)\.txt(?:/[^/]+)?$"
#: The same as partition folders, the way Spark itself writes text.
PARTITIONED_LAYOUT = r"^split=([^/]+)/location=([^/]+)/channel=([^/]+)/[^/]+$"

KEYS = ("split", "location", "channel")

BLOCK = ("file", "block")


def store_lines(lines: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Write lines with (file, block, line_id) once, ready for :func:`number_lines`: ids depend on the file splits."""
    return materialise_bucketed(lines, [*keys, *BLOCK], name)


def _first_numbers(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, file, block, first_id, n, before): blocks, and how many lines of the keys come before each."""
    counts = lines.groupBy(*keys, *BLOCK).agg(F.min("line_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*keys).orderBy(*BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _numbered(lines: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    shift = blocks.select(*keys, *BLOCK, (F.col("before") - F.col("first_id")).alias("shift"))
    joined = lines.join(shift.hint("shuffle_hash"), [*keys, *BLOCK])
    return joined.withColumn("frame_idx", F.col("line_id") + F.col("shift")).drop("line_id", "shift", *BLOCK)


def number_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace (file, block, line_id) by ``frame_idx``, counted per ``keys`` from 0.

    ``line_id`` rises by one per kept line inside a block, so a line's number is its distance
    from the first id of the block plus the number of lines in all earlier blocks. Only the
    table of blocks is shuffled and sorted, if the lines come from :func:`store_lines`.
    """
    return _numbered(lines, _first_numbers(lines, keys), keys)


def location_starts(sizes: DataFrame) -> DataFrame:
    """(split, location, start): the number of a location's first frame, from (split, location, channel, n).

    In the test split the longest channel of a location says how many numbers it takes; elsewhere
    every location counts from 0. At most one row per split and location.
    """
    longest = sizes.groupBy("split", "location").agg(F.max("n").alias("n"))
    rank = F.array_position(F.array(*[F.lit(p) for p in TRAIN_LOCATIONS]), F.col("location"))
    earlier = W.partitionBy("split").orderBy(rank, "location").rowsBetween(W.unboundedPreceding, -1)
    start = F.when(F.col("split") == "test", F.coalesce(F.sum("n").over(earlier), F.lit(0))).otherwise(F.lit(0))
    return longest.select("split", "location", start.alias("start"))


def _keys(rel: Column, layout: str) -> list[Column]:
    return [F.regexp_extract(rel, layout, i + 1).alias(k) for i, k in enumerate(KEYS)]


def _fault() -> Column:
    """Why the keys of a path are not those of a raw file; NULL if they are."""
    return (
        F.when(F.col("channel") == "", "layout")
        .when(~F.col("split").isin(list(SPLITS)), "split")
        .when(~F.col("location").isin(list(TRAIN_LOCATIONS)), "location")
        .when(~F.col("channel").isin([*CHANNELS, LABEL_CHANNEL]), "channel")
    )


def unexpected_files(spark: SparkSession, root: str, layout: str = PLAIN_LAYOUT) -> DataFrame:
    """(rel, fault): text files below ``root`` that are no raw files, and which part of the path says so."""
    files = list_files(spark, root).select("rel", *_keys(F.col("rel"), layout))
    return files.select("rel", _fault().alias("fault")).where(F.col("fault").isNotNull())


def read_lines(spark: SparkSession, root: str, layout: str = PLAIN_LAYOUT) -> DataFrame:
    """Non-blank lines of the raw files below ``root`` with their keys and position.

    Other files, see :func:`unexpected_files`, are left out.
    """
    # Paths in file metadata are escaped as in a URL.
    path = without_scheme(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    base = F.regexp_replace(without_scheme(F.lit(str(root))), "/+$", "")
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .text(root)
        .select(
            uncomment(F.col("value")).alias("line"),
            path.substr(F.length(base) + 2, F.length(path)).alias("rel"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .where(F.col("line") != "")
    )
    keyed = text.select(
        *_keys(F.col("rel"), layout),
        F.regexp_extract("rel", r"[^/]+$", 0).alias("file"),
        "block",
        F.monotonically_increasing_id().alias("line_id"),
        split_words(F.col("line")).try_cast("array<float>").alias("samples"),
    )
    return keyed.where(_fault().isNull())


def read_raw(
    spark: SparkSession, root: str, layout: str = PLAIN_LAYOUT, *, facts: bool = False, pool_test: bool = False
) -> DataFrame:
    """(split, location, channel, frame_idx, samples ARRAY<FLOAT>) for every raw file.

    With ``pool_test`` the frames of all test locations are numbered as one sequence. With ``facts`` the
    columns of :func:`~framelake.functions.samples.line_facts` are stored with the lines, so that shape
    checks and statistics need not read the samples again.
    """
    lines = read_lines(spark, root, layout)
    if facts:
        lines = lines.withColumns(line_facts(F.col("samples")))
    lines = store_lines(lines, KEYS, "raw-lines")
    blocks = _first_numbers(lines, KEYS)
    if pool_test:
        starts = location_starts(blocks.groupBy(*KEYS).agg(F.sum("n").alias("n")))
        blocks = blocks.join(F.broadcast(starts), ["split", "location"])
        blocks = blocks.withColumn("before", F.col("before") + F.col("start"))
    return _numbered(lines, blocks, KEYS)
