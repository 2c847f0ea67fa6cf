"""Per-sample text matrices: one line per frame, class ids separated by single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import EXPECTED_COLS
from ..functions.numbers import parse_numbers
from ..functions.text import uncomment
from .raw_files import number_lines, store_lines


def parse_matrix(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``vals ARRAY<DOUBLE>``; comments and blank lines go, unreadable tokens are NULL."""
    text = lines.withColumn("line_text", uncomment(F.col(value))).where(F.col("line_text") != "")
    return text.withColumn("vals", parse_numbers(F.col("line_text"))).drop("line_text")


def frame_lines(predictions: DataFrame, n_cols: int = EXPECTED_COLS) -> DataFrame:
    """(frame_idx, value): every frame's class repeated over its samples."""
    label = F.col("y_pred").cast("bigint").cast("string")
    line = F.concat(F.repeat(F.concat(label, F.lit(" ")), n_cols - 1), label)
    return predictions.select("frame_idx", line.alias("value"))


def sample_rows(predictions: DataFrame, n_cols: int = EXPECTED_COLS) -> DataFrame:
    """(frame_idx, sample, y_pred): the matrix in long form."""
    cells = F.array_repeat(F.col("y_pred").cast("int"), n_cols)
    return predictions.select("frame_idx", F.posexplode(cells).alias("sample", "y_pred"))


def output_tasks(spark: SparkSession, n_rows: int, n_cols: int) -> int:
    """Number of part files: 128 MiB of text each, smaller ones while cores would be idle."""
    size = 2 * n_rows * n_cols
    return max(1, size >> 27, min(spark.sparkContext.defaultParallelism, size >> 23))


def write_matrix(
    predictions: DataFrame, out: str, n_cols: int = EXPECTED_COLS, n_rows: int | None = None
) -> None:
    """Write the matrix as text; part files in name order are in frame order.

    Frames are range-partitioned before the lines are built, so the shuffle moves two numbers
    per frame and not 500. The number of tasks follows the size of the text, which adaptive
    execution cannot see from those two numbers.
    """
    if n_rows is None:
        n_rows = predictions.count()
    tasks = output_tasks(predictions.sparkSession, n_rows, n_cols)
    ordered = (
        predictions.select("frame_idx", "y_pred")
        .repartitionByRange(tasks, "frame_idx")
        .sortWithinPartitions("frame_idx")
    )
    frame_lines(ordered, n_cols).select("value").write.mode("overwrite").text(out)


def read_matrix_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_text_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, y_pred): the numbers of a text file in reading order, counted from 0.

    Lines are numbered by their block as raw files are; the numbers before a line are those of earlier
    lines, added up per thousand lines and per million first, so that no task sorts all lines, nor
    one sum for each thousand of them.
    """
    lines = spark.read.text(path).select(
        F.lit("predictions").alias("name"),
        F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )
    kept = lines.where(uncomment(F.col("value")) != "")
    parsed = parse_matrix(number_lines(store_lines(kept, ("name",), "prediction-lines"), ("name",)))
    parsed = parsed.withColumns({"n": F.size("vals").cast("bigint"), "group": F.expr("frame_idx div 1000")})
    sums = parsed.groupBy("group").agg(F.sum("n").alias("n")).withColumn("far", F.expr("group div 1000"))

    def before(*by: str, order: str) -> Column:
        earlier = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(earlier), F.lit(0))

    far = sums.groupBy("far").agg(F.sum("n").alias("n")).select("far", before(order="far").alias("base"))
    starts = sums.withColumn("near", before("far", order="group")).join(far, "far")
    starts = starts.select("group", (F.col("base") + F.col("near")).alias("start"))
    placed = parsed.withColumn("first", before("group", order="frame_idx")).join(starts, "group")
    cells = placed.select((F.col("start") + F.col("first")).alias("at"), F.posexplode("vals").alias("pos", "v"))
    return cells.select((F.col("at") + F.col("pos")).alias("frame_idx"), F.col("v").alias("y_pred"))


def flatten_predictions(parsed: DataFrame) -> DataFrame:
    """(line, pos, y_pred) for prediction files with any number of values per line."""
    keep = [c for c in parsed.columns if c not in ("vals", "value")]
    exploded = parsed.select(*keep, F.posexplode("vals").alias("pos", "v"))
    return exploded.select(*keep, "pos", F.col("v").cast("int").alias("y_pred"))
