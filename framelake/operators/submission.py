"""Submission matrices: write and validate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    CLASSES,
    EXPECTED_COLS,
    EXPECTED_ROWS,
    NAN_ENTRIES,
    NON_INTEGER,
    STRAY_LABELS,
    WRONG_COLS,
    WRONG_ROWS,
)
from ..functions.text import as_label, is_whole, split_words, to_number, uncomment
from ..session import materialise, scratch_path
from ..sources.matrix import read_matrix_lines, write_matrix


def line_profiles(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines grouped by what matters to the checks, with the number of lines of each kind.

    A line usually repeats one class. Such a line equals its first token repeated, which one
    string comparison shows, and stands for ``copies`` tokens without being split. Other lines
    are split and reduced to their distinct tokens before numbers are parsed. Equal profiles
    merge before the shuffle: a valid matrix leaves one row per class.
    """
    line, head, copies = F.col("line"), F.col("head"), F.col("copies")
    cut = (
        lines.select(uncomment(F.col(value)).alias("line"))
        .where(line != "")
        .withColumn("head", F.substring_index(line, " ", 1))
        .withColumn("copies", ((F.length(line) + 1) / (F.length(head) + 1)).cast("int"))
    )
    repeated = F.concat(F.repeat(F.concat(head, F.lit(" ")), copies - 1), head)
    uniform = (line == repeated) & ~head.rlike(r"\s")
    cells = cut.select(
        F.when(uniform, copies).otherwise(1).alias("copies"),
        F.when(uniform, F.array(head)).otherwise(split_words(line)).alias("tokens"),
    )
    parsed = cells.withColumn("nums", F.transform(F.array_distinct("tokens"), to_number))

    def tally(test, present):
        found = F.size(F.filter("tokens", lambda t: test(to_number(t))))
        return F.when(F.exists("nums", present), found * copies).otherwise(0)

    profile = parsed.select(
        (F.size("tokens") * copies).alias("n_cols"),
        tally(F.isnan, lambda x: F.coalesce(F.isnan(x), F.lit(False))).alias("n_nans"),
        tally(F.isnull, F.isnull).alias("n_text"),
        F.exists("nums", lambda x: x.isNotNull() & ~is_whole(x)).alias("fractional"),
        F.array_sort(
            F.array_distinct(F.filter(F.transform("nums", as_label), lambda x: x.isNotNull()))
        ).alias("labels"),
    )
    return profile.groupBy("n_cols", "n_nans", "n_text", "fractional", "labels").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def label_table(profiles: DataFrame) -> DataFrame:
    """(label, n_lines): every label that occurs, as a distributed table."""
    # The outer form keeps the profiles unfiltered, so the report reuses their one shuffle.
    return (
        profiles.select(F.explode_outer("labels").alias("label"), "n_lines")
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("n_lines").alias("n_lines"))
    )


def stray_labels(profiles: DataFrame, allowed: Sequence[int] = CLASSES) -> DataFrame:
    return label_table(profiles).where(~F.col("label").isin(list(allowed)))


def validation_report(
    profiles: DataFrame,
    expected_rows: int = EXPECTED_ROWS,
    expected_cols: int = EXPECTED_COLS,
    allowed: Sequence[int] = CLASSES,
    count_stray: bool = True,
) -> DataFrame:
    """One row: shape, NaN count, labels and one message per kind of fault.

    ``unique_labels`` holds the allowed labels seen and ``n_stray`` the number of others, all of
    which :func:`stray_labels` lists. Without ``count_stray`` they are not counted, only whether there
    are any (``has_stray``).
    """
    none = F.lit(0).cast("bigint")
    facts = profiles.agg(
        F.coalesce(F.sum("n_lines"), none).alias("n_rows"),
        F.coalesce(F.min("n_cols"), F.lit(0)).alias("min_cols"),
        F.coalesce(F.max("n_cols"), F.lit(0)).alias("max_cols"),
        F.coalesce(F.sum(F.col("n_nans") * F.col("n_lines")), none).alias("n_nans"),
        F.coalesce(F.sum(F.col("n_text") * F.col("n_lines")), none).alias("n_text"),
        F.coalesce(F.bool_or("fractional"), F.lit(False)).alias("fractional"),
        F.coalesce(
            F.bool_or(F.exists("labels", lambda c: ~c.isin(list(allowed)))), F.lit(False)
        ).alias("has_stray"),
        F.filter(
            F.array(
                *[
                    F.when(F.bool_or(F.array_contains("labels", F.lit(c).cast("bigint"))), F.lit(c))
                    for c in sorted(allowed)
                ]
            ),
            lambda c: c.isNotNull(),
        ).alias("unique_labels"),
    )
    n_stray = stray_labels(profiles, allowed).agg(F.count(F.lit(1))).scalar() if count_stray else none
    facts = facts.withColumn("n_stray", n_stray)

    def note(condition, text, *args):
        return F.when(condition, F.format_string(text, *args))

    ragged = F.col("min_cols") != F.col("max_cols")
    low, high = (F.col(c).cast("string") for c in ("min_cols", "max_cols"))
    # NaN is no integer, nor are infinities: the profile marks both as fractional.
    messages = F.array(
        note(ragged, "ragged rows: %d to %d columns", "min_cols", "max_cols"),
        note(F.col("n_rows") != expected_rows, WRONG_ROWS, F.lit(expected_rows), "n_rows"),
        note(
            (F.col("min_cols") != expected_cols) | (F.col("max_cols") != expected_cols),
            WRONG_COLS,
            F.lit(expected_cols),
            F.when(ragged, F.concat_ws(" to ", low, high)).otherwise(high),
        ),
        note(F.col("n_nans") > 0, NAN_ENTRIES, "n_nans"),
        note(F.col("n_text") > 0, "%d entries are not numbers", "n_text"),
        note(F.col("fractional"), NON_INTEGER),
        note(F.col("n_stray") > 0, "%d labels outside allowed set", "n_stray"),
    )
    report = facts.withColumn("messages", F.filter(messages, lambda m: m.isNotNull()))
    return report.select(
        ((F.size("messages") == 0) & ~F.col("has_stray")).alias("ok"),
        "n_rows",
        F.when(ragged, -1).otherwise(F.col("max_cols")).alias("n_cols"),
        "n_nans",
        "n_text",
        "fractional",
        "unique_labels",
        "has_stray",
        "n_stray",
        "messages",
    )


#: Stray labels that a message lists, at most; the driver holds no more than these and the allowed ones.
LISTED = 1000


@dataclass(frozen=True)
class ValidationReport:
    ok: bool
    path: str
    n_rows: int
    n_cols: int
    dtype: str
    unique_labels: tuple[int, ...]
    n_nans: int
    messages: tuple[str, ...]
    checked: bool = True


def validate(
    spark: SparkSession,
    path: str,
    *,
    expected_rows: int = EXPECTED_ROWS,
    expected_cols: int = EXPECTED_COLS,
    allowed: Sequence[int] = CLASSES,
) -> ValidationReport:
    """Check a matrix file or folder; faults become messages and nothing is raised for them.

    One pass; a second one writes the table of labels if some are stray. The message lists the stray ones
    up to ``LISTED`` labels; beyond, as in a matrix of measured values, it has their number and the
    table that holds every one of them, and ``unique_labels`` has the allowed ones.
    """
    profiles = line_profiles(read_matrix_lines(spark, path))
    limits = (expected_rows, expected_cols, allowed)
    row = validation_report(profiles, *limits, count_stray=False).first()
    seen, messages = row["unique_labels"], list(row["messages"])
    if row["has_stray"]:
        where = scratch_path(spark, "labels")
        label_table(profiles).write.parquet(where)
        labels = spark.read.parquet(where)
        n_stray = labels.where(~F.col("label").isin(list(allowed))).count()
        if n_stray <= LISTED:
            seen = [r["label"] for r in labels.orderBy("label").collect()]
            shown = ", ".join(str(label) for label in seen if label not in set(allowed))
        else:
            shown = f"{n_stray} labels, all of them in {where}"
        messages.append(STRAY_LABELS % shown)
    return ValidationReport(
        ok=row["ok"],
        path=path,
        n_rows=row["n_rows"],
        n_cols=row["n_cols"],
        dtype="float64",
        unique_labels=tuple(seen),
        n_nans=row["n_nans"],
        messages=tuple(messages),
    )


def repeated_frames(predictions: DataFrame) -> DataFrame:
    """(frame_idx, n) of every frame with several predictions."""
    return predictions.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def write_submission(
    predictions: DataFrame,
    out: str,
    *,
    n_cols: int = EXPECTED_COLS,
    validate_after: bool = True,
    expected_rows: int = EXPECTED_ROWS,
    expected_cols: int = EXPECTED_COLS,
) -> ValidationReport:
    """Write (frame_idx, y_pred) as a matrix of ``n_cols`` samples per frame, then check it.

    Predictions must be one number per frame without a fraction, and each frame must occur once:
    a repeated frame would hide a missing one behind the right number of rows.
    """
    kind = predictions.schema["y_pred"].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"expected one number per frame in y_pred, got {kind.simpleString()}")
    # Checks, range sampling and the write all read these two columns: predict once.
    predictions = materialise(predictions.select("frame_idx", "y_pred"), "predictions")
    faults = F.count_if(F.col("y_pred").isNull() | F.col("frame_idx").isNull()).alias("empty")
    broken = F.lit(False)
    if not isinstance(kind, T.IntegralType):
        broken = ~is_whole(F.col("y_pred").cast("double"))
    facts = predictions.agg(
        faults, F.count_if(broken).alias("fractional"), F.count(F.lit(1)).alias("n")
    ).first()
    if facts["empty"] or facts["fractional"]:
        raise ValueError(
            f"predictions hold {facts['empty']} empty and {facts['fractional']} non-integer values"
        )
    repeated = repeated_frames(predictions).agg(F.count(F.lit(1)), F.min("frame_idx")).first()
    if repeated[0]:
        raise ValueError(f"{repeated[0]} frames have several predictions, the first is {repeated[1]}")
    write_matrix(predictions, out, n_cols, facts["n"])
    spark = predictions.sparkSession
    if validate_after:
        return validate(spark, out, expected_rows=expected_rows, expected_cols=expected_cols)
    return ValidationReport(
        ok=False,
        path=out,
        n_rows=facts["n"],
        n_cols=n_cols,
        dtype="int64",
        unique_labels=(),
        n_nans=0,
        messages=("unchecked",),
        checked=False,
    )
