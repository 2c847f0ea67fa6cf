"""Macro-F1 and its breakdowns.

Everything starts from one two-phase count of (truth, prediction) pairs. Values outside the
label list are folded into NULL first, so a group never has more than (K + 1)^2 pairs however
many rows it has, and all later steps work on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_NAMES, CLASSES, HEADLINE


def _listed(value: str, labels: Sequence[int]) -> Column:
    return F.when(F.col(value).isin(list(labels)), F.col(value).cast("int"))


def _label_array(labels: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(c)) for c in labels])


def pair_counts(
    pairs: DataFrame, labels: Sequence[int] = CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """(by, y_true, y_pred, n, n_hit, n_unlabelled); the only pass over the rows."""
    marked = pairs.select(
        *by,
        _listed("y_true", labels).alias("t"),
        _listed("y_pred", labels).alias("p"),
        (F.col("y_true") == F.col("y_pred")).alias("hit"),
        F.col("y_true").isNull().alias("unlabelled"),
    )
    return (
        marked.groupBy(*by, "t", "p")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("hit").alias("n_hit"),
            F.count_if("unlabelled").alias("n_unlabelled"),
        )
        .withColumnsRenamed({"t": "y_true", "p": "y_pred"})
    )


def _contributions(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Split every pair count into what it adds to the total, the truth and the predicted class."""
    zero = F.lit(0).cast("bigint")
    hit = F.col("y_true") == F.col("y_pred")

    def part(is_total: bool, label: Column, **values: Column) -> Column:
        names = ("n", "n_hit", "n_unlabelled", "tp", "seen")
        return F.struct(
            F.lit(is_total).alias("is_total"),
            label.alias("class"),
            *[values.get(v, zero).alias(v) for v in names],
        )

    parts = F.array(
        part(
            True,
            F.lit(None).cast("int"),
            n=F.col("n"),
            n_hit=F.col("n_hit"),
            n_unlabelled=F.col("n_unlabelled"),
        ),
        part(
            False,
            F.col("y_true"),
            tp=F.when(hit, F.col("n")).otherwise(zero),
            seen=F.col("n"),
        ),
        part(False, F.col("y_pred"), seen=F.col("n")),
    )
    split = counts.select(*by, F.inline(parts))
    return split.where(F.col("is_total") | F.col("class").isNotNull())


def score_counts(
    counts: DataFrame, labels: Sequence[int] = CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """(by, macro_f1, accuracy, n, n_unlabelled, per_class_f1) from a table of pair counts.

    F1 = 2tp / (2tp + fp + fn), whose denominator is the number of times the class was seen as
    truth or prediction; 0 when never seen. The macro mean runs over all listed classes.
    """
    per_label = (
        _contributions(counts, by)
        .groupBy(*by, "is_total", "class")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_hit", "n_unlabelled", "tp", "seen")])
    )
    f1 = F.try_divide(F.lit(2.0) * F.col("tp"), F.col("seen"))
    # At most one entry per listed class reaches the map.
    entry = F.when(~F.col("is_total"), F.struct("class", f1.alias("f1")))
    grouped = per_label.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(F.sum("n_hit"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.sum("n_unlabelled"), F.lit(0).cast("bigint")).alias("n_unlabelled"),
        F.map_from_entries(F.collect_list(entry)).alias("found"),
    )
    dense = F.transform(
        _label_array(labels),
        lambda c: F.struct(
            c.alias("class"), F.coalesce(F.try_element_at("found", c), F.lit(0.0)).alias("f1")
        ),
    )
    total = F.aggregate("dense", F.lit(0.0), lambda acc, e: acc + e["f1"])
    return grouped.withColumn("dense", dense).select(
        *by,
        (total / F.lit(float(len(labels)))).alias("macro_f1"),
        F.try_divide("n_hit", "n").alias("accuracy"),
        "n",
        "n_unlabelled",
        F.map_from_entries("dense").alias("per_class_f1"),
    )


def score(
    pairs: DataFrame, labels: Sequence[int] = CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """Score rows of (y_true, y_pred), for the whole table or per group of ``by``."""
    return score_counts(pair_counts(pairs, labels, by), labels, by)


def score_grouping_sets(
    pairs: DataFrame, sets: Sequence[Sequence[str]], labels: Sequence[int] = CLASSES
) -> DataFrame:
    """Scores per grouping set, e.g. per user, per location and overall.

    The rows are counted once at the finest grain; the sets are rolled up from those counts.
    ``grouping`` names the set, and columns outside it are NULL.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    finest = pair_counts(pairs, labels, columns)
    picks = [
        F.struct(
            F.lit("+".join(s) or "all").alias("grouping"),
            *[
                (F.col(c) if c in s else F.lit(None).cast(pairs.schema[c].dataType)).alias(c)
                for c in columns
            ],
        )
        for s in sets
    ]
    rolled = (
        finest.select("y_true", "y_pred", "n", "n_hit", "n_unlabelled", F.inline(F.array(*picks)))
        .groupBy("grouping", *columns, "y_true", "y_pred")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_hit").alias("n_hit"),
            F.sum("n_unlabelled").alias("n_unlabelled"),
        )
    )
    return score_counts(rolled, labels, ["grouping", *columns])


def per_class(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, f1): one row per listed class."""
    return scores.select(*by, F.explode("per_class_f1").alias("class", "f1"))


def confusion(pairs: DataFrame, labels: Sequence[int] = CLASSES) -> DataFrame:
    """Dense K x K table (y_true, y_pred, n); pairs with a side outside the list are left out."""
    counts = pair_counts(pairs, labels).dropna(subset=["y_true", "y_pred"])
    cell = F.struct("y_true", "y_pred")
    # At most K^2 cells are collected, whatever the number of rows.
    seen = F.map_from_entries(F.collect_list(F.struct(cell, F.col("n"))))
    listed = _label_array(labels)
    grid = F.transform(
        listed,
        lambda t: F.transform(listed, lambda p: F.struct(t.alias("y_true"), p.alias("y_pred"))),
    )
    cells = counts.agg(seen.alias("seen")).select("seen", F.explode(F.flatten(grid)).alias("cell"))
    return cells.select(
        "cell.y_true",
        "cell.y_pred",
        F.coalesce(F.try_element_at("seen", F.col("cell")), F.lit(0).cast("bigint")).alias("n"),
    )


def confusion_rates(pairs: DataFrame, focus: Sequence[int]) -> DataFrame:
    """Confusion among a few classes with the share of each truth class (y_true, y_pred, n, rate)."""
    table = confusion(pairs, focus)
    totals = table.groupBy("y_true").agg(
        F.sum("n").alias("total"),
        F.collect_list(F.struct("y_pred", "n")).alias("cells"),  # exactly K cells
    )
    return totals.select("y_true", "total", F.inline("cells")).select(
        "y_true", "y_pred", "n", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("rate")
    )


def weakest(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class with the smallest F1, the lowest id on a tie, and the one-line headline."""
    entries = F.transform(
        F.map_entries("per_class_f1"),
        lambda e: F.struct(e["value"].alias("f1"), e["key"].alias("class")),
    )
    worst = F.array_min(entries)
    headline = F.format_string(
        HEADLINE,
        "macro_f1",
        "accuracy",
        "n",
        worst["class"],
        worst["f1"],
    )
    return scores.select(
        *by,
        worst["class"].alias("class"),
        worst["f1"].alias("f1"),
        headline.alias("headline"),
    )


def class_name(label: Column) -> Column:
    """Name of a class id, NULL when unknown."""
    table = F.create_map(*[F.lit(v) for pair in CLASS_NAMES.items() for v in pair])
    return F.try_element_at(table, label)


@dataclass(frozen=True)
class EvalResult:
    """Score of one prediction table; holds K and K x K numbers only."""

    macro_f1: float
    accuracy: float
    per_class_f1: dict[int, float]
    labels: tuple[int, ...]
    confusion: np.ndarray
    n: int
    headline: str

    def summary(self) -> str:
        return self.headline


def evaluate_predictions(pairs: DataFrame, labels: Sequence[int] = CLASSES) -> EvalResult:
    """Score a table of (y_true, y_pred); a NULL truth means there is nothing to score."""
    labels = tuple(int(c) for c in labels)
    counts = pair_counts(pairs, labels)
    # (K + 1)^2 rows at most: fetched so that scores and confusion share one pass over the data.
    cells = counts.collect()
    few = pairs.sparkSession.createDataFrame(cells, counts.schema)
    scores = score_counts(few, labels)
    row = scores.withColumns(
        {"headline": weakest(scores).select("headline").scalar()}
    ).first()
    if row["n"] == 0 or row["n_unlabelled"]:
        raise ValueError("some or all rows have no labels, so there is nothing to score")
    table = np.zeros((len(labels), len(labels)), dtype=np.int64)
    for cell in cells:
        if cell["y_true"] is not None and cell["y_pred"] is not None:
            table[labels.index(cell["y_true"]), labels.index(cell["y_pred"])] = cell["n"]
    return EvalResult(
        macro_f1=row["macro_f1"],
        accuracy=row["accuracy"],
        per_class_f1={c: row["per_class_f1"][c] for c in labels},
        labels=labels,
        confusion=table,
        n=int(row["n"]),
        headline=row["headline"],
    )
