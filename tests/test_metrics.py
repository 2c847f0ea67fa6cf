from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framelake import evaluate_predictions
from framelake.operators.align import (
    align,
    alignment_summary,
    compare_runs,
    join_truth,
    require_aligned,
)
from framelake.operators.metrics import confusion, score, weakest


def brute(truth, pred, labels):
    f1 = {}
    for c in labels:
        tp = sum(t == c and p == c for t, p in zip(truth, pred))
        fp = sum(t != c and p == c for t, p in zip(truth, pred))
        fn = sum(t == c and p != c for t, p in zip(truth, pred))
        f1[c] = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    return f1, sum(f1.values()) / len(labels), float(np.mean(np.equal(truth, pred)))


def table(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "y_true int, y_pred int")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=60))
def test_scores_match_brute_force(spark, pairs):
    truth, pred = zip(*pairs)
    result = evaluate_predictions(table(spark, truth, pred))
    f1, macro, acc = brute(truth, pred, range(1, 9))
    assert result.per_class_f1 == pytest.approx(f1)
    assert result.macro_f1 == pytest.approx(macro)
    assert result.accuracy == pytest.approx(acc)
    grid = np.zeros((8, 8), dtype=int)
    for t, p in pairs:
        if 1 <= t <= 8 and 1 <= p <= 8:
            grid[t - 1, p - 1] += 1
    assert (result.confusion == grid).all()
    assert result.n == len(pairs)


def test_absent_class_counts_zero(spark):
    result = evaluate_predictions(table(spark, [1, 1], [1, 1]))
    assert result.per_class_f1[1] == 1.0
    assert result.macro_f1 == pytest.approx(1 / 8)


def test_labels_outside_the_list(spark):
    # Truth outside, prediction inside: a false positive. Prediction outside: a miss.
    result = evaluate_predictions(table(spark, [9, 1, 1, 9], [1, 9, 1, 9]))
    assert result.per_class_f1[1] == pytest.approx(2 / (2 + 1 + 1))
    assert result.accuracy == pytest.approx(0.5)
    assert result.confusion.sum() == 1


def test_none_of_the_labels_occurs(spark):
    result = evaluate_predictions(table(spark, [20, 30], [20, 20]))
    assert result.macro_f1 == 0.0
    assert result.confusion.sum() == 0
    assert result.accuracy == 0.5


def test_other_label_list_keeps_its_order(spark):
    result = evaluate_predictions(table(spark, [3, 1], [3, 3]), labels=(3, 1))
    assert result.labels == (3, 1)
    assert result.confusion.tolist() == [[1, 0], [1, 0]]


def test_weakest_takes_the_lowest_class_on_a_tie(spark):
    scores = score(table(spark, [1, 2, 3, 4], [1, 2, 3, 5]))
    row = weakest(scores).first()
    assert (row["class"], row["f1"]) == (4, 0.0)
    assert row["headline"] == "macro-F1=0.3750  acc=0.7500  n=4  weakest=class 4 (F1=0.000)"


@pytest.mark.parametrize("rows", [[], [(None, 1)], [(1, 1), (None, 2)]])
def test_nothing_to_score(spark, rows):
    with pytest.raises(ValueError, match="no labels"):
        evaluate_predictions(spark.createDataFrame(rows, "y_true int, y_pred int"))


def test_confusion_of_an_empty_table_is_a_zero_grid(spark):
    rows = confusion(spark.createDataFrame([], "y_true int, y_pred int")).collect()
    assert len(rows) == 64
    assert not any(r["n"] for r in rows)


def test_groups_with_one_hot_group(spark):
    """A third of all rows belongs to one user."""
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE 1 + id % 200 END AS user",
        "CAST(1 + id % 8 AS INT) AS y_true",
        "CAST(1 + (id + (id % 5 = 0)::INT) % 8 AS INT) AS y_pred",
    )
    local = rows.toPandas()
    for r in score(rows, by=["user"]).collect():
        part = local[local.user == r["user"]]
        _, macro, acc = brute(part.y_true.tolist(), part.y_pred.tolist(), range(1, 9))
        assert (r["macro_f1"], r["accuracy"]) == pytest.approx((macro, acc))
        assert r["n"] == len(part)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitioning_does_not_matter(spark, partitions):
    rows = spark.range(0, 5_000, 1, partitions).selectExpr(
        "CAST(id % 10 AS INT) AS y_true", "CAST((id * 7) % 10 AS INT) AS y_pred"
    )
    f1, macro, _ = brute([i % 10 for i in range(5000)], [i * 7 % 10 for i in range(5000)], range(1, 9))
    row = score(rows).first()
    assert row["macro_f1"] == pytest.approx(macro)


def test_alignment(spark):
    truth = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "frame_idx long, y_true int")
    pred = spark.createDataFrame([(3, 4), (2, 2), (5, 1)], "frame_idx long, y_pred int")
    both = align(truth, pred, ["frame_idx"], "y_true", "y_pred")
    assert tuple(alignment_summary(both).first()) == (4, 1, 1, 0)
    assert sorted(map(tuple, join_truth(truth, pred, ["frame_idx"]).collect())) == [(2, 2, 2), (3, 3, 4)]
    with pytest.raises(ValueError, match="differ"):
        require_aligned(truth, pred, ["frame_idx"])
    same = truth.withColumnRenamed("y_true", "y_pred")
    assert require_aligned(truth, same, ["frame_idx"]).count() == 3


def test_repeated_frames_do_not_multiply(spark):
    """One frame holds a third of both tables: a join would give 10^8 pairs."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS frame_idx", "1 AS y_true")
    pred = rows.withColumnRenamed("y_true", "y_pred")
    row = alignment_summary(align(rows, pred, ["frame_idx"], "y_true", "y_pred")).first()
    assert tuple(row) == (20_001, 0, 0, 1)


def test_compare_runs(spark):
    schema = "frame_idx long, scores array<double>, y_pred int"
    a = spark.createDataFrame([(1, [0.1, 0.9], 2), (2, [0.6, 0.4], 1), (3, [1.0, 0.0], 1)], schema)
    b = spark.createDataFrame([(1, [0.1, 0.7], 2), (2, [0.4, 0.6], 2), (4, [1.0, 0.0], 1)], schema)
    row = compare_runs(a, b, ["frame_idx"]).first()
    assert (row["n_matched"], row["n_unmatched"], row["n_argmax_diff"]) == (2, 2, 1)
    assert (row["n_repeated"], row["n_width_diff"]) == (0, 0)
    assert row["max_abs_diff"] == pytest.approx(0.2)
    # A second row of a frame and a score too few are reported, not passed over.
    a = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 9.0], 1), (2, [1.0, 5.0], 1)], schema)
    b = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1)], schema)
    row = compare_runs(a, b, ["frame_idx"]).first()
    assert (row["n_matched"], row["n_repeated"], row["n_width_diff"], row["max_abs_diff"]) == (1, 1, 1, None)
