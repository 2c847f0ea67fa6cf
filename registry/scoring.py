"""Queries over predictions: macro-F1, confusion, breakdowns, alignment, run comparison."""

from __future__ import annotations

from framelake.operators.align import (
    align,
    alignment_summary,
    compare_runs,
    join_truth,
    unmatched,
)
from framelake.operators.metrics import (
    class_name,
    confusion,
    confusion_rates,
    per_class,
    score,
    score_grouping_sets,
    weakest,
)
from framelake.sources.runs import eval_metrics_long
from pyspark.sql import functions as F

from .views import EXTERNAL, PREDS, TRUTH, external, preds, scores, scores_sql, truth, with_cte


def macro_f1(spark, sf):
    table = score(preds(spark, sf))
    return table.select(F.round("macro_f1", 9).alias("macro_f1"), "n")


def accuracy(spark, sf):
    return score(preds(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


def per_class_f1(spark, sf):
    return per_class(score(preds(spark, sf))).withColumn("f1", F.round("f1", 9))


def q_confusion(spark, sf):
    return confusion(preds(spark, sf))


def motor_confusion(spark, sf):
    rates = confusion_rates(preds(spark, sf), (5, 6, 7))
    return rates.withColumn("rate", F.round("rate", 9))


def class_names(spark, sf):
    table = per_class(score(preds(spark, sf)))
    return table.select("class", class_name(F.col("class")).alias("name"), F.round("f1", 9).alias("f1"))


def weakest_class(spark, sf):
    worst = weakest(score(preds(spark, sf)))
    return worst.select("class", F.round("f1", 9).alias("f1"), "headline")


def _by(spark, sf, column):
    table = score(preds(spark, sf), by=[column])
    rounded = {c: F.round(c, 9) for c in ("macro_f1", "accuracy")}
    return table.withColumns(rounded).drop("per_class_f1", "n_unlabelled")


def f1_by_user(spark, sf):
    return _by(spark, sf, "user")


def f1_by_location(spark, sf):
    return _by(spark, sf, "location")


def f1_grouping_sets(spark, sf):
    table = score_grouping_sets(preds(spark, sf), [["user"], ["location"], []])
    return table.withColumn("macro_f1", F.round("macro_f1", 9)).select(
        "grouping", "user", "location", "macro_f1", "n"
    )


def q_eval_metrics_long(spark, sf):
    table = score(preds(spark, sf), by=["user"])
    return eval_metrics_long(table, ["user"], "val_").withColumn("value", F.round("value", 9))


def eval_joined(spark, sf):
    pairs = join_truth(truth(spark, sf), external(spark, sf), ["frame_idx"])
    table = score(pairs.select("y_true", "y_pred"))
    rounded = {c: F.round(c, 9) for c in ("macro_f1", "accuracy")}
    return table.withColumns(rounded).select("macro_f1", "accuracy", "n")


def pred_alignment(spark, sf):
    both = align(truth(spark, sf), external(spark, sf), ["frame_idx"], "y_true", "y_pred")
    return unmatched(both).select("frame_idx", "y_true", "y_pred")


def pred_alignment_summary(spark, sf):
    both = align(truth(spark, sf), external(spark, sf), ["frame_idx"], "y_true", "y_pred")
    return alignment_summary(both)


def run_compare(spark, sf):
    first, second = scores(spark, sf, 5), scores(spark, sf, 3)
    # Some frames of the second run have a score too few, some occur twice.
    k = F.col("frame_idx")
    cut = second.withColumn("scores", F.when(k % 97 == 4, F.slice("scores", 1, 10)).otherwise(F.col("scores")))
    table = compare_runs(first, cut.unionByName(cut.where(k % 101 == 5)), ["frame_idx"])
    return table.withColumn("max_abs_diff", F.round("max_abs_diff", 9))


QUERIES = {
    "macro_f1": macro_f1,
    "accuracy": accuracy,
    "per_class_f1": per_class_f1,
    "confusion": q_confusion,
    "motor_confusion": motor_confusion,
    "class_names": class_names,
    "weakest_class": weakest_class,
    "f1_by_user": f1_by_user,
    "f1_by_location": f1_by_location,
    "f1_grouping_sets": f1_grouping_sets,
    "eval_metrics_long": q_eval_metrics_long,
    "eval_joined": eval_joined,
    "pred_alignment": pred_alignment,
    "pred_alignment_summary": pred_alignment_summary,
    "run_compare": run_compare,
}


def _f1_sql(group: str = "", source: str = "preds") -> str:
    """CTEs for F1 per listed class from plain conditional counts, per ``group``."""
    keys = f"{group}, " if group else ""
    by = f" GROUP BY {group}, c" if group else " GROUP BY c"
    return f"""f1s AS (
  SELECT {keys}CAST(c AS INTEGER) AS class,
         count(*) FILTER (y_true = c AND y_pred = c) AS tp,
         count(*) FILTER (y_true <> c AND y_pred = c) AS fp,
         count(*) FILTER (y_true = c AND y_pred <> c) AS fn
  FROM {source}, range(1, 9) AS r(c){by}),
f1 AS (
  SELECT {keys}class, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE
         ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM f1s)"""


def _acc(group: str, source: str = "preds") -> str:
    keys = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    return f"""acc AS (
  SELECT {keys}avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
         count(*) AS n FROM {source}{by})"""


def _by_sql(column: str) -> str:
    return with_cte(PREDS, _f1_sql(column), _acc(column), select=f"""
SELECT {column}, round(avg(f1), 9) AS macro_f1, round(any_value(accuracy), 9) AS accuracy,
       any_value(n) AS n FROM f1 JOIN acc USING ({column}) GROUP BY {column}""")


def _set_sql(column: str, name: str) -> str:
    other = {"user": "location", "location": "user", "": ""}[column]
    keys = f"{column}, " if column else ""
    src = f'SELECT {keys}y_true, y_pred FROM preds'
    user = '"user"' if column == "user" else 'CAST(NULL AS INTEGER) AS "user"'
    loc = "location" if column == "location" else "CAST(NULL AS VARCHAR) AS location"
    group = f'"{column}"' if column else ""
    inner = with_cte(f"src AS ({src.replace('user', chr(34) + 'user' + chr(34))})",
                     _f1_sql(group, "src"), _acc(group, "src"), select=f"""
SELECT '{name}' AS grouping, {user}, {loc}, round(avg(f1), 9) AS macro_f1, any_value(n) AS n
FROM f1 {'JOIN acc USING (' + group + ')' if group else ', acc'}
{'GROUP BY ' + group if group else ''}""")
    return f"SELECT * FROM ({inner})"


ORACLES = {
    "macro_f1": with_cte(PREDS, _f1_sql(), select="""
SELECT round(avg(f1), 9) AS macro_f1, (SELECT count(*) FROM preds) AS n FROM f1"""),
    "accuracy": with_cte(PREDS, _acc(""), select="SELECT round(accuracy, 9) AS accuracy FROM acc"),
    "per_class_f1": with_cte(PREDS, _f1_sql(), select="SELECT class, round(f1, 9) AS f1 FROM f1"),
    "confusion": with_cte(PREDS, select="""
SELECT CAST(t AS INTEGER) AS y_true, CAST(p AS INTEGER) AS y_pred,
       count(y_true) AS n
FROM range(1, 9) AS a(t) CROSS JOIN range(1, 9) AS b(p)
LEFT JOIN preds ON y_true = t AND y_pred = p GROUP BY t, p"""),
    "motor_confusion": with_cte(PREDS, select="""
SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 9) AS rate FROM (
  SELECT CAST(t AS INTEGER) AS y_true, CAST(p AS INTEGER) AS y_pred, count(y_true) AS n
  FROM range(5, 8) AS a(t) CROSS JOIN range(5, 8) AS b(p)
  LEFT JOIN preds ON y_true = t AND y_pred = p GROUP BY t, p)"""),
    "class_names": with_cte(PREDS, _f1_sql(), select="""
SELECT class, ['Still','Walk','Run','Bike','Car','Bus','Train','Subway'][class] AS name,
       round(f1, 9) AS f1 FROM f1"""),
    "weakest_class": with_cte(PREDS, _f1_sql(), _acc(""), select="""
SELECT w.class, round(w.f1, 9) AS f1,
       printf('macro-F1=%.4f  acc=%.4f  n=%d  weakest=class %d (F1=%.3f)',
              (SELECT avg(f1) FROM f1), accuracy, n, w.class, w.f1) AS headline
FROM (SELECT class, f1 FROM f1 ORDER BY f1, class LIMIT 1) AS w, acc"""),
    "f1_by_user": _by_sql('"user"'),
    "f1_by_location": _by_sql("location"),
    "f1_grouping_sets": with_cte(PREDS, select=" UNION ALL ".join(
        [_set_sql("user", "user"), _set_sql("location", "location"), _set_sql("", "all")])),
    "eval_metrics_long": with_cte(PREDS, _f1_sql('"user"'), _acc('"user"'), select="""
SELECT "user", 'val_macro_f1' AS metric, round(avg(f1), 9) AS value FROM f1 GROUP BY "user"
UNION ALL SELECT "user", 'val_accuracy', round(accuracy, 9) FROM acc
UNION ALL SELECT "user", 'val_class_' || class || '_f1', round(f1, 9) FROM f1"""),
    "eval_joined": with_cte(
        TRUTH, EXTERNAL, "pairs AS (SELECT y_true, y_pred FROM truth JOIN external USING (frame_idx))",
        _f1_sql("", "pairs"), _acc("", "pairs"), select="""
SELECT round(avg(f1), 9) AS macro_f1, (SELECT round(accuracy, 9) FROM acc) AS accuracy,
       (SELECT n FROM acc) AS n FROM f1"""),
    "pred_alignment": with_cte(TRUTH, EXTERNAL, select="""
SELECT frame_idx, y_true, y_pred FROM truth FULL JOIN external USING (frame_idx)
WHERE y_true IS NULL OR y_pred IS NULL"""),
    "pred_alignment_summary": with_cte(TRUTH, EXTERNAL, select="""
SELECT count(*) AS n_keys, count(*) FILTER (y_pred IS NULL) AS only_left,
       count(*) FILTER (y_true IS NULL) AS only_right, CAST(0 AS BIGINT) AS repeated
FROM truth FULL JOIN external USING (frame_idx)"""),
    "run_compare": with_cte(scores_sql("a", 5), scores_sql("whole", 3), select="""
, b AS (SELECT * FROM whole WHERE frame_idx % 97 <> 4 OR c < 10
        UNION ALL SELECT * FROM whole WHERE frame_idx % 101 = 5 AND (frame_idx % 97 <> 4 OR c < 10)),
pa AS (SELECT frame_idx, count(*) FILTER (c = 0) AS n, count(*) AS w, any_value(y_pred) AS p FROM a GROUP BY 1),
pb AS (SELECT frame_idx, count(*) FILTER (c = 0) AS n, count(*) AS w, any_value(y_pred) AS q FROM b GROUP BY 1),
f AS (SELECT frame_idx, coalesce(pa.n, 0) AS nl, coalesce(pb.n, 0) AS nr, pa.w AS wl, pb.w AS wr, p, q
      FROM pa FULL JOIN pb USING (frame_idx)),
m AS (SELECT * FROM f WHERE nl = 1 AND nr = 1)
SELECT (SELECT count(*) FROM m) AS n_matched, (SELECT count(*) FROM f WHERE nl <> 1 OR nr <> 1) AS n_unmatched,
       (SELECT count(*) FROM f WHERE nl > 1 OR nr > 1) AS n_repeated,
       (SELECT count(*) FROM m WHERE wl <> wr) AS n_width_diff,
       (SELECT round(max(abs(a.score - b.score)), 9) FROM m JOIN a USING (frame_idx)
        JOIN b ON b.frame_idx = a.frame_idx AND b.c = a.c WHERE wl = wr) AS max_abs_diff,
       (SELECT count(*) FROM m WHERE p <> q) AS n_argmax_diff"""),
}
