"""Synthetic vectors, leaderboard, run store, session helpers, stage runner."""

from __future__ import annotations

import datetime as dt
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF
from framelake import leaderboard, log_run, read_experiments, read_runs
from framelake import session as S
from framelake.__main__ import main, parser
from framelake.constants import RUN_COLUMNS
from framelake.operators.fusion import fuse_models
from framelake.operators.leaderboard import certifiable, run_table, scores_by_seed
from framelake.operators.synthetic import synthetic_keys, synthetic_vectors
from framelake.schemas import EXPERIMENT_SCHEMA, LEADERBOARD_SCHEMA, RUN_SCHEMA
from framelake.sources.matrix import output_tasks
from framelake.sources.runs import merge_tags


def test_same_seed_same_rows_at_any_partitioning(spark):
    keys = synthetic_keys(spark, n_per_class=8, n_test=20, seed=3)
    one = synthetic_vectors(keys.repartition(1), dim=5, seed=3)
    many = synthetic_vectors(keys.repartition(16), dim=5, seed=3)
    assert one.count() == many.count() == 8 * 8 * 4 * 2 + 20
    assert one.exceptAll(many).isEmpty()
    other = synthetic_vectors(keys, dim=5, seed=4)
    assert one.exceptAll(other).count() == one.count()


def test_draws_are_standard_normal(spark):
    from framelake.functions.vectors import normal

    row = spark.range(40_000).select(normal(1, F.col("id")).alias("x")).agg(
        F.avg("x"), F.stddev_pop("x"), F.skewness("x"), F.kurtosis("x")
    ).first()
    assert row[0] == pytest.approx(0, abs=0.02)
    assert row[1] == pytest.approx(1, abs=0.02)
    assert row[2] == pytest.approx(0, abs=0.05)
    assert row[3] == pytest.approx(0, abs=0.1)


def test_counts_and_balance(spark):
    keys = synthetic_keys(spark, n_per_class=40, n_test=30)
    got = {tuple(r) for r in keys.groupBy("split", "location", "y").count().collect()}
    places = ("Bag", "Hips", "Torso", "Hand")
    want = {("train", p, c, 40) for p in places for c in range(1, 9)}
    want |= {("validation", p, c, 10) for p in places for c in range(1, 9)}
    assert got == want | {("test", "all", None, 30)}
    drawn = keys.where("split = 'test'").selectExpr("min(class)", "max(class)").first()
    assert drawn[0] >= 1 and drawn[1] <= 8


def run(run_id, metric, exp="1", tags=None, params=None):
    metrics = {} if metric == "absent" else {"macro_f1": metric}
    return (run_id, exp, dt.datetime(2024, 1, 1), params or {}, tags or {}, metrics)


@pytest.fixture
def store(spark):
    rows = [
        run("e", 0.5), run("d", 0.5, "2"), run("c", float("nan")), run("b", None), run("a", "absent"),
        run("f", 0.9, "9", {"run_name": "x", "git_dirty": "false", "python_env": "t"}, {"fm": "m"}),
    ]
    names = spark.createDataFrame([("1", "one"), ("2", "two")], EXPERIMENT_SCHEMA)
    return spark.createDataFrame(rows, RUN_SCHEMA), names


def test_order_of_the_leaderboard(store):
    rows = leaderboard(*store).collect()
    assert [r["run_id"] for r in rows] == ["f", "d", "e", "a", "b", "c"]
    assert math.isnan(rows[-1]["macro_f1"])
    assert rows[0]["experiment"] == "9" and rows[1]["experiment"] == "two"
    assert (rows[0]["run_name"], rows[0]["fm"], rows[0]["student"]) == ("x", "m", None)


def test_experiment_filter_and_limit(store):
    assert [r["run_id"] for r in leaderboard(*store, ["two", "9"]).collect()] == ["f", "d"]
    assert [r["run_id"] for r in leaderboard(*store, max_results=2).collect()] == ["f", "d"]
    empty = leaderboard(*store, [])
    assert empty.isEmpty() and empty.schema == LEADERBOARD_SCHEMA
    assert tuple(leaderboard(*store).columns) == RUN_COLUMNS
    assert [r["run_id"] for r in certifiable(store[0], "t").collect()] == ["f"]


def test_other_metric(spark, store, tmp_path):
    folder = str(tmp_path / "s")
    log_run(spark, folder, "x", metrics={"macro_f1": 0.1, "val_acc": 0.9}, run_id="1")
    log_run(spark, folder, "x", metrics={"macro_f1": 0.9, "val_acc": 0.2}, run_id="2")
    board = leaderboard(read_runs(spark, folder), read_experiments(spark, folder), metric="val_acc")
    assert [(r["run_id"], r["macro_f1"]) for r in board.collect()] == [("1", 0.9), ("2", 0.2)]
    assert read_experiments(spark, folder).count() == 1


def test_tags(spark):
    df = spark.sql(
        "SELECT map('a', '1', 'b', '2', 'c', CAST(NULL AS STRING)) AS auto,"
        " map('b', '3', 'd', CAST(NULL AS STRING)) AS given"
    )
    assert df.select(merge_tags(F.col("auto"), F.col("given"))).first()[0] == {"a": "1", "b": "3"}


def test_an_experiment_added_twice_doubles_no_run(spark):
    runs = spark.sql("SELECT 'r' AS run_id, '1' AS experiment_id, now() AS start_time, map('seed', '3') AS params, map('run_name', 'n') AS tags, map('macro_f1', 0.5D) AS metrics")
    names = spark.createDataFrame([("1", "team"), ("1", "team")], "experiment_id string, name string")
    got = run_table(runs, names, params=("seed",)).collect()
    assert [(r["experiment"], r["seed"]) for r in got] == [("team", "3")]
    assert scores_by_seed(run_table(runs, names, params=("seed",)), ["fm"]).first()["n_seeds"] == 1


def test_fusion_needs_every_model(spark):
    rows = spark.createDataFrame(
        [("a", 1, [1.0], 4), ("b", 1, [2.0, 3.0], 4), ("a", 2, [5.0], 4)],
        "fm string, frame_idx long, features array<float>, y int",
    ).selectExpr("*", "'train' AS split", "'Bag' AS location")
    rows = rows.withColumn("revision", F.lit("1"))
    other = rows.withColumns({"revision": F.lit("2"), "features": F.array(F.lit(9.0).cast("float"))})
    got = fuse_models(rows.unionByName(other), [("b", "1"), ("a", "1")]).collect()
    assert [(r["frame_idx"], r["features"], r["y"]) for r in got] == [(1, [2.0, 3.0, 1.0], 4)]


def test_lookup_join_has_another_way_for_large_tables(spark, monkeypatch):
    """One key holds a third of the rows; both ways give the same rows."""
    facts = spark.range(9000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id")
    dim = spark.range(9000).selectExpr("id AS k", "id * 2 AS v")
    small = S.lookup_join(facts, dim, "k")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "fits_broadcast", lambda *_: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = S.lookup_join(facts, dim, "k")
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert small.exceptAll(large).isEmpty() and large.count() == 9000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check_counts_rows_and_bytes(spark):
    dim = spark.range(100).selectExpr("id AS k", "repeat('x', 100) AS v")
    assert S.fits_broadcast(dim)
    assert not S.fits_broadcast(dim, rows=99)
    assert not S.fits_broadcast(dim, size=5000)
    assert S.fits_broadcast(dim.where("false"))


def test_scratch_folder_is_the_one_the_cluster_names(spark, tmp_path, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

    there = Session()
    there.conf = Conf("hdfs://shared/tmp/")
    assert S.scratch_dir(there) == "hdfs://shared/tmp"
    there.conf = Conf(None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.scratch_dir(there)


def test_materialise_reads_back_what_it_wrote(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s", "array(float(id)) AS a")
    back = S.materialise(df, "t")
    assert back.dtypes == df.dtypes
    assert back.exceptAll(df).isEmpty()
    assert "Range" not in back._jdf.queryExecution().executedPlan().toString()


def test_output_tasks_follow_the_text_size(spark):
    assert output_tasks(spark, 10, 500) == 1
    assert output_tasks(spark, 10**9, 500) == 2 * 10**9 * 500 >> 27
    cores = spark.sparkContext.defaultParallelism
    assert 1 < output_tasks(spark, 92_726, 500) <= cores


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, Python workers cannot import the package by name."""
    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from __spark_entry__ import queries
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("embed_stats", "embed_udf", "gram_matrix", "predict_frames", "file_digest_disk"):
    assert queries()[name](spark, {SF!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_stage_names():
    stages = parser()._subparsers._group_actions[0].choices
    assert {"verify-data", "window", "embed", "train-head", "predict", "format-submission"} <= set(stages)


def test_stage_runner(spark, cache, tmp_path, capsys):
    head = str(tmp_path / "head")
    common = ["--root", cache]
    args = ["train-head", "--fm", "synthetic", "--head", "linear", "--out", head, *common]
    assert main([*args, "--store", str(tmp_path / "store")]) == 0
    assert "macro-F1=" in capsys.readouterr().out
    assert main(["predict", "--head-path", head, "--out", str(tmp_path / "p"), *common]) == 0
    assert "predicted 256 frames" in capsys.readouterr().out
    assert main(["format-submission", str(tmp_path / "p"), "--out", str(tmp_path / "s")]) == 1
    assert "expected 92726 rows, got 256" in capsys.readouterr().err
    assert main(["train-head", "--fm", "nothing", *common]) == 1
