"""What the pieces of an experiment promise, against closed forms and over splits, locations and heads."""

from __future__ import annotations

import warnings
from types import SimpleNamespace

import numpy as np
import pytest

from framelake import (
    embeddings,
    evaluate,
    leaderboard,
    list_available,
    list_heads,
    log_run,
    make_head,
    read_experiments,
    read_runs,
    track,
    write_submission,
)
from framelake.constants import CLASSES, EXPECTED_COLS, TRAIN_LOCATIONS
from framelake.operators.leaderboard import certifiable
from framelake.sources import commit_log
from framelake.sources.runs import append_metrics, compact_runs, read_run_metrics

WIDTH, EACH = 16, {"train": 48, "validation": 12}


@pytest.mark.parametrize("split", ["train", "validation"])
@pytest.mark.parametrize("place", [None, *TRAIN_LOCATIONS])
def test_slices_are_balanced(spark, cache, split, place):
    part = embeddings(spark, "synthetic", split, place, root=cache)
    places = 1 if place else len(TRAIN_LOCATIONS)
    counts = {r["y"]: r["count"] for r in part.df.groupBy("y").count().collect()}
    assert counts == {c: EACH[split] * places for c in CLASSES}
    assert (part.n, part.dim, part.has_labels) == (sum(counts.values()), WIDTH, True)
    assert part.location == place and list_available(spark, cache) == [("synthetic", part.revision)]


@pytest.mark.parametrize("place", [None, "Bag"])
def test_unlabelled_slices_serve_prediction_only(spark, cache, place):
    hidden = embeddings(spark, "synthetic", "test", place, root=cache)
    assert (hidden.n, hidden.has_labels, hidden.location) == (256, False, None)
    head = make_head("linear")
    model = head.fit(embeddings(spark, "synthetic", "train", "Hips", root=cache).df)
    assert model.predict(hidden.df).where("y_pred BETWEEN 1 AND 8").count() == hidden.n
    for refused in (lambda: evaluate(model, hidden), lambda: evaluate(model, hidden.df), lambda: head.fit(hidden.df)):
        with pytest.raises(ValueError, match="no labels"):
            refused()


@pytest.mark.parametrize("name,least", [(h, 0.8 if h == "logreg" else 0.5) for h in list_heads()])
def test_scores_follow_from_the_confusion_table(spark, cache, name, least):
    held = embeddings(spark, "synthetic", "validation", root=cache)
    result = evaluate(make_head(name, seed=0).fit(embeddings(spark, "synthetic", "train", root=cache).df), held)
    table = np.asarray(result.confusion, float)
    hits = np.diag(table)
    f1 = 2 * hits / (table.sum(0) + table.sum(1))
    assert table.sum() == result.n == held.n
    assert result.accuracy == pytest.approx(hits.sum() / result.n)
    assert [result.per_class_f1[c] for c in CLASSES] == pytest.approx(f1.tolist())
    assert result.macro_f1 == pytest.approx(f1.mean()) and result.macro_f1 > least
    assert result.summary().startswith(f"macro-F1={result.macro_f1:.4f}")


def scored(value):
    return SimpleNamespace(macro_f1=value, accuracy=value / 2, per_class_f1=dict.fromkeys(CLASSES, value))


def test_runs_keep_steps_and_the_last_value(spark, tmp_path):
    store = str(tmp_path / "store")
    board = lambda: leaderboard(read_runs(spark, store), read_experiments(spark, store))
    assert board().isEmpty()
    with track(spark, store, "team", "m|all|h", params={"fm": "m"}, tags={"git_dirty": False, "student": "me"},
               auto_tags={"student": "auto", "git_sha": "abc", "job": None, "python_env": "/venv"}, seed=7) as run:
        run.log(loss=0.5)
        run.log(scored(0.25), step=1)
        run.log(scored(0.75), step=2, prefix="")
        run.params["head"] = "h"
    assert {(r["metric"], r["step"]): r["value"] for r in read_run_metrics(spark, store).where("metric IN ('macro_f1', 'loss')").collect()} == {
        ("loss", 0): 0.5, ("macro_f1", 1): 0.25, ("macro_f1", 2): 0.75,
    }
    assert read_run_metrics(spark, store).count() == 1 + 2 * (2 + len(CLASSES))
    row = board().first().asDict()
    want = {"experiment": "team", "run_name": "m|all|h", "macro_f1": 0.75, "accuracy": 0.375, "fm": "m", "head": "h",
            "student": "me", "git_sha": "abc", "git_dirty": "false", "run_id": run.run_id}
    assert {k: row[k] for k in want} == want
    assert read_runs(spark, store).first()["params"]["seed"] == "7"
    assert certifiable(read_runs(spark, store), "/venv").count() == 1


def test_a_run_logged_again_is_one_run(spark, tmp_path):
    store = str(tmp_path / "store")
    log_run(spark, store, "team", run_id="r", metrics={"macro_f1": 0.1, "loss": 3.0}, tags={"git_dirty": False})
    log_run(spark, store, "team", run_id="other", metrics={"macro_f1": 0.5})
    log_run(spark, store, "team", run_id="r", metrics={"macro_f1": 0.2}, tags={"git_dirty": True})
    append_metrics(spark.createDataFrame([("r", "late", 7.0)], "run_id string, metric string, value double"), store)

    def seen():
        rows = {r["run_id"]: r for r in read_runs(spark, store).collect()}
        assert len(rows) == read_runs(spark, store).count() == 2
        values = {(r["run_id"], r["metric"]): r["value"] for r in read_run_metrics(spark, store).collect()}
        return rows["r"]["metrics"], rows["r"]["tags"].get("git_dirty"), values

    want = {("r", "macro_f1"): 0.2, ("r", "late"): 7.0, ("other", "macro_f1"): 0.5}
    assert seen() == ({"macro_f1": 0.2}, "true", want)
    assert compact_runs(spark, store) > 3 and seen()[2] == want
    assert compact_runs(spark, store) == 0
    log_run(spark, store, "team", run_id="r", metrics={"macro_f1": 0.3})
    assert seen()[0] == {"macro_f1": 0.3} and seen()[2]["r", "macro_f1"] == 0.3


def test_two_writers_of_one_run(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    # Neither writer sees the other: both take the first sequence number.
    monkeypatch.setattr("framelake.sources.commit_log.next_sequence", lambda records: 1)
    for name, value in (("b", 0.7), ("a", 0.4)):
        monkeypatch.setattr("framelake.sources.commit_log.new_write_id", lambda name=name: name)
        log_run(spark, store, "team", run_id="r", metrics={"macro_f1": value})
    assert [r["metrics"] for r in read_runs(spark, store).collect()] == [{"macro_f1": 0.7}]
    assert [r["value"] for r in read_run_metrics(spark, store).collect()] == [0.7]


def test_a_writer_killed_between_its_tables(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    log_run(spark, store, "team", run_id="r", metrics={"loss": 1.0})
    real = commit_log.append

    def killed(rows, path, *stamp):
        if path.endswith("/runs"):
            raise OSError("killed")
        real(rows, path, *stamp)

    monkeypatch.setattr(commit_log, "append", killed)
    with pytest.raises(OSError):
        log_run(spark, store, "team", run_id="r", metrics={"loss": 2.0})
    assert [r["value"] for r in read_run_metrics(spark, store).collect()] == [1.0]


def test_a_store_written_without_stamps(spark, tmp_path):
    store = str(tmp_path / "store")
    log_run(spark, f"{store}-new", "team", run_id="r", metrics={"loss": 1.0})
    read_runs(spark, f"{store}-new").write.parquet(f"{store}/runs")
    assert read_runs(spark, store).first()["metrics"] == {"loss": 1.0}
    log_run(spark, store, "team", run_id="r", metrics={"loss": 2.0})
    assert [r["metrics"] for r in read_runs(spark, store).collect()] == [{"loss": 2.0}]


def test_a_store_that_cannot_be_written_warns(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    with pytest.warns(UserWarning, match="was not written"), track(spark, str(tmp_path / "file"), "team") as run:
        run.log(x=1.0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ZeroDivisionError), track(spark, str(tmp_path / "file"), "team"):
            1 / 0  # noqa: B018


def test_a_failed_block_is_still_logged(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(KeyError), track(spark, store, "team") as run:
        run.log(x=1.0)
        raise KeyError
    assert read_run_metrics(spark, store).count() == 1


@pytest.mark.parametrize("rows", [1, 10])
def test_a_short_matrix_is_written_and_reported(spark, tmp_path, rows):
    report = write_submission(spark.range(rows).selectExpr("id AS frame_idx", "1 AS y_pred"), str(tmp_path / "out"))
    assert (report.ok, report.n_rows, report.n_cols) == (False, rows, EXPECTED_COLS)


def test_many_records_are_written_by_many_tasks(spark, tmp_path):
    store = str(tmp_path / "store")
    log_run(spark, f"{store}-one", "team", run_id="r", metrics={"loss": 1.0})
    row = read_runs(spark, f"{store}-one").drop("run_id")
    rows = spark.range(0, 4000, 1, 4).selectExpr("cast(id as string) AS run_id").crossJoin(row)
    for attempt, some in enumerate((rows, rows.where("cast(run_id as int) % 2 = 0"))):
        commit_log.append(some, f"{store}/runs", attempt + 1, str(attempt), one_file=False)
    assert len(list((tmp_path / "store" / "runs").glob("*.parquet"))) == 8
    assert read_runs(spark, store).count() == 4000
    stamped = commit_log.latest(commit_log.read_records(spark, f"{store}/runs", read_runs(spark, store).schema), ["run_id"])
    assert stamped.where("sequence = 2").count() == 2000
