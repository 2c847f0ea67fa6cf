"""The leaderboard: runs ranked by a metric, and summaries over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RUN_COLUMNS
from ..schemas import LEADERBOARD_SCHEMA
from ..session import lookup_join


def _ranked(metric: str) -> list[Column]:
    """Numbers descending, then NaN and NULL together; ties by run id."""
    number = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    return [number.desc_nulls_last(), F.col("run_id").asc()]


def run_table(
    runs: DataFrame, experiments: DataFrame, metric: str = "macro_f1", params: Sequence[str] = ()
) -> DataFrame:
    """Flatten runs to the leaderboard columns; an absent tag, param or metric is NULL.

    ``params`` (for instance ``seed``) are added as text columns behind them.

    The experiment name falls back to the id. The column keeps the name ``macro_f1`` whatever
    ``metric`` is ranked, as users of the table expect.
    """
    # Two writers may have added an experiment twice: one name per id, so that no run is doubled.
    names = experiments.groupBy("experiment_id").agg(F.min("name").alias("name"))
    named = lookup_join(runs, names, "experiment_id")
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    param = lambda key: F.try_element_at("params", F.lit(key))
    columns = {
        "experiment": F.coalesce("name", F.col("experiment_id").cast("string")),
        "run_name": tag("run_name"),
        "macro_f1": F.try_element_at("metrics", F.lit(metric)),
        "accuracy": F.try_element_at("metrics", F.lit("accuracy")),
        "fm": param("fm"),
        "head": param("head"),
        "student": tag("student"),
        "git_sha": tag("git_sha"),
        "git_dirty": tag("git_dirty"),
        "start_time": F.col("start_time"),
        "run_id": F.col("run_id"),
    }
    return named.select(*[columns[c].alias(c) for c in RUN_COLUMNS], *[param(p).alias(p) for p in params])


def leaderboard(
    runs: DataFrame,
    experiments: DataFrame,
    only: Sequence[str] | None = None,
    *,
    metric: str = "macro_f1",
    max_results: int | None = None,
) -> DataFrame:
    """Runs of all or the named experiments, best first.

    ``max_results`` keeps the best rows after ranking; an empty list of experiments gives an
    empty table with the usual columns.
    """
    if only is not None and not only:
        return runs.sparkSession.createDataFrame([], LEADERBOARD_SCHEMA)
    table = run_table(runs, experiments, metric)
    if only is not None:
        table = table.where(F.col("experiment").isin(list(only)))
    ordered = table.orderBy(*_ranked("macro_f1"))
    return ordered if max_results is None else ordered.limit(max_results)


def scores_by_seed(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and number of seeds per configuration."""
    return table.groupBy(*keys).agg(
        F.avg("macro_f1").alias("mean_f1"),
        F.stddev_samp("macro_f1").alias("std_f1"),
        F.count_distinct("seed").alias("n_seeds"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def certifiable(runs: DataFrame, python_env: str) -> DataFrame:
    """Runs from a clean tree in the team environment."""
    clean = F.try_element_at("tags", F.lit("git_dirty")) == "false"
    team = F.try_element_at("tags", F.lit("python_env")) == python_env
    return runs.where(clean & team)


def best_by_model(table: DataFrame) -> DataFrame:
    """Best run per model: (fm, best_f1, run_id, n_runs)."""
    number = F.nanvl(F.col("macro_f1"), F.lit(None).cast("double"))
    # Equal scores of a model are merged first, keeping the smallest run id among them.
    return (
        table.where(number.isNotNull())
        .groupBy("fm", number.alias("m"))
        .agg(F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("n"))
        .groupBy("fm")
        .agg(
            F.max("m").alias("best_f1"),
            F.max_by("run_id", "m").alias("run_id"),
            F.sum("n").alias("n_runs"),
        )
    )


def ablation(table: DataFrame) -> DataFrame:
    """(fm, locations, head, best_f1, n_runs) from run names ``fm|locations|head``, whatever the head is called."""
    parts = F.split("run_name", r"\|")
    named = table.where(F.size(parts) == 3).select(
        parts[0].alias("fm"),
        parts[1].alias("locations"),
        parts[2].alias("head"),
        F.nanvl(F.col("macro_f1"), F.lit(None).cast("double")).alias("macro_f1"),
    )
    return named.groupBy("fm", "locations", "head").agg(
        F.max("macro_f1").alias("best_f1"), F.count(F.lit(1)).alias("n_runs")
    )
