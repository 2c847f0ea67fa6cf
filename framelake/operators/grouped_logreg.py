"""Logistic heads of several groups, fitted together: one pass over the data per step for all of them.

Every group has its own scaling, classes and quasi-Newton search. A step asks each search that is still going
for the weights it wants to try, one job adds up loss and gradient of all groups, and each search
goes on with its own sums. So the number of jobs is that of the slowest group, however many there are.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted
from .gram import BUCKETS, summed_rows

#: Steps whose curvature a search remembers.
MEMORY = 10
Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def descend(start: np.ndarray, tol: float, max_iter: int) -> Search:
    """Limited-memory BFGS as a dialogue: yields weights to try, is sent (loss, gradient), returns the weights.

    It ends when no component of the gradient is above ``tol``.
    """
    x = start
    loss, gradient = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(gradient).max(initial=0.0) <= tol:
            break
        way = -_curved(gradient, pairs)
        if (way * gradient).sum() >= 0:
            way, pairs = -gradient, []
        slope = (way * gradient).sum()
        step = 1.0 if pairs else min(1.0, 1.0 / np.sqrt((gradient * gradient).sum()))
        while True:
            trial = x + step * way
            new_loss, new_gradient = yield trial
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        moved, turned = trial - x, new_gradient - gradient
        if (moved * turned).sum() > 1e-14 * (turned * turned).sum():
            pairs = [*pairs, (moved, turned)][-MEMORY:]
        if step < 1e-10:
            break
        x, loss, gradient = trial, new_loss, new_gradient
    return x


def _curved(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the remembered steps show."""
    q, back = gradient.copy(), []
    for moved, turned in reversed(pairs):
        share = (moved * q).sum() / (moved * turned).sum()
        q -= share * turned
        back.append(share)
    if pairs:
        moved, turned = pairs[-1]
        q *= (moved * turned).sum() / (turned * turned).sum()
    for (moved, turned), share in zip(pairs, reversed(back)):
        q += (share - (turned * q).sum() / (moved * turned).sum()) * moved
    return q


def _statistics(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of every group, from one pass."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col("x")))
    found = rows.groupBy("g").agg(summary.alias("s")).select("g", "s.*")
    found = found.select("g", vector_to_array("mean").alias("mean"), vector_to_array("variance").alias("variance"), "count")
    out = {}
    for r in found.collect():
        n = r["count"]
        out[r["g"]] = np.array(r["mean"]), np.sqrt(np.maximum(np.array(r["variance"]) * (n - 1) / n, 0.0))
    return out


def losses(rows: DataFrame, trials: dict[str, np.ndarray], scales: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(g, i, products): row i of the summed gradient of each group's trial, and its loss as the row behind them.

    ``rows`` has (g, k, x): group, 0-based class within the group, features. A trial has one column per class and
    the intercepts as its last row; its gradient comes class by class.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() % BUCKETS
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            names = batch.column("g").dictionary_encode()
            own = names.indices.to_numpy(zero_copy_only=False)
            classes = batch.column("k").to_numpy(zero_copy_only=False)
            for place, name in enumerate(names.dictionary.to_pylist()):
                if name not in trials:
                    continue
                here = own == place
                weights, (mean, spread) = trials[name], scales[name]
                x = np.divide(block[here] - mean, spread, out=np.zeros((here.sum(), len(mean))), where=spread > 0)
                score = x @ weights[:-1] + weights[-1]
                score -= score.max(1, keepdims=True)
                total = np.log(np.exp(score).sum(1))
                at = np.arange(len(x)), classes[here]
                gap = np.exp(score - total[:, None])
                loss = (total - score[at]).sum()
                gap[at] -= 1.0
                sums = np.vstack([gap.T @ np.hstack([x, np.ones((len(x), 1))]), np.full(x.shape[1] + 1, loss)])
                totals[name] = sums if name not in totals else totals[name] + sums
        for name, sums in totals.items():
            n = len(sums)
            columns = [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([bucket] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums), pa.list_(pa.float64()))], ["g", "i", "bucket", "products"])

    return summed_rows(rows.mapInArrow(partial, "g string, i int, bucket int, products array<double>"))


def fit_groups(
    rows: DataFrame, column: str, groups: tuple[str, ...], C: float = 1.0, max_iter: int = 1000, tol: float = 1e-6
) -> dict[str, tuple[tuple[int, ...], np.ndarray]]:
    """{group: (classes, weights)}; weights are for unscaled features, the last row holds the intercepts.

    Per group the mean log loss on standardised features plus ``|weights|^2 / (2 C n)`` is least; intercepts
    are free. The driver holds the weights and ten steps of each group.
    """
    labelled = rows.where(F.col(column).isin(list(groups)))
    found = labelled.groupBy(F.col(column).alias("g"), F.col("y").cast("int").alias("y")).count().collect()
    if any(r["y"] is None for r in found) or len({r["g"] for r in found}) < len(groups):
        raise ValueError("the training set has no labels or only some")
    classes = {g: tuple(sorted(r["y"] for r in found if r["g"] == g)) for g in groups}
    sizes = {g: sum(r["count"] for r in found if r["g"] == g) for g in groups}
    table = F.create_map(*[F.lit(v) for g in groups for v in (g, list(classes[g]))])
    place = F.array_position(table[F.col(column)], F.col("y").cast("int")) - 1
    kept = persisted(labelled.select(F.col(column).alias("g"), place.cast("int").alias("k"), F.col("features").alias("x")))
    try:
        scales = _statistics(kept)
        shapes = {g: (len(scales[g][0]) + 1, len(classes[g])) for g in groups}
        searches = {g: descend(np.zeros(shapes[g]), tol, max_iter) for g in groups}
        trials = {g: next(search) for g, search in searches.items()}
        done: dict[str, np.ndarray] = {}
        while trials:
            sums: dict[str, dict[int, list[float]]] = {g: {} for g in trials}
            for r in losses(kept, trials, scales).collect():
                sums[r["g"]][r["i"]] = r["products"]
            for g, tried in list(trials.items()):
                n, many = sizes[g], len(classes[g])
                gradient = np.array([sums[g][i] for i in range(many)]).T / n
                loss = sums[g][many][0] / n + (tried[:-1] ** 2).sum() / (2 * C * n)
                gradient[:-1] += tried[:-1] / (C * n)
                try:
                    trials[g] = searches[g].send((loss, gradient))
                except StopIteration as end:
                    done[g] = end.value
                    del trials[g]
    finally:
        kept.unpersist()
    out = {}
    for g in groups:
        mean, spread = scales[g]
        weights = np.divide(done[g][:-1], spread[:, None], out=np.zeros_like(done[g][:-1]), where=spread[:, None] > 0)
        out[g] = classes[g], np.vstack([weights, done[g][-1] - mean @ weights])
    return out
