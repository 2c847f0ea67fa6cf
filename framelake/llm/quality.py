"""A quality score from document statistics: random Fourier features, ridge regression, isotonic calibration.

The features ``sqrt(2/D) cos(W x + b)`` of standardised statistics approximate a Gaussian kernel. Each
task adds up the normal equations of its labelled rows; the sums meet row by row of the matrix, and
only that one matrix reaches the driver. Scores of a part of the labelled rows, set aside by a hash,
are counted in bins and made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.session import materialise

from .common import small_batches, texts

FEATURES = 384
RIDGE = 1e-4
SEED = 7
BINS = 2000
#: One of so many labelled rows calibrates instead of fitting.
CALIBRATION = 5

#: The statistics, in the order in which :func:`statistics` gives them.
NAMES = (
    "log_words log_lines log_line_words mean_word std_word longest_word letters upper digits spaces non_ascii "
    "stops commas bangs pipes symbols other_punctuation unique_words unique_pairs same_as_before top_word "
    "upper_words plain_words unique_lines short_lines"
).split()
_SYMBOLS = b"#$%&*@^~+=<>_"


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; all zero for a null, empty or blank one."""
    found = (text or "").split()
    if not found:
        return np.zeros(len(NAMES))
    n = len(found)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = raw.sum()
    lower, upper, digits = raw[97:123].sum(), raw[65:91].sum(), raw[48:58].sum()
    symbols = raw[list(_SYMBOLS)].sum()
    named = raw[[46, 44, 33, 124]]
    spaces = raw[[9, 10, 11, 12, 13, 32]].sum()
    other = raw[33:127].sum() - lower - upper - digits - symbols - named.sum()
    lengths = np.fromiter(map(len, found), np.int64, n)
    pairs = max(n - 1, 1)
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(lines)),
            np.log1p(n / len(lines)),
            lengths.mean(),
            min(lengths.std(), 50.0),
            np.log1p(lengths.max()),
            lower / size,
            upper / size,
            digits / size,
            spaces / size,
            raw[128:].sum() / size,
            *(named / n),
            symbols / n,
            other / n,
            len(set(found)) / n,
            len(set(zip(found, found[1:]))) / pairs,
            sum(map(str.__eq__, found, found[1:])) / pairs,
            max(Counter(found).values()) / n,
            sum(map(str.isupper, found)) / n,
            sum(map(str.isalpha, found)) / n,
            len(set(lines)) / len(lines),
            sum(len(x) < 20 for x in lines) / len(lines),
        ]
    )


def pool_violators(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values to ``sums / weights`` in weighted squares."""
    blocks: list[list[float]] = []
    for total, weight in zip(sums, weights):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, count = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][2] += count
    return np.concatenate([np.full(int(count), total / weight) for total, weight, count in blocks])


@dataclass
class QualityModel:
    """What :func:`fit` learned; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, never falling with the raw score."""
        if not len(self.knots):
            return np.full(len(x), float(self.levels[0]))
        return np.interp(self.raw(x), self.knots, self.levels)

    def column(self, text: Column) -> Column:
        """The score of a text column, row by row in Arrow batches."""
        model = self

        @F.arrow_udf(T.DoubleType())
        def scored(column: pa.Array) -> pa.Array:
            rows = [statistics(t) for t in texts(column)]
            return pa.array(model.score(np.array(rows).reshape(-1, len(NAMES))))

        return scored(F.coalesce(text, F.lit("")))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) per document row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = np.array([statistics(t) for t in texts(batch.column(1))]).reshape(-1)
            stats = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES), pa.array(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, "id long, stats array<double>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Sums of f f' and f y over all rows of (stats, y), f with its constant; one row per matrix row travels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in small_batches(batches, 4096):
            f = model.features(_matrix(batch, "stats"))
            part = f.T @ np.hstack([f, batch.column("y").to_numpy(zero_copy_only=False).reshape(-1, 1)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"]
            )

    def meet(group: pa.Table) -> pa.Table:
        sums = np.vstack([np.asarray(r, float) for r in group.column("sums").to_pylist()]).sum(0)
        return pa.table({"i": group.column("i").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "i long, sums array<double>"
    partial = rows.select("stats", "y").mapInArrow(add, kind)
    found = partial.groupBy("i").applyInArrow(meet, kind).collect()
    return np.array([r["sums"] for r in sorted(found, key=lambda r: r["i"])])


def fit(
    stats: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    features: int = FEATURES,
    ridge: float = RIDGE,
    seed: int = SEED,
) -> QualityModel:
    """Learn from every row of ``stats`` (id, stats) that ``labels`` marks 0 or 1.

    A repeated label counts once, as the smallest of its values; null labels and ids are left out.
    Without both kinds of label the score is the share of ones, or 0.5 without any label.
    """
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    rows = stats.join(known.where("id is not null and y is not null"), "id").select("id", "stats", "y")
    rows = materialise(rows, "labelled-statistics")
    p = len(NAMES)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("y"),
        *[F.avg(F.get("stats", F.lit(k))).alias(f"m{k}") for k in range(p)],
        *[F.stddev_pop(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(p)],
    ).first()
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(p, features)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, features)
    empty = np.zeros(0)
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        share = 0.5 if not moments["n"] else moments["y"]
        return QualityModel(np.zeros(p), np.ones(p), turn, shift, np.zeros(features + 1), empty, np.array([share]))
    mean = np.array([moments[f"m{k}"] for k in range(p)])
    scale = np.array([moments[f"s{k}"] for k in range(p)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), turn, shift, np.zeros(features + 1), empty, empty)
    aside = F.pmod(F.xxhash64("id"), F.lit(CALIBRATION)) == 0
    sums = _normal_equations(rows.where(~aside), model)
    if not len(sums):
        sums = _normal_equations(rows, model)
    penalty = ridge * sums[-1, -2] * np.eye(features + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(sums[:, :-1] + penalty + 1e-9 * np.eye(features + 1), sums[:, -1])
    return _calibrate(rows, aside, model)


def _calibrate(rows: DataFrame, aside: Column, model: QualityModel) -> QualityModel:
    """Knots and levels from bins of the raw score: ``BINS`` counts reach the driver."""
    fitted = model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            place = np.clip((fitted.raw(_matrix(batch, "stats")) + 0.5) / 2, 0, 1)
            bins = np.minimum((place * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    def counted(part: DataFrame) -> list:
        bins = part.select("stats", "y").mapInArrow(binned, "bin long, y double")
        return sorted(bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect())

    found = counted(rows.where(aside)) or counted(rows)
    centers = (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5
    weights = np.array([float(r["n"]) for r in found])
    # Half a row of label 0 below all and of label 1 above all, so that the ends have a level.
    sums = np.array([0.0, *[r["y"] for r in found], 0.5])
    knots = np.array([centers[0] - 1 / BINS, *centers, centers[-1] + 1 / BINS])
    levels = pool_violators(sums, np.array([0.5, *weights, 0.5]))
    # The middle of each level, so that scores between two levels rise evenly.
    starts = np.flatnonzero(np.diff(levels, prepend=-1.0))
    stops = [*starts[1:], len(levels)]
    fitted.knots = np.array([knots[a:b].mean() for a, b in zip(starts, stops)])
    fitted.levels = levels[starts]
    return fitted


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score) per document row; labels are learned only from rows where ``learn`` (on ``id``) holds.

    Null and empty texts have statistics of zero and share a score; repeated rows score alike and equal
    scores stay equal; texts of any length are read whole. Null ids keep their row; null labels are not
    learned. Other columns are not read. An empty table gives no rows.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats.where(learn), labels, label_col, id_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(_matrix(batch, "stats")))], names=["id", "score"]
            )

    return stats.mapInArrow(score, "id long, score double").withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """``docs`` without the rows that score below ``least``, all columns kept.

    Null, empty and repeated texts are scored like any other, null ids too; an empty table stays
    empty. Texts do not travel: the fit meets labels with statistics, and the score is a column.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, label_col, id_col)
    return docs.where(model.column(F.col(text_col)) >= least)
