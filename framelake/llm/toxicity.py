"""A toxicity score from subword embeddings averaged into a linear softmax.

A word stands for its character n-grams with a mark at both ends, each hashed to one of ``BUCKETS``
embeddings, so a misspelt or unseen word shares vectors with the words it resembles. The embeddings of
a text's distinct words are averaged (a word said a hundred times counts once); embeddings and softmax are trained together in numpy on a bounded
sample of labelled rows. Since the softmax is linear, a trained model folds into one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 19
DIM = 8
#: Training takes so many steps, or goes three times over all texts if that is more.
STEPS = 16_000
RATE = 10.0
#: N-grams of no weight that every text has besides its own, so that a few words are no strong evidence.
NEUTRAL = 100.0
SEED = 11
#: Steps fall with this power of an embedding's squared gradients so far.
POWER = 0.25
#: Training texts that have to share an n-gram before it gets a vector.
LEAST_TEXTS = 3
#: One of so many training texts scales the log odds instead.
ASIDE = 5
#: Labelled rows that training may use, at most; those with the smallest hash of their id.
TRAIN_ROWS = 7000
#: Distinct words of a text that are hashed at once.
_WORDS = 1 << 16
#: Entries of bags that are held in one block of memory, which goes back to the system as a whole.
_BLOCK = 1 << 24
#: The weight of an n-gram by the number of distinct words that have it.
_GROWN = (np.arange(256) ** 0.75).astype(np.float32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, with one zero at each end and zeros for what is no letter or digit."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    low = codes < 128
    plain = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    codes = np.where(low & ~plain, np.uint64(0), codes)
    return np.concatenate([np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)])


def ngrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all n-grams of a text's words, in no order; repeats included."""
    codes = _letters(text)
    letter = codes != 0
    found = []
    rolled, whole = codes, np.ones(len(codes), bool)
    for n in range(2, GRAMS[-1] + 1):
        if len(codes) < n:
            break
        if n > 2:
            # What was the last place is inside the n-gram now and has to be a letter.
            whole = whole[:-1] & letter[n - 2 : len(codes) - 1]
        else:
            whole = whole[:-1]
        rolled = rolled[:-1] * _PRIME + codes[n - 1 :]
        if n in GRAMS:
            mixed = rolled[whole] * _PRIME
            found.append((mixed ^ (mixed >> np.uint64(29))) * _PRIME >> np.uint64(40))
    return (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64) if found else np.zeros(0, np.int64)


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the n-grams of a whole text's distinct words, and in how many of them each occurs.

    Counts end at 255. Beyond ``_WORDS`` words the counts of parts are added up per bucket.
    """
    found = list(set((text or "").lower().split()))
    if len(found) > _WORDS:
        total = np.zeros(buckets, np.int64)
        for start in range(0, len(found), _WORDS):
            total += np.bincount(ngrams(" ".join(found[start : start + _WORDS]), buckets), minlength=buckets)
        ids = np.flatnonzero(total)
        return ids.astype(np.int32), np.minimum(total[ids], 255).astype(np.uint8)
    ids = np.sort(ngrams(" ".join(found), buckets).astype(np.int32))
    if not len(ids):
        return ids, np.zeros(0, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], np.minimum(np.diff(starts, append=len(ids)), 255).astype(np.uint8)


def _packed(bags: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags one behind the other in a few large blocks, not as thousands of arrays whose memory stays in pieces."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = end = 0
    for ids, counts in bags:
        if at + len(ids) > end:
            at, end = 0, max(_BLOCK, len(ids))
            # Pages that are not written take no memory.
            block = np.empty(end, np.int32), np.empty(end, np.uint8)
        if len(ids):
            held = block[0][at : at + len(ids)], block[1][at : at + len(ids)]
            held[0][:], held[1][:] = ids, counts
            at += len(ids)
            out.append(held)
        else:
            out.append((ids, counts))
    return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    """What each bucket adds to the average; repeats count less and less, and ``NEUTRAL`` n-grams nothing."""
    grown = _GROWN[counts]
    return grown / np.float32(grown.sum() + NEUTRAL)


@dataclass
class ToxicityModel:
    """One number per bucket and a bias: the folded embeddings and softmax, scaled to probabilities."""

    logits: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability of label 1; a text without n-grams has the bias alone."""
        ids, counts = bag(text, len(self.logits))
        mean = float(weights_of(counts) @ self.logits[ids])
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))))

    def column(self, text: Column) -> Column:
        """The score of a text column, row by row in Arrow batches."""
        model = self

        @F.arrow_udf(T.DoubleType())
        def scored(column: pa.Array) -> pa.Array:
            return pa.array([model.score(t) for t in texts(column)], pa.float64())

        return scored(F.coalesce(text, F.lit("")))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias that make ``z`` log odds of ``y``, by Newton's method with a light penalty."""
    spread = max(float(np.std(z)), 1e-6)
    x = np.stack([z / spread, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.01 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), slope)
        w -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def train(
    rows: list[tuple[str, int]],
    buckets: int = BUCKETS,
    dim: int = DIM,
    steps: int = STEPS,
    rate: float = RATE,
    seed: int = SEED,
) -> ToxicityModel:
    """Embeddings and softmax by stochastic gradient descent, one text at a step with falling steps.

    One of ``ASIDE`` texts is set aside to scale the log odds. Without texts of both kinds the score is the
    share of ones, or 0.5 without any text.
    """
    labels = np.array([y for _, y in rows], int)
    return _train((text for text, _ in rows), labels, buckets, dim, steps, rate, seed)


def _train(
    read: Iterable[str],
    labels: np.ndarray,
    buckets: int = BUCKETS,
    dim: int = DIM,
    steps: int = STEPS,
    rate: float = RATE,
    seed: int = SEED,
) -> ToxicityModel:
    """:func:`train` on texts that come one by one and are not kept."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return ToxicityModel(np.zeros(buckets, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # Five bytes a bucket; the weights are made anew at each step.
    counted = _packed(bag(text, buckets) for text in read)
    places = rng.permutation(len(labels))
    # Every ASIDE-th text of each label.
    aside = np.concatenate([places[labels[places] == k][::ASIDE] for k in (0, 1)])
    fitted = np.setdiff1d(places, aside)
    if len(np.unique(labels[fitted])) < 2:
        fitted = aside = places
    table = np.empty((buckets, dim), np.float32)
    for start in range(0, buckets, _WORDS):
        part = table[start : start + _WORDS]
        part[:] = rng.uniform(-1 / dim, 1 / dim, part.shape)
    # What few texts have tells them apart and not their labels: it keeps the zero vector.
    holding = np.zeros(buckets, np.int32)
    for k in fitted:
        # The buckets of a bag are distinct.
        holding[counted[k][0]] += 1
    shared = holding >= LEAST_TEXTS
    table[~shared] = 0
    whole = [float(_GROWN[n].sum()) + NEUTRAL for _, n in counted]
    for k, (ids, n) in enumerate(counted):
        kept = shared[ids]
        size = int(kept.sum())
        ids[:size], n[:size] = ids[kept], n[kept]
        counted[k] = ids[:size], n[:size]
    soft = np.zeros((2, dim), np.float32)
    soft[1] = rng.normal(size=dim)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    # Squared gradients so far: frequent n-grams take smaller steps.
    seen = np.full(buckets, 1e-8, np.float32)
    seen_soft = np.full((2, dim), 1e-8, np.float32)
    for _ in range(max(3, -(-steps // len(fitted)))):
        for at in rng.permutation(fitted):
            ids, n = counted[at]
            weights = _GROWN[n] / np.float32(whole[at])
            hidden = weights @ table[ids]
            z = soft @ hidden + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[at]] -= 1
            step = weights[:, None] * (soft.T @ error)
            seen[ids] += (step * step).mean(1)
            table[ids] -= step * (rate / seen[ids] ** POWER)[:, None]
            push = np.outer(error, hidden)
            seen_soft += push * push
            soft -= rate * 0.1 * push / np.sqrt(seen_soft)
            bias -= 0.01 * error
    logits = (table @ (soft[1] - soft[0])).astype(np.float32)
    slope, level = _platt(np.array([_GROWN[counted[k][1]] @ logits[counted[k][0]] / whole[k] for k in aside]), labels[aside])
    return ToxicityModel(logits * np.float32(slope), level)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = TRAIN_ROWS,
) -> ToxicityModel:
    """Train on the whole texts of at most ``most`` documents that ``labels`` marks 0 or 1.

    With more of them, those with the smallest hash of their id are taken; ids are chosen before any
    text is read. A repeated label counts once, as the larger of its values; of rows that repeat an id one
    text is taken. Null labels and ids are left out.
    """
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where("id is not null and y is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = known.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    met = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = met.orderBy("id").select("text", "y").toArrow()
    return _train((t.as_py() for t in found.column("text")), found.column("y").to_numpy().astype(int))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score) per document row; labels are learned only from rows where ``learn`` holds.

    Null and empty texts score the bias, repeated rows alike; an empty table gives no rows. Texts of any
    length are read whole: a distinct word counts once. Other columns are not read.
    """
    model = fit(docs.where(learn), labels, label_col, id_col, text_col)
    return docs.select(F.col(id_col), model.column(F.col(text_col)).alias("score"))


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.3,
) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more, all columns kept; an empty table stays empty."""
    model = fit(docs, labels, label_col, id_col, text_col)
    return docs.where(model.column(F.col(text_col)) < least)
