"""Nearest neighbours against a full scan, and the classifiers on rows they did not learn from."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import posting_lists, quality, queries, toxicity
from framelake.llm.common import table


def scan(ids, x, query, count):
    scores = x @ x[query]
    order = [k for k in np.lexsort((ids, -scores)) if ids[k] != ids[query]]
    return [(int(ids[k]), scores[k]) for k in order[:count]]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_neighbour_query(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    got = found(queries.op4_posting_lists(spark, sf).collect())
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == ids[asked].tolist()
    recall = []
    for k in asked:
        want = scan(ids, x, k, 20)
        have = got[ids[k]]
        assert [r for *_, r in have] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[np.searchsorted(ids, v)] @ x[k]), abs=1e-12) for v, s, _ in have)
        assert have == sorted(have, key=lambda h: (-h[1], h[0]))
        recall.append(len({v for v, *_ in have} & {v for v, _ in want}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_clusters_copies_and_lengths(spark, monkeypatch):
    """Small lists and blocks, a third of all rows equal, lengths that differ: recall over a full scan."""
    monkeypatch.setattr(posting_lists, "BLOCK", 40)
    monkeypatch.setattr(posting_lists, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    x[::3] = x[0]
    x[1::50] *= 5
    ids = rng.permutation(5000)[:900]
    vectors = spark.createDataFrame(
        [(int(i), v.tolist(), "r", 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rep string, list int"
    )
    got = found(posting_lists.nearest(vectors, asked=F.col("id") % 5 == 0, list_size=32).collect())
    recall = []
    for k in np.flatnonzero(ids % 5 == 0):
        want = scan(ids, x, k, 20)
        have = got[ids[k]]
        assert len(have) == 20 and ids[k] not in [v for v, *_ in have]
        # Equal scores are interchangeable for recall, but among equal vectors the smallest ids come first.
        recall.append(sum(s >= want[-1][1] - 1e-9 for _, s, _ in have) / 20)
    assert np.mean(recall) >= 0.9
    copy = sorted(ids[(x == x[0]).all(1)].tolist())
    own = next(i for i in copy if i % 5 == 0)
    same = [v for v, s, _ in got[own] if v in set(copy)]
    assert same == [i for i in copy if i != own][: len(same)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.0, 2.0]), (0, [1.0, 0.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    got = found(posting_lists.nearest(vectors, asked=F.col("id") % 20 == 0).collect())
    assert {k: [v for v, *_ in r] for k, r in got.items()} == {0: [20, 3], 20: [0, 3]}
    assert posting_lists.nearest(vectors.limit(0), asked=F.lit(True)).count() == 0
    only = vectors.where("vec_id in (40, 60)")
    assert posting_lists.nearest(only, asked=F.lit(True)).count() == 0


def plain_nearest(rows, wanted, count):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in wanted:
        scores = (x * x[ids == q][0]).sum(1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:count]
        out[q] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def test_every_query_has_all_its_rows(spark):
    """A few far vectors make lists of their own; queries there read on until they have twenty rows."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(3000)]
    rows += [(3000 + k, (50 * rng.normal(size=16)).tolist()) for k in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in posting_lists.nearest(vectors, asked=F.col("id") % 20 == 0, list_size=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    asked = [k for k, _ in rows if k % 20 == 0]
    assert sorted(got) == asked
    assert all([r for r, _ in sorted(v)] == list(range(1, 21)) for v in got.values())
    few = spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>")
    assert posting_lists.nearest(few, asked=F.lit(True)).count() == 7 * 6


def test_ties_go_to_the_smaller_id(spark):
    """Hundreds of equal products at the edge; block products round them differently."""
    rng = np.random.default_rng(9)
    axis = np.zeros(24)
    axis[0] = 1.0
    rest = rng.normal(size=(400, 23))
    rows = [(0, axis.tolist())] + [(k + 1, [0.1, *v]) for k, v in enumerate(rest.tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = posting_lists.nearest(vectors, asked=F.col("id") == 0, list_size=1000).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == plain_nearest(rows, [0], 20)[0] == [(k, 0.1) for k in range(1, 21)]


def test_a_query_comes_once_to_the_lists_of_a_bundle(spark, monkeypatch):
    """Where lists do not prune, a row for each list that a query reads is most of the table for each query."""
    kept, real = {}, posting_lists.materialise

    def seen(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(posting_lists, "materialise", seen)
    x = np.random.default_rng(4).normal(size=(3000, 32))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(posting_lists.nearest(vectors, asked=F.col("id") % 100 == 0, list_size=4).collect())
    lists = kept["posting-lists"].select("list").distinct().count()
    rows = kept["list-probes"].groupBy("rep").count().agg(F.max("count")).first()[0]
    assert lists > 500 and rows < lists / 5
    want = {k: {v for v, _ in scan(np.arange(3000), x, k, 20)} for k in range(0, 3000, 100)}
    assert np.mean([len({v for v, *_ in got[k]} & want[k]) / 20 for k in want]) >= 0.9


def test_bundles_hold_all_parts_of_all_lists():
    counts = np.array([0, 5, 5, 30, 1, 0, 9, 10, 2])
    first, parts = posting_lists._bundles(counts, np.arange(9), 10)
    assert parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 4, 5, 6]


def test_wide_walk_finds_near_centroids():
    rng = np.random.default_rng(6)
    graph = posting_lists.CentroidGraph.build(rng.normal(size=(500, 8)))
    asked = rng.normal(size=(40, 8))
    places, gaps = graph.search(asked, 200)
    true = np.sqrt(posting_lists._distances(asked, graph.centroids))
    assert np.allclose(np.take_along_axis(true, places, 1), gaps) and (np.diff(gaps, axis=1) >= 0).all()
    near = true.argsort(1)[:, :200]
    assert np.mean([len(set(a) & set(b)) / 200 for a, b in zip(places.tolist(), near.tolist())]) > 0.95
    assert (graph.search(asked, 500)[0] >= 0).all()


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(300, 8))
    graph = posting_lists.CentroidGraph.build(centers)
    queries_ = rng.normal(size=(50, 8))
    places, gaps = graph.search(queries_, 32)
    true = np.sqrt(posting_lists._distances(queries_, centers)).argsort(1)[:, :8]
    assert np.mean([len(set(p) & set(t)) / 8 for p, t in zip(places, true)]) > 0.95
    assert (np.diff(gaps, axis=1) >= 0).all()


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 4))
    assert len(posting_lists.balanced_centroids(x, 30)) == 30
    assert len(posting_lists.balanced_centroids(np.ones((40, 3)), 9)) == 9


# --- classifiers -------------------------------------------------------------------------------


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,mod,rest,least,floor", [("op8_quality", "quality", 3, 1, 0.5, 0.97), ("op10_toxicity", "toxic", 4, 2, 0.3, 0.7)])
def test_classifier_queries(spark, name, label, mod, rest, least, floor):
    labels = {r["doc_id"]: r[label] for r in table(spark, MID, "labels").collect()}
    rows = queries.QUERIES[name](spark, MID).collect()
    assert len(rows) == table(spark, MID, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*np.array(held).T) > floor


def test_pooling_is_monotone_and_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(20):
        weights = rng.integers(1, 5, 12).astype(float)
        values = rng.random(12)
        got = quality.pool_violators(values * weights, weights)
        assert (np.diff(got) >= -1e-12).all()
        blocks = np.split(np.arange(12), np.flatnonzero(np.diff(got) > 1e-12) + 1)
        for b in blocks:
            assert got[b[0]] == pytest.approx(np.average(values[b], weights=weights[b]))


def test_sums_over_tasks_are_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, len(quality.NAMES)))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, stats array<double>, y double")
    p = len(quality.NAMES)
    model = quality.QualityModel(np.zeros(p), np.ones(p), rng.normal(size=(p, 6)), rng.random(6), None, None, None)
    f = model.features(x)
    want = np.hstack([f.T @ f, (f.T @ y)[:, None]])
    for parts in (1, 7):
        assert np.allclose(quality._normal_equations(rows.repartition(parts), model), want)


def test_features_approximate_the_gaussian_kernel():
    p, rng = len(quality.NAMES), np.random.default_rng(5)
    model = quality.QualityModel(
        np.zeros(p), np.ones(p), rng.normal(size=(p, 20_000)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, 20_000), None, None, None
    )
    x = rng.normal(size=(6, p))
    f = model.features(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(2) / p
    assert np.abs(f @ f.T - np.exp(-gap / 2)).max() < 0.05


def toy(spark):
    clean = ["the cat sat on a mat and looked at birds in the trees", "rain fell on the old town while people walked home"]
    nasty = ["you horrible snorkwad go away", "such a snorkwad and a snorkwadder you are"]
    rows = [(k, clean[k % 2] + f" number {k}", 1, 0) for k in range(80)] + [(100 + k, nasty[k % 2] + f" item {k}", 1, 1) for k in range(40)]
    rows += [(200 + k, "!!! $$$ " * 30 + f"{k}", 0, 0) for k in range(30)]
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    return [(i, t) for i, t, *_ in rows], labels


def test_filters_on_odd_rows(spark):
    rows, labels = toy(spark)
    odd = [(900, "what a snorkwadish thing"), (901, None), (902, ""), (None, "the cat sat on a mat in the town"), (903, "$$$ !!! " * 40), (5, "the cat again")]
    docs = spark.createDataFrame([(*r, "e", 0.5) for r in rows + odd], "doc_id long, text string, stats string, score double")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {901, 902, None, 3, 5} <= ids and not ids & {100, 101, 900}
    good = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert {3, 5, 100} <= good and not good & {200, 903}
    for filtered in (toxicity.drop_toxic, quality.keep_good):
        assert filtered(docs.limit(0), labels).count() == 0
        assert filtered(docs, labels.limit(0)).count() in (0, docs.count())


def test_misspellings_share_ngrams():
    words = [("you total snorkwad", 1), ("a snorkwads crowd", 1), ("the old town hall", 0), ("rain on the roof", 0)] * 12
    model = toxicity.train(words, steps=2000)
    assert model.score("some snorkwaddd here") > model.score("some garden here")


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"word{k}" for k in range(500))
    model = toxicity.ToxicityModel(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), 0.1)
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "_WORDS", 7)
    # Parts hold no n-gram over two words, as the whole does not.
    assert model.score(text) == pytest.approx(whole, abs=1e-6)


def test_training_texts_are_not_kept_and_bags_lie_in_blocks(monkeypatch):
    """Texts that come one by one train the same model, over blocks that some bags fill and one exceeds."""
    import gc
    import weakref

    class Text(str):
        pass

    words = ["good plain words here", "bad nasty things said", ""]
    rows = [(" ".join([words[k % 3], f"w{k}", *(f"x{j}y" for j in range(60 if k == 7 else 2))]), int(k % 3 == 1)) for k in range(40)]
    want = toxicity.train(rows, steps=200)
    alive, most = weakref.WeakSet(), 0

    def read():
        nonlocal most
        for text, _ in rows:
            held = Text(text)
            alive.add(held)
            yield held
            del held
            gc.collect()
            most = max(most, len(alive))

    monkeypatch.setattr(toxicity, "_BLOCK", 300)
    got = toxicity._train(read(), np.array([y for _, y in rows]), steps=200)
    assert most <= 2
    assert (got.logits == want.logits).all() and got.bias == want.bias
    blocks = {id(b[0].base) for b in toxicity._packed(toxicity.bag(t) for t, _ in rows)}
    assert 2 <= len(blocks) < 20
