from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from framelake import HeadModel, embeddings, make_head
from framelake.operators import gram, heads
from framelake.operators.gram import collect_gram, gram_rows
from framelake.operators.heads import BUILDERS, fit_per_group, predict_per_group
from framelake.operators.latency import embed_latency, head_latency, numpy_scorer
from framelake.operators.pca import fit_pca
from framelake.sources.prediction_stream import predict_stream, read_stream_predictions, write_batch
from framelake.operators.scaling import SCALED, VECTOR, PopulationScaler, scale, scaler_stats, with_vector
from registry.vectors import QUERIES


def local(rows):
    got = rows.select("features", "y").collect()
    return np.array([r["features"] for r in got], dtype=float), np.array([r["y"] for r in got])


def standardised(x, ref):
    std = ref.std(0)
    return (x - ref.mean(0)) / np.where(std == 0, 1, std)


@pytest.fixture(scope="module")
def noisy(spark):
    """Overlapping classes, so that heads differ in what they predict."""
    rng = np.random.default_rng(3)
    y = rng.integers(1, 5, 400)
    x = rng.normal(0, 1, (400, 6)) + np.eye(6)[y] * 1.2
    x[:, 5] = 7.0
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "frame_idx long, features array<double>, y int")


def test_scaler_matches_the_population_deviation(spark, noisy):
    x, _ = local(noisy)
    model = PopulationScaler().fit(with_vector(noisy).select(VECTOR))
    got = scale(with_vector(noisy), model).select("frame_idx", vector_to_array(SCALED)).orderBy("frame_idx")
    assert np.allclose([r[1] for r in got.collect()], standardised(x, x), atol=1e-9)
    stats = scaler_stats(noisy).orderBy("dim").collect()
    assert np.allclose([r["std"] for r in stats], x.std(0))
    assert np.allclose([r["mean"] for r in stats], x.mean(0))


@pytest.mark.parametrize("partitions", [1, 5])
def test_gram(spark, noisy, partitions):
    x, _ = local(noisy)
    rows = noisy.repartition(partitions)
    assert np.allclose(collect_gram(rows, "features", 6), x.T @ x)


def test_gram_of_nothing(spark, noisy):
    assert gram_rows(noisy.where("false"), "features").count() == 0


def test_gram_keeps_the_tasks_of_the_scan(spark, noisy):
    plan = gram_rows(noisy.repartition(40), "features")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan


def test_partial_matrices_meet_in_buckets(noisy, monkeypatch):
    x, _ = local(noisy)
    monkeypatch.setattr(gram, "BUCKETS", 3)
    assert np.allclose(collect_gram(noisy.repartition(11), "features", 6), x.T @ x)


def test_heads_of_groups_come_from_one_pass(spark, noisy):
    grouped = noisy.withColumn("place", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("frame_idx") % 3 + 1).cast("int")))
    models = fit_per_group(grouped, make_head("linear", alpha=2.0), "place", ("a", "b"))
    for g in ("a", "b"):
        alone = make_head("linear", alpha=2.0).fit(grouped.where(F.col("place") == g))
        rows = grouped.orderBy("frame_idx")
        got, want = ([r["scores"] for r in m.scores(rows).orderBy("frame_idx").collect()] for m in (models[g], alone))
        assert np.allclose(got, want, atol=1e-4)
    predicted = predict_per_group(grouped, models, "place")
    assert predicted.count() == grouped.count()
    assert predicted.where("place = 'c'").where("y_pred IS NOT NULL").isEmpty()
    assert predicted.where("place <> 'c'").where("y_pred IS NULL").isEmpty()
    with pytest.raises(ValueError, match="no labels"):
        fit_per_group(grouped, make_head("linear"), "place", ("a", "nowhere"))


def test_wide_features_have_no_bound(spark):
    rows = spark.range(40).selectExpr("transform(sequence(1, 300), i -> double((id * i) % 7)) AS features", "int(id % 2) AS y")
    assert make_head("linear").fit(rows).weights.shape == (301, 2)


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_matches_the_closed_form(noisy, alpha):
    x, y = local(noisy)
    xs = standardised(x, x)
    classes = sorted(set(y))
    t = np.where(y[:, None] == classes, 1.0, -1.0)
    w = np.linalg.solve(xs.T @ xs + alpha * np.eye(6), xs.T @ (t - t.mean(0)))
    scores = xs @ w + t.mean(0)
    model = make_head("linear", alpha=alpha).fit(noisy)
    got = model.scores(noisy).orderBy("frame_idx").collect()
    assert np.allclose([r["scores"] for r in got], scores, atol=1e-4)
    want = np.array(classes)[scores.argmax(1)]
    assert [r["y_pred"] for r in model.predict(noisy).orderBy("frame_idx").collect()] == want.tolist()


@pytest.mark.parametrize("C", [1.0, 0.01])
def test_logreg_reaches_the_optimum(noisy, C):
    """The gradient of sum(log loss) + |w|^2 / (2 C) vanishes at the fitted weights."""
    x, y = local(noisy)
    model = make_head("logreg", C=C, tol=1e-9).fit(noisy)
    w = model.classifier.coefficientMatrix.toArray()
    b = model.classifier.interceptVector.toArray()
    xs = standardised(x, x)
    z = x @ w.T + b
    w = w * x.std(0)  # the weights on standardised features, which the penalty is about
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    t = (y[:, None] == np.array(model.classes)).astype(float)
    gradient = (p - t).T @ xs + w / C
    assert np.abs(gradient).max() / len(y) < 1e-4


@pytest.mark.parametrize("name", ["linear", "logreg", "mlp"])
def test_save_and_load(spark, noisy, tmp_path, name):
    params = {"max_iter": 20} if name != "linear" else {}
    model = make_head(name, **params).fit(noisy, fm="org/m", revision="007")
    model.save(str(tmp_path / "head"))
    back = HeadModel.load(spark, str(tmp_path / "head"))
    assert (back.name, back.classes, back.meta) == (name, (1, 2, 3, 4), {"fm": "org/m", "revision": "007"})
    a = model.predict(noisy).orderBy("frame_idx").collect()
    b = back.predict(noisy).orderBy("frame_idx").collect()
    assert a == b


@pytest.mark.parametrize("name", ["linear", "logreg", "mlp"])
def test_labels_need_not_start_at_one(noisy, name):
    params = {"max_iter": 20} if name != "linear" else {}
    rows = noisy.where("y <> 2").withColumn("y", F.expr("y * 100 - 250"))
    model = make_head(name, **params).fit(rows)
    assert model.classes == (-150, 50, 150)
    got = {r["y_pred"] for r in model.predict(rows).select("y_pred").distinct().collect()}
    assert got <= {-150, 50, 150} and len(got) > 1


def test_two_classes(noisy):
    rows = noisy.where("y <= 2")
    model = make_head("linear").fit(rows)
    hits = model.predict(rows).selectExpr("avg(double(y = y_pred))").first()[0]
    assert hits > 0.6


def test_mlp_without_early_stopping_and_with_two_layers(noisy):
    model = make_head("mlp", early_stopping=False, max_iter=15, hidden_layer_sizes=(8, 4)).fit(noisy)
    hits = model.predict(noisy).selectExpr("avg(double(y = y_pred))").first()[0]
    assert hits > 0.4


def test_registry(noisy):
    with pytest.raises(ValueError, match=r"no head is called 'forest'.*\['linear', 'logreg', 'mlp'\]"):
        make_head("forest")
    with pytest.raises(TypeError):
        make_head("linear", depth=3).fit(noisy)
    assert sorted(BUILDERS) == ["linear", "logreg", "mlp"]


def test_any_number_of_labels(spark):
    rows = spark.range(1005).selectExpr("array(double(id)) AS features", "int(id) AS y")
    assert len(make_head("linear").fit(rows).classes) == 1005


@pytest.mark.parametrize("name", ["linear", "logreg"])
def test_prediction_is_row_wise_and_streams(spark, cache, tmp_path, name):
    """Frames that arrive in files one by one get the same class as in one batch."""
    train = embeddings(spark, "synthetic", "train", root=cache)
    test = embeddings(spark, "synthetic", "test", root=cache).df
    model = make_head(name).fit(train.df)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    test.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        model.predict(stream).select("frame_idx", "y_pred").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(sink)
    )
    query.awaitTermination(120)
    want = model.predict(test).select("frame_idx", "y_pred")
    got = spark.read.parquet(sink)
    assert got.count() == 256
    assert got.exceptAll(want).isEmpty()


def test_training_set_is_released(spark, noisy):
    make_head("linear").fit(noisy)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_pca_takes_the_largest_components(noisy):
    x, y = local(noisy)
    z = standardised(x, x)
    pca = fit_pca(noisy, 3)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    assert np.allclose(pca.variances, values[:3]) and pca.variances[-1] > values[3]
    got, labels = local(pca.transform(noisy).orderBy("frame_idx"))
    assert np.allclose(got, z @ pca.components, atol=1e-5) and (labels == y).all()
    assert np.allclose(got.var(0), values[:3], atol=1e-4)


def test_head_on_components(noisy):
    x, y = local(noisy)
    pca = fit_pca(noisy, 3)
    rows = make_head("linear").fit(pca.transform(noisy)).predict(pca.transform(noisy)).orderBy("frame_idx").collect()
    z = standardised(x, x)
    left, _, _ = np.linalg.svd(z, full_matrices=False)
    white = left[:, :3] * np.sqrt(len(z))
    classes = np.unique(y)
    target = np.where(y[:, None] == classes, 1.0, -1.0)
    scores = white @ (white.T @ target) / (len(z) + 1) + target.mean(0)
    assert [r["y_pred"] for r in rows] == classes[scores.argmax(1)].tolist()


def test_a_batch_that_runs_again_leaves_one_row_per_frame(spark, noisy, tmp_path):
    source, out, checkpoint = (str(tmp_path / k) for k in ("source", "out", "checkpoint"))
    noisy.drop("y").repartition(3).write.parquet(source)
    model = make_head("linear").fit(noisy)
    want = {r["frame_idx"]: r["y_pred"] for r in model.predict(noisy).collect()}
    frames = spark.readStream.schema(noisy.drop("y").schema).option("maxFilesPerTrigger", 1).parquet(source)

    def seen():
        rows = read_stream_predictions(spark, out).collect()
        assert len(rows) == len({r["frame_idx"] for r in rows})
        return {r["frame_idx"]: r["y_pred"] for r in rows}

    assert seen() == {}
    predict_stream(frames, model.predict, out, checkpoint).awaitTermination()
    assert seen() == want
    # The checkpoint of the last batch is lost, as if the query had died behind its folder.
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    predict_stream(frames, model.predict, out, checkpoint).awaitTermination()
    assert seen() == want and len(list((tmp_path / "out").glob("batch=*"))) == 3
    # A later batch may hold a frame again.
    write_batch(spark.createDataFrame([(0, 9)], "frame_idx long, y_pred int"), 3, out)
    assert seen() == want | {0: 9}


def test_logistic_heads_of_all_groups_come_from_common_passes(spark, noisy, monkeypatch):
    from framelake.operators import grouped_logreg

    passes = []
    real = grouped_logreg.losses
    monkeypatch.setattr(grouped_logreg, "losses", lambda rows, trials, scales: passes.append(set(trials)) or real(rows, trials, scales))
    place = F.when(F.col("frame_idx") % 3 == 0, "a").when(F.col("frame_idx") % 3 == 1, "b").otherwise("c")
    # One group lacks a class.
    grouped = noisy.withColumn("place", place).where("place != 'c' OR y != 2")
    models = fit_per_group(grouped, make_head("logreg", C=0.5, tol=1e-8), "place", ("a", "b", "c"))
    assert models["c"].classes == (1, 3, 4) and models["a"].classes == (1, 2, 3, 4)
    assert passes[0] == {"a", "b", "c"} and len(passes) < 80
    for g, model in models.items():
        rows = grouped.where(F.col("place") == g)
        x, y = local(rows)
        z = standardised(x, x)
        n, std = len(x), x.std(0)
        score = x @ model.weights[:-1] + model.weights[-1]
        p = np.exp(score - score.max(1, keepdims=True))
        gap = p / p.sum(1, keepdims=True) - (y[:, None] == np.array(model.classes))
        gradient = z.T @ gap / n + model.weights[:-1] * std[:, None] / (0.5 * n)
        assert np.abs(gradient).max() < 1e-6 and np.abs(gap.mean(0)).max() < 1e-6
        alone = make_head("logreg", C=0.5, tol=1e-9).fit(rows)
        both = [[r["y_pred"] for r in m.predict(rows).orderBy("frame_idx").collect()] for m in (model, alone)]
        assert np.mean(np.array(both[0]) == np.array(both[1])) > 0.99
    # A single group takes as many passes as it took among the others.
    among = sum("b" in p for p in passes)
    passes.clear()
    fit_per_group(grouped, make_head("logreg", C=0.5, tol=1e-8), "place", ("b",))
    assert len(passes) == among
    with pytest.raises(ValueError, match="no labels"):
        fit_per_group(grouped, make_head("logreg"), "place", ("a", "nowhere"))


@pytest.mark.parametrize("name", ["linear", "logreg", "mlp"])
def test_scores_by_the_weights_of_a_head(noisy, name):
    model = make_head(name, seed=1).fit(noisy)
    x, _ = local(noisy.orderBy("frame_idx"))
    best = np.array(model.classes)[numpy_scorer(model)(x).argmax(1)]
    assert np.mean(best == [r["y_pred"] for r in model.predict(noisy).orderBy("frame_idx").collect()]) > 0.99


def test_latency_is_that_of_the_model(spark, noisy):
    """A stand-in of 2 ms per window, one window in four slower; loading it takes long and does not count."""
    from framelake.constants import CHANNELS

    cells = [f"array({k}f, cast(id AS float)) AS {c}" for k, c in enumerate(CHANNELS)]
    frames = spark.range(400).selectExpr("id AS frame_idx", *cells).repartition(4)

    def load():
        import time

        time.sleep(1.0)

        def embed(block):
            time.sleep(sum(0.012 if b[0, 1] % 4 == 0 else 0.002 for b in block))
            return block.mean(2)

        return embed

    one = embed_latency(frames, load, n_samples=2, batch_rows=1).first()
    assert one["n"] == 400 and 2.0 <= one["p50_ms"] < 8 and 12.0 <= one["p95_ms"] < 30 and 4.4 <= one["mean_ms"] < 12
    many = embed_latency(frames, load, n_samples=2, batch_rows=50).first()
    assert many["n"] == 400 and 3.0 <= many["p50_ms"] < 12
    none = embed_latency(frames.limit(0), load, n_samples=2).first()
    assert none["n"] == 0 and none["p50_ms"] is None
    head = head_latency(make_head("linear").fit(noisy), noisy).first()
    assert head["n"] == 400 and 0 < head["p50_ms"] <= head["p95_ms"] < 100


def test_the_perceptron_trains_on_all_cores(spark, noisy, monkeypatch):
    """A training set of one file is dealt out; a small one takes no more tasks than it has work for."""
    tasks = []

    class Watched(heads.MultilayerPerceptronClassifier):
        def _fit(self, dataset):
            tasks.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(heads, "MultilayerPerceptronClassifier", Watched)
    for rows in (1, 100, 2048):
        monkeypatch.setattr(heads, "STEP_ROWS", rows, raising=False)
        for early_stopping in (True, False):
            make_head("mlp", early_stopping=early_stopping, max_iter=1).fit(noisy.coalesce(1))
    cores = spark.sparkContext.defaultParallelism
    assert tasks == [cores, cores, min(4, cores), min(4, cores), 1, 1]


def test_the_forward_pass_takes_each_layer_once(spark, sf):
    """What stands inside the lambda over the units would be evaluated for every unit."""
    plan = QUERIES["head_mlp"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    inputs = re.findall(r"zip_with\(lambda \w+#\d+, (\w+)", plan)
    assert inputs == ["lambda"] * 2
    assert "Repartition" in plan
