"""Queries over the vector cache, feature statistics and heads."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from framelake.constants import TRAIN_LOCATIONS
from framelake.operators.evaluation import evaluate_by, predicted_pairs
from framelake.operators.fusion import fuse_models
from framelake.operators.gram import gram_matrix, gram_rows
from framelake.operators.heads import HeadModel, fit_per_group, make_head, predict_per_group
from framelake.operators.leaderboard import run_table
from framelake.operators.metrics import score
from framelake.operators.pca import fit_pca
from framelake.operators.scaling import (
    SCALED,
    VECTOR,
    PopulationScaler,
    scale,
    scaler_stats,
    vector_mean,
    with_vector,
)
from framelake.operators.synthetic import synthetic_vectors
from framelake.plans import jobs
from framelake.session import dealt
from framelake.sources.prediction_stream import predict_stream, read_stream_predictions, write_batch
from framelake.sources.runs import read_experiments, read_run_metrics, read_runs
from framelake.sources.vector_cache import (
    catalog,
    drop_partial_labels,
    embeddings,
    label_set,
    logged_shape,
    read_cache,
    revisions,
    select_slice,
    slice_log,
)
from pyspark.ml.functions import vector_to_array

from .views import EMB, cache_path, emb, once, with_cte


def _cells():
    return F.posexplode("features").alias("dim", "value")


def _exact(rows):
    return rows.withColumn("value", F.col("value").cast("double"))


def cached(spark, sf):
    return read_cache(spark, cache_path(spark, sf))


def logged(spark, sf):
    return slice_log(spark, cache_path(spark, sf))


def emb_scan(spark, sf):
    rows = embeddings(spark, "fixture", "train", "Bag", root=cache_path(spark, sf)).df
    return rows.select("frame_idx", "y", _cells()).withColumn("value", F.col("value").cast("double"))


def emb_scan_location(spark, sf):
    rows = select_slice(cached(spark, sf), "fixture", "v1", "validation", "Torso")
    return _exact(rows.select("location", "frame_idx", "y", _cells()))


def emb_scan_test(spark, sf):
    rows = select_slice(cached(spark, sf), "fixture", "v1", "test", "Bag")
    return _exact(rows.select("location", "frame_idx", "y", _cells()))


def emb_scan_defaults(spark, sf):
    rows = select_slice(cached(spark, sf), "fixture", "v1", "train")
    return rows.groupBy("location", "pooling").agg(F.count(F.lit(1)).alias("n"))


def emb_pooled(spark, sf):
    rows = select_slice(cached(spark, sf), "fixture", "v1", "train")
    part = rows.withColumn("y", F.when(F.col("location") != "Hips", F.col("y")))
    whole = drop_partial_labels(rows).withColumn("labels", F.lit("all"))
    gap = drop_partial_labels(part).withColumn("labels", F.lit("partial"))
    return whole.unionByName(gap).select("labels", "location", "frame_idx", "y")


def emb_no_hand(spark, sf):
    places = ["Bag", "Hips", "Torso"]
    rows = embeddings(spark, "fixture", "train", locations=places, root=cache_path(spark, sf)).df
    return rows.groupBy("location", "y").agg(F.count(F.lit(1)).alias("n"))


def emb_shape(spark, sf):
    """Rows, widths and labels per split, from the log of the cache."""
    return logged_shape(logged(spark, sf).where("fm = 'fixture'"), ["split"])


def emb_roundtrip(spark, sf):
    rows = cached(spark, sf)
    cells = rows.select(
        "fm", "revision", "split", "location", "frame_idx", "pooling", F.col("y").cast("int").alias("y"),
        _cells(),
    )
    return _exact(cells)


def emb_catalog(spark, sf):
    return catalog(logged(spark, sf))


def revision_resolve(spark, sf):
    return revisions(logged(spark, sf), "org/other")


def emb_label_set(spark, sf):
    return label_set(select_slice(cached(spark, sf), "fixture", "v1", "train"))


def _train(spark, sf):
    return select_slice(cached(spark, sf), "fixture", "v1", "train")


def _held(spark, sf):
    return select_slice(cached(spark, sf), "fixture", "v1", "validation")


def q_scaler_stats(spark, sf):
    stats = scaler_stats(_train(spark, sf))
    return stats.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def scaler_transform(spark, sf):
    model = PopulationScaler().fit(with_vector(_train(spark, sf)).select(VECTOR))
    scaled = scale(with_vector(_held(spark, sf)), model)
    cells = F.posexplode(vector_to_array(SCALED)).alias("dim", "value")
    return scaled.select("location", "frame_idx", cells).withColumn("value", F.round("value", 6))


def q_vector_mean(spark, sf):
    means = vector_mean(_train(spark, sf), by=("location",))
    return means.withColumn("mean", F.round("mean", 6))


def q_gram_matrix(spark, sf):
    return gram_matrix(emb(spark, sf)).withColumn("value", F.round("value", 6))


def _rounded(table):
    digits = {c: F.round(c, 9) for c in ("macro_f1", "accuracy")}
    return table.withColumns(digits).drop("per_class_f1", "n_unlabelled")


def _scores(spark, sf, name, **params):
    model = make_head(name, seed=0, **params).fit(_train(spark, sf))
    pairs = predicted_pairs(model, _held(spark, sf))
    table = _rounded(score(pairs.select("y_true", "y_pred")))
    return table.select(F.lit(name).alias("head"), "macro_f1", "accuracy", "n")


def head_linear(spark, sf):
    return _scores(spark, sf, "linear")


def head_logreg(spark, sf):
    """Gradient of the penalised log loss at the fitted weights, per class and dimension: zero at the optimum."""
    train = _train(spark, sf)
    model = make_head("logreg", seed=0, tol=1e-9).fit(train)
    fitted = model.classifier
    stats = {r["dim"]: (r["mean"], r["std"]) for r in scaler_stats(train).collect()}
    size = len(stats)
    scored = fitted.transform(with_vector(train))
    n = train.count()
    k = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("y")) - 1
    cells = scored.select(
        k.alias("k"), vector_to_array("probability").alias("p"), F.posexplode("features").alias("dim", "v")
    ).select("k", "dim", "v", F.posexplode("p").alias("c", "p"))
    mean = F.element_at(F.array(*[F.lit(stats[d][0]) for d in range(size)]), F.col("dim") + 1)
    std = F.element_at(F.array(*[F.lit(stats[d][1]) for d in range(size)]), F.col("dim") + 1)
    error = F.col("p") - F.when(F.col("k") == F.col("c"), 1.0).otherwise(0.0)
    data = cells.groupBy("c", "dim").agg((F.sum(error * (F.col("v") - mean) / std) / n).alias("g"))
    weights = fitted.coefficientMatrix.toArray()
    flat = F.array(*[F.lit(float(weights[c, d] * stats[d][1] / n)) for c in range(len(model.classes)) for d in range(size)])
    whole = F.col("g") + F.element_at(flat, F.col("c") * size + F.col("dim") + 1)
    names = F.array(*[F.lit(c) for c in model.classes])
    # The sum turns a negative zero into zero.
    return data.select(
        F.element_at(names, F.col("c") + 1).alias("class"), "dim", (F.round(whole, 4) + 0.0).alias("gradient")
    )


def head_mlp(spark, sf):
    """The perceptron's classes against a forward pass of its weights in built-in expressions, frame by frame."""
    model = make_head("mlp", seed=0).fit(_train(spark, sf))
    weights = np.asarray(model.classifier.weights)
    layers, at, held = model.classifier.getLayers(), 0, []
    for wide, narrow in zip(layers, layers[1:]):
        # Weights of a layer stand column by column, its biases behind them.
        table = weights[at : at + wide * narrow].reshape(wide, narrow)
        bias = weights[at + wide * narrow : at + (wide + 1) * narrow]
        held.append([[*map(float, table[:, j]), float(bias[j])] for j in range(narrow)])
        at += (wide + 1) * narrow
    one = spark.createDataFrame([(held,)], "layers array<array<array<double>>>").scalar()
    rows = scale(with_vector(model.predict(dealt(_held(spark, sf)))), model.scaler).withColumn("layers", one)

    def layer(k, x):
        # The input is the element of an outer array: an expression inside the lambda is evaluated for every unit.
        whole = F.array(F.concat(x, F.array(F.lit(1.0))))
        units = F.get("layers", F.lit(k))

        def unit(u, x):
            return F.aggregate(F.zip_with(u, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

        return F.get(F.transform(whole, lambda x: F.transform(units, lambda u: unit(u, x))), F.lit(0))

    rows = rows.withColumn("hidden", F.transform(layer(0, vector_to_array(SCALED)), lambda v: 1 / (1 + F.exp(-v))))
    rows = rows.withColumn("out", layer(1, F.col("hidden")))
    best = F.array_position("out", F.array_max("out")).cast("int")
    label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), best)
    return rows.select("location", "frame_idx", (label == F.col("y_pred")).alias("same"))


def predict_frames(spark, sf):
    model = make_head("linear").fit(_train(spark, sf))
    test = select_slice(cached(spark, sf), "fixture", "v1", "test")
    return model.predict(test).select("frame_idx", "y_pred")


def head_saved(spark, sf):
    """A head written to disk, loaded and applied to the test split."""

    def write(path):
        make_head("linear").fit(_train(spark, sf)).save(path)

    model = HeadModel.load(spark, once(spark, sf, "head", write))
    test = select_slice(cached(spark, sf), "fixture", "v1", "test")
    return model.predict(test).select("frame_idx", "y_pred")


def head_streamed(spark, sf):
    """The test split predicted as a stream of files by a head, with one batch written twice."""
    model = make_head("linear").fit(_train(spark, sf))

    def write(path):
        test = select_slice(cached(spark, sf), "fixture", "v1", "test").select("frame_idx", "features")
        test.repartition(4, "frame_idx").write.parquet(f"{path}/frames")
        frames = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/frames")
        predict_stream(frames, model.predict, f"{path}/predictions", f"{path}/checkpoint").awaitTermination()
        again = spark.read.parquet(f"{path}/predictions/batch=1")
        write_batch(spark.createDataFrame(again.collect(), again.schema), 1, f"{path}/predictions")

    return read_stream_predictions(spark, f"{once(spark, sf, 'streamed', write)}/predictions")


def _trained(spark, sf):
    """The train and predict jobs on the cache, with a run store of their own."""

    def write(path):
        jobs.train_head(
            spark, "fixture", "linear", root=cache_path(spark, sf), store=f"{path}/store", out=f"{path}/head",
            tags={"git_dirty": False},
        )
        jobs.predict_test(spark, f"{path}/head", f"{path}/predictions", root=cache_path(spark, sf))

    return once(spark, sf, "trained", write)


def job_predictions(spark, sf):
    return spark.read.parquet(f"{_trained(spark, sf)}/predictions").select("frame_idx", "y_pred")


def job_run_log(spark, sf):
    """What the train job logged, found again through the leaderboard table."""
    store = f"{_trained(spark, sf)}/store"
    board = run_table(read_runs(spark, store), read_experiments(spark, store), params=("seed",))
    values = read_run_metrics(spark, store).where("metric IN ('macro_f1', 'accuracy')")
    return values.join(board.select("run_id", "run_name", "seed", "git_dirty"), "run_id").select(
        "run_name", "seed", "git_dirty", "metric", F.round("value", 9).alias("value"), "step"
    )


def evaluate_head(spark, sf):
    model = make_head("linear").fit(_train(spark, sf))
    return _rounded(evaluate_by(model, _held(spark, sf), ["location"]))


def head_per_location(spark, sf):
    """One head per location against the validation frames of the same location."""
    models = fit_per_group(_train(spark, sf), make_head("linear"), "location", TRAIN_LOCATIONS)
    pairs = predict_per_group(_held(spark, sf), models, "location").withColumnRenamed("y", "y_true")
    return _rounded(score(pairs, by=["location"]))


def head_logreg_per_location(spark, sf):
    """Gradient of each location's penalised log loss at its fitted weights: zero at every optimum."""
    train = _train(spark, sf)
    models = fit_per_group(train, make_head("logreg", tol=1e-9), "location", TRAIN_LOCATIONS)
    parts = []
    for place, model in models.items():
        rows = train.where(F.col("location") == place)
        stats = scaler_stats(rows).select("dim", "mean", "std")
        n = rows.count()
        weights = spark.createDataFrame(
            [(c, d, float(w)) for d, row in enumerate(model.weights[:-1]) for c, w in zip(model.classes, row)], "class int, dim int, w double"
        )
        exps = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
        share = F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))
        cells = model.scores(rows).select("y", share.alias("p"), F.posexplode("features").alias("dim", "v"))
        cells = cells.select("y", "dim", "v", F.posexplode("p").alias("c", "p"))
        classes = F.array(*[F.lit(c) for c in model.classes])
        cells = cells.withColumn("class", F.element_at(classes, F.col("c") + 1))
        gap = F.col("p") - F.when(F.col("class") == F.col("y"), 1.0).otherwise(0.0)
        sums = cells.groupBy("class", "dim").agg(F.sum(gap * F.col("v")).alias("gv"), F.sum(gap).alias("g"))
        whole = sums.join(F.broadcast(stats), "dim").join(F.broadcast(weights), ["class", "dim"])
        slope = (F.col("gv") - F.col("mean") * F.col("g")) / F.col("std") / n + F.col("w") * F.col("std") / n
        parts.append(whole.select(F.lit(place).alias("location"), "class", "dim", (F.round(slope, 5) + 0.0).alias("gradient")))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def head_pca(spark, sf):
    """Eight components: what is left of C v - l v, which is zero, and their products, the identity."""
    train = _train(spark, sf)
    pca = fit_pca(train, 8)
    n = train.count()
    scaled = scale(with_vector(train), pca.scaler).select(vector_to_array(SCALED).alias("x"))
    parts = [(k, v.tolist(), float(w)) for k, (v, w) in enumerate(zip(pca.components.T, pca.variances))]
    held = F.broadcast(spark.createDataFrame(parts, "k int, v array<double>, w double").withColumn("one", F.lit(1)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rest = gram_rows(scaled, "x").withColumn("one", F.lit(1)).join(held, "one")
    left = dot(F.col("products"), F.col("v")) / n - F.col("w") * F.element_at("v", F.col("i") + 1)
    first = held.select(F.col("k").alias("a"), F.col("v").alias("va"), "one")
    pairs = first.join(held, "one").select(
        F.lit("product").alias("kind"), "a", F.col("k").alias("b"), dot(F.col("va"), F.col("v")).alias("value")
    )
    rows = rest.select(F.lit("residual").alias("kind"), F.col("k").alias("a"), F.col("i").alias("b"), left.alias("value"))
    # The sum turns a negative zero into zero.
    return rows.unionByName(pairs).withColumn("value", F.round("value", 6) + 0.0)


def head_pca_score(spark, sf):
    """A linear head on eight components, scored on the validation split."""
    pca = fit_pca(_train(spark, sf), 8)
    model = make_head("linear").fit(pca.transform(_train(spark, sf)))
    pairs = predicted_pairs(model, pca.transform(_held(spark, sf)))
    table = _rounded(score(pairs.select("y_true", "y_pred")))
    return table.select(F.lit("pca").alias("head"), "macro_f1", "accuracy", "n")


def fused_features(spark, sf):
    fused = fuse_models(cached(spark, sf), [("fixture", "v1"), ("org/other", "007")])
    y = F.col("y").cast("int").alias("y")
    return _exact(fused.select("split", "location", "frame_idx", y, _cells()))


def _synthetic(spark, sf):
    keys = emb(spark, sf).select(
        "split", "location", "frame_idx", F.coalesce("y", F.lit(1)).alias("class"), "y"
    )
    return synthetic_vectors(keys, dim=16, seed=1)


def synth_cache(spark, sf):
    cells = _synthetic(spark, sf).select("split", "location", "frame_idx", "y", _cells())
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 4) + 0.0)


def synth_balance(spark, sf):
    rows = _synthetic(spark, sf)
    return rows.groupBy("split", "location", "y").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")
    )


QUERIES = {
    "emb_scan": emb_scan,
    "emb_scan_location": emb_scan_location,
    "emb_scan_test": emb_scan_test,
    "emb_scan_defaults": emb_scan_defaults,
    "emb_pooled": emb_pooled,
    "emb_no_hand": emb_no_hand,
    "emb_shape": emb_shape,
    "emb_roundtrip": emb_roundtrip,
    "emb_catalog": emb_catalog,
    "revision_resolve": revision_resolve,
    "label_set": emb_label_set,
    "scaler_stats": q_scaler_stats,
    "scaler_transform": scaler_transform,
    "vector_mean": q_vector_mean,
    "gram_matrix": q_gram_matrix,
    "head_linear": head_linear,
    "head_logreg": head_logreg,
    "head_mlp": head_mlp,
    "head_saved": head_saved,
    "head_streamed": head_streamed,
    "job_predictions": job_predictions,
    "job_run_log": job_run_log,
    "predict_frames": predict_frames,
    "evaluate_head": evaluate_head,
    "head_per_location": head_per_location,
    "head_logreg_per_location": head_logreg_per_location,
    "head_pca": head_pca,
    "head_pca_score": head_pca_score,
    "fused_features": fused_features,
    "synth_cache": synth_cache,
    "synth_balance": synth_balance,
}

LONG_SQL = """long AS (
  SELECT split, location, frame_idx, y, CAST(unnest(features) AS DOUBLE) AS v,
         CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS dim FROM emb)"""

# Ridge regression in SQL: standardise, build X'X + I and X'Y, eliminate column by column, predict.
# ``g`` is the group that gets a head of its own (a constant for a single head).


def ridge_sql(group: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([EMB, LONG_SQL]) + f""",
grouped AS (SELECT *, {group} AS g FROM long),
stats AS (
  SELECT g, dim, avg(v) AS m, stddev_pop(v) AS s FROM grouped WHERE split = 'train' GROUP BY g, dim),
scaled AS (
  SELECT g, split, location, frame_idx, y, dim, CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS z
  FROM grouped JOIN stats USING (g, dim)),
train AS (SELECT * FROM scaled WHERE split = 'train'),
classes AS (SELECT DISTINCT g, y AS c FROM train),
system AS (
  SELECT a.g, a.dim AS i, b.dim AS j, sum(a.z * b.z) + CASE WHEN a.dim = b.dim THEN 1 ELSE 0 END AS v
  FROM train a JOIN train b USING (frame_idx) GROUP BY a.g, a.dim, b.dim
  UNION ALL
  SELECT g, dim, 63 + c, sum(z * CASE WHEN y = c THEN 1 ELSE -1 END)
  FROM train JOIN classes USING (g) GROUP BY g, dim, c),
solved AS (
  SELECT 0 AS step, g, i, j, v FROM system
  UNION ALL
  SELECT m.step + 1, m.g, m.i, m.j,
         CASE WHEN m.i = m.step THEN m.v / p.v ELSE m.v - f.v * r.v / p.v END
  FROM solved m
  JOIN solved p ON p.g = m.g AND p.i = m.step AND p.j = m.step
  JOIN solved r ON r.g = m.g AND r.i = m.step AND r.j = m.j
  JOIN solved f ON f.g = m.g AND f.i = m.i AND f.j = m.step
  WHERE m.step < 64),
weights AS (SELECT g, i AS dim, j - 63 AS c, v AS w FROM solved WHERE step = 64 AND j > 63),
bias AS (
  SELECT g, c, avg(CASE WHEN y = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS b
  FROM (SELECT DISTINCT g, frame_idx, y FROM train) JOIN classes USING (g) GROUP BY g, c),
scored AS (
  SELECT split, location, frame_idx, y, c, sum(z * w) + any_value(b) AS score
  FROM scaled JOIN weights USING (g, dim) JOIN bias USING (g, c) GROUP BY ALL),
predicted AS (
  SELECT split, location, frame_idx, y AS y_true, CAST(arg_max(c, score) AS INTEGER) AS y_pred
  FROM scored GROUP BY ALL),
held AS (SELECT * FROM predicted WHERE split = 'validation'),
counts AS (
  SELECT {{keys}}c, count(*) FILTER (y_true = c AND y_pred = c) AS tp,
         count(*) FILTER (y_true = c) + count(*) FILTER (y_pred = c) AS seen
  FROM held, range(1, 9) AS r(c) GROUP BY {{keys}}c),
macro AS (
  SELECT {{keys}}avg(CASE WHEN seen = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / seen END) AS macro_f1
  FROM counts {{by}}),
total AS (
  SELECT {{keys}}avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
         count(*) AS n FROM held {{by}})
""".format(
        keys="location, " if "location" in select else "",
        by="GROUP BY location" if "location" in select else "",
    ) + select


SCORES = "round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy, n"


def pca_sql(k: int, squarings: int = 14) -> str:
    """Scores of a ridge head on the ``k`` largest components.

    Repeated squaring of the matrix leaves the projector on its largest component, which is taken off
    for the next one. Standardised components have n times the identity as products, so the weights are
    the sum of projectors over variances, times X'Y over n + 1.
    """
    steps = []
    for c in range(k):
        steps.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{c} WHERE i = j) AS v FROM c{c})")
        for t in range(squarings):
            steps.append(f"q{c}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{t} a JOIN p{c}_{t} b ON a.j = b.i GROUP BY a.i, b.j)")
            steps.append(f"p{c}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{c}_{t} WHERE i = j) AS v FROM q{c}_{t})")
        last = f"p{c}_{squarings}"
        steps.append(f"l{c} AS MATERIALIZED (SELECT sum(a.v * b.v) AS l FROM c{c} a JOIN {last} b USING (i, j))")
        steps.append(f"c{c + 1} AS MATERIALIZED (SELECT i, j, a.v - l * b.v AS v FROM c{c} a JOIN {last} b USING (i, j), l{c})")
    parts = " UNION ALL ".join(f"SELECT i, j, v / l AS v FROM p{c}_{squarings}, l{c}" for c in range(k))
    return with_cte(EMB, LONG_SQL, select=f"""
, stats AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM long WHERE split = 'train' GROUP BY dim),
scaled AS MATERIALIZED (
  SELECT split, frame_idx, y, dim, CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS z FROM long JOIN stats USING (dim)),
train AS MATERIALIZED (SELECT * FROM scaled WHERE split = 'train'),
frames AS (SELECT DISTINCT frame_idx, y FROM train),
size AS (SELECT count(*) AS n FROM frames),
classes AS (SELECT DISTINCT y AS c FROM train),
c0 AS MATERIALIZED (
  SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) / any_value(n) AS v
  FROM train a JOIN train b USING (frame_idx), size GROUP BY a.dim, b.dim),
{", ".join(steps)},
inverse AS (SELECT i, j, sum(v) AS v FROM ({parts}) GROUP BY i, j),
moments AS (SELECT dim AS j, c, sum(z * CASE WHEN y = c THEN 1 ELSE -1 END) AS v FROM train, classes GROUP BY dim, c),
weights AS (
  SELECT i AS dim, c, sum(a.v * b.v) / (any_value(n) + 1) AS w
  FROM inverse a JOIN moments b USING (j), size GROUP BY i, c),
bias AS (SELECT c, avg(CASE WHEN y = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS b FROM frames, classes GROUP BY c),
scored AS (
  SELECT frame_idx, y, c, sum(z * w) + any_value(b) AS score
  FROM scaled JOIN weights USING (dim) JOIN bias USING (c) WHERE split = 'validation' GROUP BY frame_idx, y, c),
held AS (SELECT frame_idx, y AS y_true, CAST(arg_max(c, score) AS INTEGER) AS y_pred FROM scored GROUP BY frame_idx, y),
counts AS (
  SELECT c, count(*) FILTER (y_true = c AND y_pred = c) AS tp,
         count(*) FILTER (y_true = c) + count(*) FILTER (y_pred = c) AS seen
  FROM held, range(1, 9) AS r(c) GROUP BY c),
macro AS (SELECT avg(CASE WHEN seen = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / seen END) AS macro_f1 FROM counts),
total AS (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM held)
SELECT 'pca' AS head, {SCORES} FROM macro, total""")


def _uniform_sql(*keys: str) -> str:
    name = " || '|' || ".join(["'1'", *keys])
    return f"((('0x' || substr(sha256({name}), 1, 13))::BIGINT)::DOUBLE + 0.5) * (1.0::DOUBLE / 4503599627370496.0::DOUBLE)"


def _normal_sql(*keys: str) -> str:
    radius, angle = _uniform_sql("'radius'", *keys), _uniform_sql("'angle'", *keys)
    return f"sqrt(-2.0::DOUBLE * ln({radius})) * cos(2.0::DOUBLE * pi() * ({angle}))"


SYNTH = f"""
, dims AS (SELECT range AS d FROM range(0, 16)),
centroids AS (SELECT c, d, 2.5::DOUBLE * {_normal_sql("'centroid'", "c::VARCHAR", "d::VARCHAR")} AS v
              FROM range(1, 9) AS r(c), dims),
shifts AS (SELECT p, d, 0.3::DOUBLE * {_normal_sql("'shift'", "p", "d::VARCHAR")} AS v
           FROM (VALUES ('Bag'), ('Hips'), ('Torso'), ('Hand')) AS l(p), dims)
SELECT split, location, frame_idx, y, CAST(dims.d AS INTEGER) AS dim,
       round(CAST(CAST(centroids.v + shifts.v + {_normal_sql("'noise'", "split", "location", "frame_idx::VARCHAR", "dims.d::VARCHAR")} AS FLOAT) AS DOUBLE), 4) + 0.0::DOUBLE AS value
FROM emb, dims JOIN centroids ON centroids.d = dims.d AND centroids.c = coalesce(y, 1)
JOIN shifts ON shifts.d = dims.d AND shifts.p = location"""

ORACLES = {
    "head_linear": ridge_sql("0", f"SELECT 'linear' AS head, {SCORES} FROM macro, total"),
    "predict_frames": ridge_sql("0", "SELECT frame_idx, y_pred FROM predicted WHERE split = 'test'"),
    "evaluate_head": ridge_sql("0", f"SELECT location, {SCORES} FROM macro JOIN total USING (location)"),
    "head_per_location": ridge_sql(
        "location", f"SELECT location, {SCORES} FROM macro JOIN total USING (location)"
    ),
    "emb_scan": with_cte(EMB, LONG_SQL, select="""
SELECT frame_idx, y, dim, v AS value FROM long WHERE split = 'train' AND location = 'Bag'"""),
    "emb_scan_location": with_cte(EMB, LONG_SQL, select="""
SELECT location, frame_idx, y, dim, v AS value FROM long
WHERE split = 'validation' AND location = 'Torso'"""),
    "emb_scan_test": with_cte(EMB, LONG_SQL, select="""
SELECT CAST(NULL AS VARCHAR) AS location, frame_idx, y, dim, v AS value FROM long WHERE split = 'test'"""),
    "emb_scan_defaults": with_cte(EMB, select="""
SELECT location, coalesce(pooling, 'mean') AS pooling, count(*) AS n FROM emb
WHERE split = 'train' GROUP BY ALL"""),
    "emb_pooled": with_cte(EMB, select="""
SELECT 'all' AS labels, location, frame_idx, y FROM emb WHERE split = 'train'
UNION ALL
SELECT 'partial', location, frame_idx, CAST(NULL AS INTEGER) FROM emb WHERE split = 'train'"""),
    "emb_no_hand": with_cte(EMB, select="""
SELECT location, y, count(*) AS n FROM emb
WHERE split = 'train' AND location <> 'Hand' GROUP BY ALL"""),
    "emb_shape": with_cte(EMB, select="""
SELECT split, count(*) AS n, CAST(min(len(features)) AS INTEGER) AS min_dim,
       CAST(max(len(features)) AS INTEGER) AS max_dim, bool_and(y IS NOT NULL) AS labelled
FROM emb GROUP BY split"""),
    "emb_roundtrip": with_cte(EMB, LONG_SQL, select="""
SELECT fm, revision, split, CASE WHEN split = 'test' THEN 'all' ELSE location END AS location,
       frame_idx, pooling, y, dim, v AS value FROM long JOIN (SELECT fm, revision, pooling, frame_idx FROM emb) USING (frame_idx)
UNION ALL
SELECT 'org/other', r.rev, split, CASE WHEN split = 'test' THEN 'all' ELSE location END,
       frame_idx, pooling, y, CAST(63 - dim AS INTEGER), v FROM long JOIN (SELECT pooling, frame_idx FROM emb) USING (frame_idx),
       (VALUES ('007'), ('r/1')) AS r(rev)"""),
    "emb_catalog": """
SELECT DISTINCT fm, revision FROM embeddings, (VALUES ('fixture', 'v1'),
  ('org/other', '007'), ('org/other', 'r/1')) AS m(fm, revision)""",
    "revision_resolve": """
SELECT DISTINCT revision FROM embeddings, (VALUES ('007'), ('r/1')) AS m(revision)""",
    "label_set": with_cte(EMB, select="SELECT DISTINCT y FROM emb WHERE split = 'train'"),
    "scaler_stats": with_cte(EMB, LONG_SQL, select="""
SELECT dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM long
WHERE split = 'train' GROUP BY dim"""),
    "scaler_transform": with_cte(EMB, LONG_SQL, select="""
, stats AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM long WHERE split = 'train' GROUP BY dim)
SELECT location, frame_idx, dim, round(CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END, 6) AS value
FROM long JOIN stats USING (dim) WHERE split = 'validation'"""),
    "vector_mean": with_cte(EMB, LONG_SQL, select="""
SELECT location, dim, round(avg(v), 6) AS mean FROM long WHERE split = 'train' GROUP BY ALL"""),
    "gram_matrix": with_cte(EMB, LONG_SQL, select="""
SELECT a.dim AS i, b.dim AS j, round(sum(a.v * b.v), 6) AS value
FROM long a JOIN long b USING (frame_idx) GROUP BY ALL"""),
    "fused_features": with_cte(EMB, LONG_SQL, select="""
SELECT split, CASE WHEN split = 'test' THEN 'all' ELSE location END AS location, frame_idx, y, dim, v AS value FROM long
UNION ALL
SELECT split, CASE WHEN split = 'test' THEN 'all' ELSE location END, frame_idx, y, CAST(127 - dim AS INTEGER), v FROM long"""),
    "head_saved": ridge_sql("0", "SELECT frame_idx, y_pred FROM predicted WHERE split = 'test'"),
    "head_streamed": ridge_sql("0", "SELECT frame_idx, y_pred FROM predicted WHERE split = 'test'"),
    "job_predictions": ridge_sql("0", "SELECT frame_idx, y_pred FROM predicted WHERE split = 'test'"),
    "job_run_log": ridge_sql("0", """
SELECT 'fixture|all|linear' AS run_name, '0' AS seed, 'false' AS git_dirty, 'macro_f1' AS metric,
       round(macro_f1, 9) AS value, CAST(0 AS BIGINT) AS step FROM macro
UNION ALL SELECT 'fixture|all|linear', '0', 'false', 'accuracy', round(accuracy, 9), 0 FROM total"""),
    "head_mlp": with_cte(EMB, select="SELECT location, frame_idx, true AS same FROM emb WHERE split = 'validation'"),
    "head_pca": """
SELECT 'residual' AS kind, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, 0.0::DOUBLE AS value
FROM range(0, 8) AS r(a), range(0, 64) AS q(b) WHERE EXISTS (SELECT 1 FROM embeddings)
UNION ALL SELECT 'product', CAST(a AS INTEGER), CAST(b AS INTEGER), CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
FROM range(0, 8) AS r(a), range(0, 8) AS q(b) WHERE EXISTS (SELECT 1 FROM embeddings)""",
    "head_pca_score": pca_sql(8),
    "synth_cache": with_cte(EMB, select=SYNTH),
    "head_logreg": with_cte(EMB, select="""
SELECT c.y AS class, CAST(d AS INTEGER) AS dim, 0.0::DOUBLE AS gradient
FROM (SELECT DISTINCT y FROM emb WHERE split = 'train') AS c, range(0, 64) AS r(d)"""),
    "head_logreg_per_location": with_cte(EMB, select="""
SELECT c.location, c.y AS class, CAST(d AS INTEGER) AS dim, 0.0::DOUBLE AS gradient
FROM (SELECT DISTINCT location, y FROM emb WHERE split = 'train') AS c, range(0, 64) AS r(d)"""),
    "synth_balance": with_cte(EMB, select="""
SELECT split, location, y, count(*) AS n, CAST(16 AS INTEGER) AS width FROM emb GROUP BY ALL"""),
}
