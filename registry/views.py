"""The given tables seen as frames, predictions, runs and files.

Every view exists twice: as a DataFrame and as SQL text (a list of CTEs) for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.constants import CHANNELS, TRAIN_LOCATIONS
from framelake.session import scratch_path
from framelake.sources.vector_cache import write_cache

SAMPLES = 8  # samples per channel: the 64 numbers of a vector fill eight channels, the ninth repeats the first
_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, sf: str, name: str, write) -> str:
    """Write a derived data set once per session and scale, and return its path."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def place(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in TRAIN_LOCATIONS]), (number % 4 + 1).cast("int"))


# --- vectors -----------------------------------------------------------------------------------


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with split, location, user and label; test rows have no label."""
    v = F.col("vec_id")
    turn = F.expr("vec_id div 4") % 10
    split = F.when(turn <= 6, "train").when(turn <= 8, "validation").otherwise("test")
    rows = table(spark, sf, "embeddings").select(
        v.alias("frame_idx"),
        F.lit("fixture").alias("fm"),
        F.lit("v1").alias("revision"),
        split.alias("split"),
        place(v).alias("location"),
        F.when(turn <= 6, 1).otherwise((2 + v % 2).cast("int")).alias("user"),
        F.col("embedding").alias("features"),
        F.when(turn <= 8, (1 + F.col("label") % 8).cast("int")).alias("y"),
        F.when(v % 7 != 0, "mean").alias("pooling"),
    )
    return rows


EMB = """emb AS (
  SELECT vec_id AS frame_idx, 'fixture' AS fm, 'v1' AS revision,
         CASE WHEN (vec_id // 4) % 10 <= 6 THEN 'train'
              WHEN (vec_id // 4) % 10 <= 8 THEN 'validation' ELSE 'test' END AS split,
         ['Bag', 'Hips', 'Torso', 'Hand'][CAST(vec_id % 4 AS INTEGER) + 1] AS location,
         CASE WHEN (vec_id // 4) % 10 <= 6 THEN 1
              ELSE CAST(2 + vec_id % 2 AS INTEGER) END AS "user",
         embedding AS features,
         CASE WHEN (vec_id // 4) % 10 <= 8 THEN 1 + label % 8 END AS y,
         CASE WHEN vec_id % 7 <> 0 THEN 'mean' END AS pooling
  FROM embeddings)"""


def cache_path(spark: SparkSession, sf: str) -> str:
    """The vectors written as a cache, plus a second model, the vectors reversed, with two revisions."""

    def write(path: str) -> None:
        rows = emb(spark, sf)
        pooled = F.when(F.col("split") == "test", "all").otherwise(F.col("location"))
        main = rows.withColumn("location", pooled)
        other = F.explode(F.array(F.lit("007"), F.lit("r/1")))
        second = main.withColumns(
            {"fm": F.lit("org/other"), "features": F.reverse("features"), "revision": other}
        )
        write_cache(main.unionByName(second), path)

    return once(spark, sf, "cache", write)


# --- predictions -------------------------------------------------------------------------------


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and prediction per line item; labels 0 and 9 lie outside 1..8 on purpose."""
    truth = (F.col("l_suppkey") % 10).cast("int")
    off = F.when(F.col("l_partkey") % 3 == 0, 1 + F.col("l_quantity").cast("int") % 2).otherwise(0)
    return table(spark, sf, "lineitem").select(
        truth.alias("y_true"),
        ((truth + off) % 10).cast("int").alias("y_pred"),
        place(F.col("l_linenumber")).alias("location"),
        (1 + F.col("l_orderkey") % 50).cast("int").alias("user"),
    )


PREDS = """preds AS (
  SELECT CAST(l_suppkey % 10 AS INTEGER) AS y_true,
         CAST((l_suppkey % 10 + CASE WHEN l_partkey % 3 = 0
               THEN 1 + CAST(trunc(l_quantity) AS INTEGER) % 2 ELSE 0 END) % 10 AS INTEGER) AS y_pred,
         ['Bag', 'Hips', 'Torso', 'Hand'][CAST(l_linenumber % 4 AS INTEGER) + 1] AS location,
         CAST(1 + l_orderkey % 50 AS INTEGER) AS "user"
  FROM lineitem)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """One truth per order; every 97th order is left out."""
    rows = table(spark, sf, "orders").where(F.col("o_orderkey") % 97 != 5)
    return rows.select(
        F.col("o_orderkey").alias("frame_idx"), (1 + F.col("o_custkey") % 8).cast("int").alias("y_true")
    )


def external(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions made elsewhere; every 89th order is left out."""
    rows = table(spark, sf, "orders").where(F.col("o_orderkey") % 89 != 7)
    label = 1 + (F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)) % 8
    return rows.select(F.col("o_orderkey").alias("frame_idx"), label.cast("int").alias("y_pred"))


TRUTH = """truth AS (
  SELECT o_orderkey AS frame_idx, CAST(1 + o_custkey % 8 AS INTEGER) AS y_true
  FROM orders WHERE o_orderkey % 97 <> 5)"""

EXTERNAL = """external AS (
  SELECT o_orderkey AS frame_idx,
         CAST(1 + (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 8 AS INTEGER) AS y_pred
  FROM orders WHERE o_orderkey % 89 <> 7)"""


def order_pred(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction for every order."""
    label = 1 + F.col("o_custkey") % 8
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_idx"), label.cast("int").alias("y_pred"))


ORDER_PRED = """order_pred AS (
  SELECT o_orderkey AS frame_idx, CAST(1 + o_custkey % 8 AS INTEGER) AS y_pred FROM orders)"""


def frame_pred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame_idx"), (1 + F.col("vec_id") % 8).cast("int").alias("y_pred")
    )


def matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A submission with faults: one text line per order, 20 samples each.

    Comments, blank lines, NaN, infinities, fractions, stray labels, ragged lines and words.
    """
    k = F.col("o_orderkey")
    label = (1 + F.col("o_custkey") % 8).cast("string")
    body = F.rtrim(F.repeat(F.concat(label, F.lit(" ")), 20))
    line = (
        F.when(k % 101 == 0, "# a comment line")
        .when(k % 103 == 0, "   ")
        .when(k % 107 == 0, F.concat(F.lit("nan NaN "), body))
        .when(k % 109 == 0, F.concat(F.lit("1.5 "), body))
        .when(k % 113 == 0, F.concat(F.lit("99 -3\t"), body))
        .when(k % 127 == 0, F.concat(F.lit("word "), body))
        .when(k % 131 == 0, F.concat(F.lit("inf "), body))
        .when(k % 137 == 0, F.concat(F.lit("  +2e0 3.0 "), body, F.lit("  # tail")))
        .otherwise(body)
    )
    return table(spark, sf, "orders").select(k.alias("line"), line.alias("value"))


MATRIX_LINES = """raw_lines AS (
  SELECT o_orderkey AS line,
         rtrim(repeat(CAST(1 + o_custkey % 8 AS VARCHAR) || ' ', 20)) AS body, o_orderkey AS k
  FROM orders),
matrix_lines AS (
  SELECT line, CASE WHEN k % 101 = 0 THEN '# a comment line'
                    WHEN k % 103 = 0 THEN '   '
                    WHEN k % 107 = 0 THEN 'nan NaN ' || body
                    WHEN k % 109 = 0 THEN '1.5 ' || body
                    WHEN k % 113 = 0 THEN '99 -3' || chr(9) || body
                    WHEN k % 127 = 0 THEN 'word ' || body
                    WHEN k % 131 = 0 THEN 'inf ' || body
                    WHEN k % 137 = 0 THEN '  +2e0 3.0 ' || body || '  # tail'
                    ELSE body END AS value
  FROM raw_lines),
cells AS (
  SELECT line, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT line, string_split_regex(regexp_replace(split_part(value, '#', 1), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks
        FROM matrix_lines
        WHERE regexp_replace(split_part(value, '#', 1), '^\\s+|\\s+$', '', 'g') <> '')),
nums AS (SELECT line, CAST(pos AS INTEGER) AS pos, TRY_CAST(tok AS DOUBLE) AS val FROM cells)"""


def scores(spark: SparkSession, sf: str, step: int) -> DataFrame:
    """Score vectors of one of two nearly equal runs; frames differ by a few."""
    v = F.col("vec_id")
    nudge = F.when(v % step == 0, v / 1e6).otherwise(F.lit(0.0))
    label = F.col("label") + F.when(v % (step * 7) == 0, 1).otherwise(0)
    score = F.transform(
        F.sequence(F.lit(0), F.lit(10)),
        lambda c: F.when(c == label, F.lit(1.0)).otherwise(c / 20.0) + nudge,
    )
    rows = table(spark, sf, "embeddings").where(v % (step * 11) != 1)
    return rows.select(v.alias("frame_idx"), score.alias("scores"), label.alias("y_pred"))


def scores_sql(name: str, step: int) -> str:
    label = f"label + CASE WHEN vec_id % {step * 7} = 0 THEN 1 ELSE 0 END"
    return f"""{name} AS (
  SELECT vec_id AS frame_idx, c,
         CASE WHEN c = {label} THEN 1.0::DOUBLE ELSE c::DOUBLE / 20.0::DOUBLE END
         + CASE WHEN vec_id % {step} = 0 THEN vec_id::DOUBLE / 1e6 ELSE 0.0::DOUBLE END AS score,
         {label} AS y_pred
  FROM embeddings, range(0, 11) AS r(c) WHERE vec_id % {step * 11} <> 1)"""


# --- runs --------------------------------------------------------------------------------------


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per order, in the layout of the run store."""
    k = F.col("o_orderkey")
    metric = (
        F.when(k % 11 == 0, F.lit(None).cast("double"))
        .when(k % 113 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice") / 1e6)
    )
    heads = F.array(*[F.lit(h) for h in ("linear", "logreg", "mlp")])
    head = F.element_at(heads, (k % 3 + 1).cast("int"))
    fm = F.substring("o_orderpriority", 3, 20)
    where = F.when(k % 2 == 0, "all").otherwise("3loc")
    name = F.when(k % 10 != 0, F.concat_ws("|", fm, where, head))
    return table(spark, sf, "orders").select(
        k.cast("string").alias("run_id"),
        (F.col("o_custkey") % 30).cast("string").alias("experiment_id"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.create_map(
            F.lit("fm"), fm, F.lit("head"), head, F.lit("seed"), (k % 4).cast("string")
        ).alias("params"),
        F.create_map(
            F.lit("run_name"),
            name,
            F.lit("git_dirty"),
            F.when(k % 2 == 0, "true").otherwise("false"),
            F.lit("python_env"),
            F.when(k % 3 == 0, "/team/venv").otherwise("/home/venv"),
            F.lit("student"),
            F.concat(F.lit("s"), (F.col("o_custkey") % 12).cast("string")),
        ).alias("tags"),
        F.create_map(F.lit("macro_f1"), metric).alias("metrics"),
    )


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("experiment_id"), F.col("n_name").alias("name")
    )


RUNS = """runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey AS k,
         CAST(o_custkey % 30 AS VARCHAR) AS experiment_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 113 = 0 THEN 'nan'::DOUBLE
              ELSE o_totalprice / 1e6 END AS macro_f1,
         substring(o_orderpriority, 3) AS fm,
         ['linear', 'logreg', 'mlp'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS head,
         CASE WHEN o_orderkey % 10 <> 0 THEN substring(o_orderpriority, 3) || '|' ||
              CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE '3loc' END || '|' ||
              ['linear', 'logreg', 'mlp'][CAST(o_orderkey % 3 AS INTEGER) + 1] END AS run_name,
         CAST(o_orderkey % 4 AS VARCHAR) AS seed,
         CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS git_dirty,
         CASE WHEN o_orderkey % 3 = 0 THEN '/team/venv' ELSE '/home/venv' END AS python_env,
         's' || CAST(o_custkey % 12 AS VARCHAR) AS student,
         o_orderdate AS start_time
  FROM orders),
experiments AS (SELECT CAST(n_nationkey AS VARCHAR) AS experiment_id, n_name AS name FROM nation),
board AS (
  SELECT coalesce(name, experiment_id) AS experiment, run_name, macro_f1, fm, head, student,
         git_dirty, strftime(start_time, '%Y-%m-%d') AS start_day, run_id
  FROM runs LEFT JOIN experiments USING (experiment_id))"""


# --- files -------------------------------------------------------------------------------------


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(rel, content): every document as a file."""
    return table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("rel"),
        F.col("text").alias("content"),
        "doc_id",
    )


def manifest_text(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest lines: comments, blank, one-token, altered digests and entries without a file."""
    d = F.col("doc_id")
    rel = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    shown = F.when(d % 17 == 0, F.concat(F.lit("0"), F.substring(digest, 2, 63))).otherwise(digest)
    line = (
        F.when(d % 31 == 0, F.concat(F.lit("# "), rel))
        .when(d % 37 == 0, "  \t ")
        .when(d % 41 == 0, shown)
        .when(d % 43 == 0, F.concat(F.lit("  "), shown, F.lit("\t"), rel, F.lit("  ")))
        .when(d % 47 == 0, F.concat(shown, F.lit("  gone/"), d.cast("string"), F.lit(".txt")))
        .otherwise(F.concat(shown, F.lit("  "), rel))
    )
    return table(spark, sf, "documents").select(line.alias("value"))


FILES = """files AS (
  SELECT source || '/' || doc_id || '.txt' AS rel, sha256(text) AS digest, doc_id FROM documents)"""

MANIFEST = (
    FILES
    + """,
shown AS (
  SELECT doc_id AS d, rel,
         CASE WHEN doc_id % 17 = 0 THEN '0' || substring(digest, 2) ELSE digest END AS dig
  FROM files),
listed AS (
  SELECT dig AS digest,
         CASE WHEN d % 41 = 0 THEN NULL
              WHEN d % 43 <> 0 AND d % 47 = 0 THEN 'gone/' || d || '.txt' ELSE rel END AS rel,
         d % 41 = 0 AS malformed
  FROM shown WHERE d % 31 <> 0 AND d % 37 <> 0),
checked AS (
  SELECT listed.rel, listed.digest AS expected, files.digest AS actual,
         CASE WHEN malformed THEN 'malformed' WHEN files.digest IS NULL THEN 'missing'
              WHEN files.digest <> listed.digest THEN 'mismatch' ELSE 'ok' END AS status
  FROM listed LEFT JOIN files ON files.rel = listed.rel)"""
)


# --- raw channels ------------------------------------------------------------------------------


def raw_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Nine channels of eight samples and a label line per vector; some channels lack a frame."""
    cut = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                F.slice("features", 1 + SAMPLES * (i % 8), SAMPLES).alias("samples"),
            )
            for i, c in enumerate(CHANNELS)
        ]
    )
    label = F.array_repeat(F.col("y").cast("float"), SAMPLES)
    # The first two samples carry the next label: the frame label is still the majority.
    mixed = F.transform(label, lambda x, i: F.when(i < 2, x % 8 + 1).otherwise(x))
    frames = emb(spark, sf)
    channels = frames.select("split", "location", "frame_idx", F.inline(cut))
    gap = (F.col("channel") == "Gyr_z") & (F.col("frame_idx") % 50 == 3)
    labels = frames.where(F.col("y").isNotNull()).select(
        "split", "location", "frame_idx", F.lit("Label").alias("channel"), mixed.alias("samples")
    )
    return channels.where(~gap).unionByName(labels)


RAW = (
    EMB
    + """,
channel_names AS (
  SELECT unnest(['Acc_x','Acc_y','Acc_z','Gyr_x','Gyr_y','Gyr_z','Magn_x','Magn_y','Magn_z']) AS channel,
         unnest(range(0, 9)) AS c),
raw AS (
  SELECT split, location, frame_idx, channel, list_slice(features, 8 * (c % 8) + 1, 8 * (c % 8) + 8) AS samples, y
  FROM emb, channel_names
  WHERE NOT (channel = 'Gyr_z' AND frame_idx % 50 = 3)),
raw_long AS (
  SELECT split, location, frame_idx, channel, y, CAST(unnest(samples) AS DOUBLE) AS v,
         CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS pos FROM raw)"""
)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """(split, location, channel, frame_idx, samples): one line per order with 1 to 3 samples."""
    k = F.col("l_orderkey")
    n = F.when(F.col("l_partkey") % 503 == 0, 2).otherwise(3)
    return table(spark, sf, "lineitem").select(
        F.when(k % 5 < 4, "train").otherwise("validation").alias("split"),
        place(F.col("l_suppkey")).alias("location"),
        F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), F.col("l_linenumber")).alias("channel"),
        k.alias("frame_idx"),
        F.slice(F.array("l_quantity", "l_discount", "l_tax"), 1, n).alias("samples"),
    )


READINGS = """readings AS (
  SELECT CASE WHEN l_orderkey % 5 < 4 THEN 'train' ELSE 'validation' END AS split,
         ['Bag', 'Hips', 'Torso', 'Hand'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS location,
         ['Acc_x','Acc_y','Acc_z','Gyr_x','Gyr_y','Gyr_z','Magn_x'][l_linenumber] AS channel,
         l_orderkey AS frame_idx,
         CASE WHEN l_partkey % 503 = 0 THEN 2 ELSE 3 END AS len,
         l_quantity, l_discount, l_tax
  FROM lineitem)"""


def with_cte(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
