"""Queries over runs, manifests, digests and matrices."""

from __future__ import annotations

from framelake.operators.integrity import (
    check_manifest,
    logged_digest_check,
    manifest_summary,
    messages,
    missing_entries,
    unlisted_files,
)
from framelake.operators.leaderboard import (
    ablation,
    best_by_model,
    certifiable,
    leaderboard,
    run_table,
    scores_by_seed,
)
from framelake.operators.submission import (
    label_table,
    line_profiles,
    repeated_frames,
    stray_labels,
    validation_report,
)
from framelake.sources import commit_log
from framelake.sources.file_listing import digest_files, digest_text, list_files
from framelake.sources.manifest import manifest_lines, parse_manifest
from framelake.sources.matrix import (
    flatten_predictions,
    frame_lines,
    parse_matrix,
    read_matrix_lines,
    read_text_predictions,
    sample_rows,
    write_matrix,
)
from framelake.sources.raw_files import number_lines, store_lines
from framelake.sources.runs import merge_tags, read_runs
from pyspark.sql import functions as F

from .views import (
    FILES,
    MANIFEST,
    MATRIX_LINES,
    ORDER_PRED,
    RUNS,
    experiments,
    files,
    frame_pred,
    manifest_text,
    matrix_lines,
    once,
    order_pred,
    runs,
    table,
    with_cte,
)

OFF_GRID = 0.3183098861837907
BOARD = [
    "experiment", "run_name", "macro_f1", "fm", "head", "student", "git_dirty", "start_day", "run_id",
]


def _flat(board):
    number = F.nanvl("macro_f1", F.lit(-1.0))
    day = F.date_format("start_time", "yyyy-MM-dd")
    return board.withColumns({"macro_f1": F.round(number, 9), "start_day": day}).select(*BOARD)


def q_leaderboard(spark, sf):
    return _flat(leaderboard(runs(spark, sf), experiments(spark, sf)))


def leaderboard_filtered(spark, sf):
    return _flat(leaderboard(runs(spark, sf), experiments(spark, sf), ["FRANCE", "JAPAN", "27"]))


def leaderboard_topk(spark, sf):
    board = leaderboard(runs(spark, sf), experiments(spark, sf), max_results=25)
    return _flat(board)


def runs_scan(spark, sf):
    rows = runs(spark, sf).where(F.col("experiment_id").isin("3", "7"))
    return rows.select(
        "run_id",
        "experiment_id",
        F.round(F.nanvl(F.try_element_at("metrics", F.lit("macro_f1")), F.lit(-1.0)), 9).alias("macro_f1"),
        F.try_element_at("params", F.lit("seed")).alias("seed"),
    )


def run_tags_merge(spark, sf):
    rows = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    auto = F.create_map(
        F.lit("git_sha"), F.sha1(k.cast("string").cast("binary")),
        F.lit("student"), F.lit("auto"),
        F.lit("job"), F.when(k % 3 == 0, k.cast("string")),
    )
    given = F.create_map(
        F.lit("student"), F.when(k % 5 != 0, "given"), F.lit("note"), F.when(k % 2 == 0, "even")
    )
    merged = rows.select(k.alias("run_id"), merge_tags(auto, given).alias("tags"))
    return merged.select("run_id", F.explode("tags").alias("tag", "value"))


def runs_by_seed(spark, sf):
    rows = run_table(runs(spark, sf), experiments(spark, sf), params=("seed",))
    # The factor keeps means off decimal ties, which the two engines may round apart.
    number = F.nanvl("macro_f1", F.lit(None).cast("double")) * F.lit(OFF_GRID)
    seeds = scores_by_seed(rows.withColumn("macro_f1", number), ["experiment", "fm", "head"])
    return seeds.withColumns({"mean_f1": F.round("mean_f1", 9), "std_f1": F.round("std_f1", 9)})


def certifiable_best(spark, sf):
    clean = certifiable(runs(spark, sf), "/team/venv")
    return _flat(leaderboard(clean, experiments(spark, sf), max_results=1))


def runs_ablation(spark, sf):
    rows = run_table(runs(spark, sf), experiments(spark, sf))
    return ablation(rows)


def fm_comparison(spark, sf):
    return best_by_model(run_table(runs(spark, sf), experiments(spark, sf)))


def manifest_parse(spark, sf):
    return parse_manifest(manifest_text(spark, sf))


def _statuses(spark, sf):
    found = digest_text(files(spark, sf), "content").select("rel", "digest")
    return check_manifest(parse_manifest(manifest_text(spark, sf)), found)


def manifest_verify(spark, sf):
    return _statuses(spark, sf)


def q_manifest_summary(spark, sf):
    return manifest_summary(_statuses(spark, sf))


def manifest_messages(spark, sf):
    return messages(_statuses(spark, sf))


def manifest_missing(spark, sf):
    listed = parse_manifest(manifest_text(spark, sf)).where(~F.col("malformed"))
    return missing_entries(listed, files(spark, sf)).select("rel")


def manifest_unlisted(spark, sf):
    listed = parse_manifest(manifest_text(spark, sf)).where(~F.col("malformed"))
    return unlisted_files(listed, files(spark, sf)).select("rel")


def file_digest(spark, sf):
    return digest_text(files(spark, sf), "content").select("rel", "digest")


def file_digest_disk(spark, sf):
    """Documents written as text files, a hundred to a file, and the files hashed in pieces on the executors."""

    def write(path):
        docs = table(spark, sf, "documents").select("doc_id", "text", F.expr("doc_id div 100").alias("folder"))
        dealt = docs.repartition(F.col("folder")).sortWithinPartitions("folder", "doc_id")
        dealt.select(F.col("text").alias("value"), "folder").write.partitionBy("folder").text(path)

    found = digest_files(list_files(spark, once(spark, sf, "document-files", write)))
    return found.select(F.regexp_extract("rel", r"folder=(\d+)/", 1).cast("bigint").alias("folder"), "digest")


def manifest_generate(spark, sf):
    return manifest_lines(digest_text(files(spark, sf), "content")).select("rel", "line")


def submission_hash_check(spark, sf):
    outputs = digest_text(files(spark, sf), "content").select(F.col("doc_id").alias("run_id"), "digest")
    d = F.col("doc_id")
    true = F.sha2(F.col("text").cast("binary"), 256)
    logged = F.when(d % 17 == 0, F.reverse(true)).when(d % 19 != 0, true)
    kept = table(spark, sf, "documents").where(d % 23 != 0)
    store = kept.select(
        d.alias("run_id"), F.create_map(F.lit("submission_sha256"), logged).alias("tags")
    )
    return logged_digest_check(outputs, store)


def matrix_parse(spark, sf):
    parsed = parse_matrix(matrix_lines(spark, sf))
    cells = parsed.select("line", F.posexplode("vals").alias("pos", "val"))
    special = F.when(F.isnan("val"), -1.0).when(F.abs("val") == float("inf"), -2.0)
    return cells.withColumn("val", F.coalesce(special, F.col("val")))


def pred_flatten(spark, sf):
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", *[(1 + (k + i) % 8).cast("string") for i in range(4)])
    text = table(spark, sf, "orders").select(k.alias("line"), line.alias("value"))
    return flatten_predictions(parse_matrix(text))


def _report(spark, sf):
    return validation_report(
        line_profiles(matrix_lines(spark, sf)), expected_rows=15_000, expected_cols=20
    )


def validate_report(spark, sf):
    return _report(spark, sf).select(
        "ok", "n_rows", "n_cols", "n_nans", "n_text", "fractional", "n_stray",
        F.array_join("unique_labels", ",").alias("labels"),
        F.array_join("messages", "; ").alias("messages"),
    )


def validate_labels(spark, sf):
    return label_table(line_profiles(matrix_lines(spark, sf))).select("label", "n_lines")


def validate_bad_labels(spark, sf):
    return stray_labels(line_profiles(matrix_lines(spark, sf))).select("label")


def submission_matrix(spark, sf):
    return sample_rows(frame_pred(spark, sf))


def submission_lines(spark, sf):
    lines = frame_lines(order_pred(spark, sf))
    return lines.select("frame_idx", F.length("value").alias("chars"), F.sha2("value", 256).alias("digest"))


def submission_roundtrip(spark, sf):
    """Write the matrix as text, read it back and number its lines again."""
    path = once(spark, sf, "matrix", lambda p: write_matrix(order_pred(spark, sf), p, 50))
    lines = read_matrix_lines(spark, path).select(
        F.lit("matrix").alias("name"),
        F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )
    numbered = number_lines(store_lines(lines, ("name",), "matrix-lines"), ("name",))
    parsed = parse_matrix(numbered)
    return parsed.select(
        F.col("frame_idx").alias("row"),
        F.size("vals").alias("n_cols"),
        F.array_min("vals").cast("int").alias("low"),
        F.array_max("vals").cast("int").alias("high"),
    )


def text_predictions(spark, sf):
    """Predictions of all orders as text, one to four to a line, read back and counted in reading order."""

    def write(path):
        rows = order_pred(spark, sf)
        places = F.floor(F.col("frame_idx") / 4)
        lines = rows.groupBy(places.alias("line")).agg(F.sort_array(F.collect_list(F.struct("frame_idx", "y_pred")))["y_pred"].alias("y"))
        text = F.array_join(F.col("y").cast("array<string>"), " ").alias("value")
        lines.repartitionByRange("line").sortWithinPartitions("line").select(text).write.text(path)

    found = read_text_predictions(spark, once(spark, sf, "text-predictions", write))
    return found.select("frame_idx", F.col("y_pred").cast("int").alias("y_pred"))


def submission_repeats(spark, sf):
    """Frames with several predictions, which a submission refuses."""
    return repeated_frames(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_idx")))


def runs_merged(spark, sf):
    """A store of all runs, of which every third was logged again and every ninth a third time."""

    def write(path):
        rows = runs(spark, sf).withColumn("k", F.col("run_id").cast("long"))
        for attempt, every in enumerate((1, 3, 9)):
            value = F.map_from_arrays(F.array(F.lit("macro_f1")), F.array((F.col("k") % 1000 + attempt) / 1000))
            again = rows.where(F.col("k") % every == 0).withColumn("metrics", value).drop("k")
            # Two writers that saw the same state: the greater write id counts.
            for write_id in ("a", "b"):
                tagged = again.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("writer"), F.lit(f"{write_id}{attempt}"))))
                commit_log.append(tagged, f"{path}/runs", attempt + 1, write_id, one_file=False)

    merged = read_runs(spark, once(spark, sf, "merged-runs", write))
    value = F.round(F.try_element_at("metrics", F.lit("macro_f1")), 6).alias("macro_f1")
    return merged.select("run_id", "experiment_id", value, F.try_element_at("tags", F.lit("writer")).alias("writer"))


QUERIES = {
    "runs_merged": runs_merged,
    "leaderboard": q_leaderboard,
    "leaderboard_filtered": leaderboard_filtered,
    "leaderboard_topk": leaderboard_topk,
    "runs_scan": runs_scan,
    "run_tags_merge": run_tags_merge,
    "runs_by_seed": runs_by_seed,
    "certifiable_best": certifiable_best,
    "runs_ablation": runs_ablation,
    "fm_comparison": fm_comparison,
    "manifest_parse": manifest_parse,
    "manifest_verify": manifest_verify,
    "manifest_summary": q_manifest_summary,
    "manifest_messages": manifest_messages,
    "manifest_missing": manifest_missing,
    "manifest_unlisted": manifest_unlisted,
    "manifest_generate": manifest_generate,
    "file_digest": file_digest,
    "file_digest_disk": file_digest_disk,
    "submission_hash_check": submission_hash_check,
    "matrix_parse": matrix_parse,
    "pred_flatten": pred_flatten,
    "validate_report": validate_report,
    "validate_labels": validate_labels,
    "validate_bad_labels": validate_bad_labels,
    "submission_matrix": submission_matrix,
    "submission_lines": submission_lines,
    "submission_roundtrip": submission_roundtrip,
    "submission_repeats": submission_repeats,
    "text_predictions": text_predictions,
}

BOARD_SQL = """experiment, run_name,
       round(CASE WHEN isnan(macro_f1) THEN -1.0::DOUBLE ELSE macro_f1 END, 9) AS macro_f1,
       fm, head, student, git_dirty, start_day, run_id"""
NUMBER_SQL = "CASE WHEN NOT isnan(macro_f1) THEN macro_f1 END"
WHOLE_SQL = "isfinite(val) AND val = trunc(val)"

ORACLES = {
    "text_predictions": with_cte(ORDER_PRED, select="""
SELECT row_number() OVER (ORDER BY frame_idx) - 1 AS frame_idx, y_pred FROM order_pred"""),
    "runs_merged": with_cte(RUNS, select="""
SELECT run_id, experiment_id, round((k % 1000 + attempt)::DOUBLE / 1000, 6) AS macro_f1, 'b' || attempt AS writer
FROM (SELECT *, CASE WHEN k % 9 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS attempt FROM runs)"""),
    "leaderboard": with_cte(RUNS, select=f"SELECT {BOARD_SQL} FROM board"),
    "leaderboard_filtered": with_cte(RUNS, select=f"""
SELECT {BOARD_SQL} FROM board WHERE experiment IN ('FRANCE', 'JAPAN', '27')"""),
    "leaderboard_topk": with_cte(RUNS, select=f"""
SELECT {BOARD_SQL} FROM board ORDER BY {NUMBER_SQL} DESC NULLS LAST, run_id LIMIT 25"""),
    "runs_scan": with_cte(RUNS, select="""
SELECT run_id, experiment_id,
       round(CASE WHEN isnan(macro_f1) THEN -1.0::DOUBLE ELSE macro_f1 END, 9) AS macro_f1, seed
FROM runs WHERE experiment_id IN ('3', '7')"""),
    "run_tags_merge": """
WITH t AS (
  SELECT o_orderkey AS run_id, 'git_sha' AS tag, sha1(CAST(o_orderkey AS VARCHAR)) AS value FROM orders
  UNION ALL SELECT o_orderkey, 'student', CASE WHEN o_orderkey % 5 <> 0 THEN 'given' END FROM orders
  UNION ALL SELECT o_orderkey, 'job', CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END FROM orders
  UNION ALL SELECT o_orderkey, 'note', CASE WHEN o_orderkey % 2 = 0 THEN 'even' END FROM orders)
SELECT run_id, tag, value FROM t WHERE value IS NOT NULL""",
    "runs_by_seed": with_cte(RUNS, select=f"""
SELECT coalesce(name, experiment_id) AS experiment, fm, head,
       round(avg({NUMBER_SQL} * {OFF_GRID}::DOUBLE), 9) AS mean_f1,
       round(stddev_samp({NUMBER_SQL} * {OFF_GRID}::DOUBLE), 9) AS std_f1,
       count(DISTINCT seed) AS n_seeds, count(*) AS n_runs
FROM runs LEFT JOIN experiments USING (experiment_id) GROUP BY ALL"""),
    "certifiable_best": with_cte(RUNS, select=f"""
SELECT {BOARD_SQL} FROM board WHERE run_id IN (
  SELECT run_id FROM runs WHERE git_dirty = 'false' AND python_env = '/team/venv')
ORDER BY {NUMBER_SQL} DESC NULLS LAST, run_id LIMIT 1"""),
    "runs_ablation": with_cte(RUNS, select=f"""
SELECT split_part(run_name, '|', 1) AS fm, split_part(run_name, '|', 2) AS locations,
       split_part(run_name, '|', 3) AS head, max({NUMBER_SQL}) AS best_f1, count(*) AS n_runs
FROM runs WHERE run_name IS NOT NULL GROUP BY ALL"""),
    "fm_comparison": with_cte(RUNS, select=f"""
SELECT fm, best_f1, min(run_id) AS run_id, any_value(n_runs) AS n_runs FROM (
  SELECT fm, run_id, {NUMBER_SQL} AS m, max({NUMBER_SQL}) OVER (PARTITION BY fm) AS best_f1,
         count({NUMBER_SQL}) OVER (PARTITION BY fm) AS n_runs FROM runs)
WHERE m = best_f1 GROUP BY fm, best_f1"""),
    "manifest_parse": with_cte(MANIFEST, select="SELECT digest, rel, malformed FROM listed"),
    "manifest_verify": with_cte(MANIFEST, select="SELECT * FROM checked"),
    "manifest_summary": with_cte(MANIFEST, select="""
SELECT count(*) AS n, count(*) FILTER (status = 'missing') AS n_missing,
       count(*) FILTER (status = 'mismatch') AS n_mismatch,
       count(*) FILTER (status = 'malformed') AS n_malformed,
       count(*) FILTER (status <> 'ok') AS n_diverged, bool_and(status = 'ok') AS ok FROM checked"""),
    "manifest_messages": with_cte(MANIFEST, select="""
SELECT rel, CASE status WHEN 'missing' THEN 'missing: ' || rel
       WHEN 'mismatch' THEN 'hash mismatch: ' || rel || ' (expected ' || expected || ', got ' || actual || ')'
       ELSE 'malformed line: ' || expected END AS message FROM checked WHERE status <> 'ok'"""),
    "manifest_missing": with_cte(MANIFEST, select="SELECT rel FROM checked WHERE status = 'missing'"),
    "manifest_unlisted": with_cte(MANIFEST, select="""
SELECT rel FROM files WHERE rel NOT IN (SELECT rel FROM listed WHERE rel IS NOT NULL)"""),
    "manifest_generate": with_cte(FILES, select="SELECT rel, digest || '  ' || rel AS line FROM files"),
    "file_digest": with_cte(FILES, select="SELECT rel, digest FROM files"),
    "file_digest_disk": """
SELECT doc_id // 100 AS folder, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest
FROM documents GROUP BY 1""",
    "submission_hash_check": with_cte(FILES, select="""
SELECT doc_id AS run_id, digest,
       CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN reverse(digest)
            WHEN doc_id % 19 <> 0 THEN digest END AS logged,
       doc_id % 23 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AS matches FROM files"""),
    "matrix_parse": with_cte(MATRIX_LINES, select="""
SELECT line, pos, CASE WHEN isnan(val) THEN -1.0::DOUBLE WHEN isinf(val) THEN -2.0::DOUBLE ELSE val END AS val
FROM nums"""),
    "pred_flatten": """
SELECT o_orderkey AS line, CAST(i AS INTEGER) AS pos, CAST(1 + (o_orderkey + i) % 8 AS INTEGER) AS y_pred
FROM orders, range(0, 4) AS r(i)""",
    "validate_report": with_cte(MATRIX_LINES, f"""shapes AS (
  SELECT line, count(*) AS c FROM nums GROUP BY line),
facts AS (
  SELECT (SELECT count(*) FROM shapes) AS n_rows, (SELECT min(c) FROM shapes) AS lo,
         (SELECT max(c) FROM shapes) AS hi, count(*) FILTER (isnan(val)) AS n_nans,
         count(*) FILTER (val IS NULL) AS n_text, bool_or(NOT ({WHOLE_SQL})) AS fractional FROM nums),
labels AS (SELECT DISTINCT CAST(trunc(val) AS BIGINT) AS label FROM nums WHERE isfinite(val)),
seen AS (
  SELECT string_agg(label, ',' ORDER BY label) FILTER (label BETWEEN 1 AND 8) AS labels,
         count(*) FILTER (label NOT BETWEEN 1 AND 8) AS n_stray FROM labels)""", select="""
SELECT lo = hi AND n_rows = 15000 AND lo = 20 AND n_nans = 0 AND n_text = 0 AND NOT fractional
         AND n_stray = 0 AS ok,
       n_rows, CAST(CASE WHEN lo = hi THEN hi ELSE -1 END AS INTEGER) AS n_cols, n_nans, n_text,
       fractional, n_stray, labels,
       concat_ws('; ', CASE WHEN lo <> hi THEN 'ragged rows: ' || lo || ' to ' || hi || ' columns' END,
         CASE WHEN n_rows <> 15000 THEN 'expected 15000 rows, got ' || n_rows END,
         CASE WHEN lo <> 20 OR hi <> 20 THEN 'expected 20 cols, got ' ||
              CASE WHEN lo = hi THEN CAST(hi AS VARCHAR) ELSE lo || ' to ' || hi END END,
         CASE WHEN n_nans > 0 THEN n_nans || ' NaN entries' END,
         CASE WHEN n_text > 0 THEN n_text || ' entries are not numbers' END,
         CASE WHEN fractional THEN 'non-integer entries present' END,
         CASE WHEN n_stray > 0 THEN n_stray || ' labels outside allowed set' END) AS messages
FROM facts, seen"""),
    "validate_labels": with_cte(MATRIX_LINES, select="""
SELECT CAST(trunc(val) AS BIGINT) AS label, count(DISTINCT line) AS n_lines FROM nums
WHERE isfinite(val) GROUP BY 1"""),
    "validate_bad_labels": with_cte(MATRIX_LINES, select="""
SELECT DISTINCT CAST(trunc(val) AS BIGINT) AS label FROM nums
WHERE isfinite(val) AND trunc(val) NOT BETWEEN 1 AND 8"""),
    "submission_matrix": """
SELECT vec_id AS frame_idx, CAST(s AS INTEGER) AS sample, CAST(1 + vec_id % 8 AS INTEGER) AS y_pred
FROM embeddings, range(0, 500) AS r(s)""",
    "submission_lines": with_cte(ORDER_PRED, select="""
SELECT frame_idx, CAST(999 AS INTEGER) AS chars,
       sha256(rtrim(repeat(y_pred || ' ', 500))) AS digest FROM order_pred"""),
    "submission_roundtrip": with_cte(ORDER_PRED, select="""
SELECT row_number() OVER (ORDER BY frame_idx) - 1 AS "row", CAST(50 AS INTEGER) AS n_cols,
       y_pred AS low, y_pred AS high FROM order_pred"""),
    "submission_repeats": """
SELECT l_orderkey AS frame_idx, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
}
