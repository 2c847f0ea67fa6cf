"""File integrity: manifest against files, and digests against logged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HASH_MISMATCH, MISSING_FILE
from ..sources.file_listing import digest_files, list_files
from ..sources.manifest import read_manifest, write_manifest


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, expected, actual, status) for every listed entry; unlisted files are ignored.

    ``files`` holds (rel, digest), so the join moves digests and never contents.
    """
    listed = manifest.select("rel", F.col("digest").alias("expected"), "malformed")
    found = files.select("rel", F.col("digest").alias("actual"))
    status = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("expected"), "mismatch")
        .otherwise("ok")
    )
    columns = ["rel", "expected", "actual", status.alias("status")]
    # Lines without a path have one NULL key: they pass by the join.
    nowhere = listed.where(F.col("rel").isNull()).withColumn("actual", F.lit(None).cast("string"))
    met = listed.where(F.col("rel").isNotNull()).join(found, "rel", "left")
    return met.select(*columns).unionByName(nowhere.select(*columns))


def unlisted_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files on disk that the manifest does not name (optional report)."""
    return files.join(manifest.select("rel"), "rel", "left_anti")


def missing_entries(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select("rel"), "rel", "left_anti")


def manifest_summary(statuses: DataFrame) -> DataFrame:
    """One row: entries checked, diverged ones by kind, verdict."""
    return statuses.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.count_if(F.col("status") == "mismatch").alias("n_mismatch"),
        F.count_if(F.col("status") == "malformed").alias("n_malformed"),
        F.count_if(F.col("status") != "ok").alias("n_diverged"),
        (F.count_if(F.col("status") != "ok") == 0).alias("ok"),
    )


def messages(statuses: DataFrame) -> DataFrame:
    """(rel, message) for every entry that diverged."""
    text = (
        F.when(F.col("status") == "missing", F.format_string(MISSING_FILE, "rel"))
        .when(
            F.col("status") == "mismatch",
            F.format_string(HASH_MISMATCH, "rel", "expected", "actual"),
        )
        .otherwise(F.concat(F.lit("malformed line: "), "expected"))
    )
    return statuses.where(F.col("status") != "ok").select("rel", text.alias("message"))


def generate_manifest(spark: SparkSession, root: str, out: str, pattern: str = "*.txt") -> int:
    """Hash all files below ``root`` into a manifest; returns their number."""
    files = list_files(spark, root, pattern)
    n = files.count()
    if n == 0:
        raise FileNotFoundError(f"nothing to hash: {root} has no {pattern} files")
    write_manifest(digest_files(files), out)
    return n


def verify_manifest(spark: SparkSession, manifest_path: str, root: str) -> DataFrame:
    """Statuses of all listed files; only listed files are hashed."""
    manifest = read_manifest(spark, manifest_path)
    files = list_files(spark, root, "*").join(manifest.select("rel"), "rel", "left_semi")
    return check_manifest(manifest, digest_files(files.select("path", "rel", "length")))


def folder_digest(parts: DataFrame) -> DataFrame:
    """One digest for a folder: SHA-256 over its part digests in the order of the parts' numbers.

    Digests of a thousand parts each are joined and hashed first, and then those hashes, so that one
    row never holds the digests of all files.
    """
    number = F.regexp_extract("rel", r"part-(\d+)", 1).try_cast("bigint")
    group = F.coalesce(F.floor(number / 1000), F.lit(-1)).alias("group")
    keyed = parts.select("rel", "digest", group)

    def joined(first: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(first, "digest")))
        return F.sha2(F.array_join(F.transform(ordered, lambda p: p["digest"]), "\n"), 256).alias("digest")

    return keyed.groupBy("group").agg(joined("rel")).agg(joined("group"))


def logged_digest_check(
    outputs: DataFrame, runs: DataFrame, tag: str = "submission_sha256"
) -> DataFrame:
    """(run_id, digest, logged, matches): outputs (run_id, digest) against the runs' tags."""
    logged = runs.select("run_id", F.try_element_at("tags", F.lit(tag)).alias("logged"))
    same = F.coalesce(F.col("digest") == F.col("logged"), F.lit(False))
    return outputs.join(logged, "run_id", "left").select(
        "run_id", "digest", "logged", same.alias("matches")
    )
