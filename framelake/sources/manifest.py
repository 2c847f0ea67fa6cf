"""Digest manifests: lines ``<sha256>  <relative path>``, ``#`` starts a comment line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MANIFEST_LINE
from ..functions.text import strip
from ..session import materialise

_ENTRY = r"(?s)^(\S+)\s+(.*)$"


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """(digest, rel, malformed); a line of one token has no path and is marked."""
    keep = [c for c in lines.columns if c != value]
    text = strip(F.col(value))
    return (
        lines.select(*keep, text.alias("line"))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(
            *keep,
            F.regexp_extract("line", r"^(\S+)", 1).alias("digest"),
            F.when(F.col("line").rlike(r"\s"), F.regexp_extract("line", _ENTRY, 2)).alias("rel"),
            (~F.col("line").rlike(r"\s")).alias("malformed"),
        )
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def manifest_lines(digests: DataFrame) -> DataFrame:
    """(rel, line) in path order, compared folder by folder and not as one string."""
    line = F.format_string(MANIFEST_LINE, "digest", "rel").alias("line")
    return digests.select("rel", line).orderBy(F.split("rel", "/"))


def write_manifest(digests: DataFrame, out: str) -> None:
    """Write the lines in order; digests are stored first, as a global sort reads its input twice."""
    digests = materialise(digests.select("rel", "digest"), "digests")
    manifest_lines(digests).select("line").write.mode("overwrite").text(out)
