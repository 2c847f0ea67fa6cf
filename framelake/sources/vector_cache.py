"""The vector cache: commits of Parquet partitioned by model, revision, split and location, and their log.

A write fills a folder of its own, ``commit=<id>``, and then adds one record per slice to the log beside it:
rows, labels, widths, pooling, files. Readers ask the log which commit holds a slice and list only
that, so a slice is seen whole or not at all, a write that is killed leaves the old slice, and finding out
what is there costs the same however many files the cache has. Of several writes of a slice the last counts.

A folder without a log, partitioned in the same way, can be read as well. Partition values are text and
survive any spelling (``org/name``, ``a@b``, ``007``), because the schema is given and never inferred.
"""

from __future__ import annotations

import time
import warnings
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_POOLING, POOLED_LOCATION, SPLITS, TRAIN_LOCATIONS
from ..schemas import CACHE_KEYS, CACHE_SCHEMA, SLICE_SCHEMA
from . import commit_log

CACHE_ROOT_CONF = "spark.framelake.cacheRoot"
DEFAULT_CACHE_ROOT = "data/processed/embeddings"


def cache_root(spark: SparkSession, override: str | None = None) -> str:
    """Explicit argument, else the session setting, else the default folder."""
    if override is not None:
        return str(override)
    return spark.conf.get(CACHE_ROOT_CONF, DEFAULT_CACHE_ROOT)


def check_split(split: str) -> None:
    if split not in SPLITS:
        raise ValueError(f"a split is one of {', '.join(SPLITS)}, not {split!r}")


#: Between the values of a slice's name.
_MARK = "\x1f"


def _log_path(root: str) -> str:
    return f"{root}/_slices"


def slice_log(spark: SparkSession, root: str | None = None) -> DataFrame | None:
    """The record of every slice that counts; None for a folder without a log."""
    records = commit_log.read_records(spark, _log_path(cache_root(spark, root)), SLICE_SCHEMA)
    return None if records is None else commit_log.latest(records, CACHE_KEYS)


def _slice_name(*values: Column) -> Column:
    return F.concat_ws(_MARK, *[F.coalesce(v, F.lit("")) for v in values])


def _read_commits(spark: SparkSession, root: str, commits: set[str]) -> DataFrame:
    schema = T.StructType([*CACHE_SCHEMA.fields, T.StructField("commit", T.StringType())])
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/commit={c}" for c in sorted(commits)])


def read_slices(spark: SparkSession, root: str, chosen: Sequence[Row]) -> DataFrame:
    """The rows of some slices, given their records. Only their commits are listed."""
    if not chosen:
        return spark.createDataFrame([], CACHE_SCHEMA)
    rows = _read_commits(spark, root, {r["commit"] for r in chosen})
    names = _slice_name(F.col("commit"), *[F.col(k) for k in CACHE_KEYS])
    wanted = [_MARK.join(r[k] or "" for k in ("commit", *CACHE_KEYS)) for r in chosen]
    return rows.where(names.isin(wanted)).drop("commit")


def read_cache(spark: SparkSession, root: str | None = None) -> DataFrame:
    """The whole cache as one lazy table; empty when nothing was cached yet."""
    target = cache_root(spark, root)
    log = slice_log(spark, target)
    if log is not None:
        # One small record per slice.
        current = log.collect()
        held = Counter(r["commit"] for r in current)
        if any(held[r["commit"]] < r["slices"] for r in current):
            return read_slices(spark, target, current)
        return _read_commits(spark, target, set(held)).drop("commit") if held else spark.createDataFrame([], CACHE_SCHEMA)
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(target)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CACHE_SCHEMA)
        raise


def slices(table: DataFrame) -> DataFrame:
    """(fm, revision, split, location) of every slice, from a log or from a table.

    A log has one record each. For a table from files the folder names of the listing that Spark made to
    plan its scan are enough; no row is read. Another table is scanned.
    """
    files = [] if "commit" in table.columns else table.inputFiles()
    if not files:
        return table.select(*CACHE_KEYS).distinct()
    found = set()
    for name in files:
        # A folder name is escaped once by the writer and once more in a URI.
        parts = dict(p.partition("=")[::2] for p in name.split("/") if "=" in p)
        found.add(tuple(unquote(unquote(parts[k])) for k in CACHE_KEYS))
    kind = ", ".join(f"{k} string" for k in CACHE_KEYS)
    return table.sparkSession.createDataFrame(sorted(found), kind)


def _known(spark: SparkSession, root: str | None) -> DataFrame:
    """The log of a cache, or the cache itself where there is no log."""
    log = slice_log(spark, root)
    return read_cache(spark, root) if log is None else log


def cached_slices(spark: SparkSession, root: str | None = None) -> DataFrame:
    """(fm, revision, split, location) of every slice of a cache; no row of it is read."""
    return slices(_known(spark, root))


def catalog(table: DataFrame) -> DataFrame:
    """Cached (fm, revision) pairs in order; no row of the cache is read."""
    return slices(table).select("fm", "revision").distinct().orderBy("fm", "revision")


def list_available(spark: SparkSession, root: str | None = None) -> list[tuple[str, str]]:
    return [(r["fm"], r["revision"]) for r in catalog(_known(spark, root)).toLocalIterator()]


def revisions(table: DataFrame, fm: str) -> DataFrame:
    """Revisions cached for one model, in order."""
    return slices(table).where(F.col("fm") == fm).select("revision").distinct().orderBy("revision")


def resolve_revision(table: DataFrame, fm: str, revision: str | None = None) -> str:
    """Pick the revision: a given one must exist, otherwise there must be exactly one."""
    return _pick_revision([r["revision"] for r in revisions(table, fm).toLocalIterator()], fm, revision)


def _pick_revision(found: list[str], fm: str, revision: str | None) -> str:
    if revision is not None:
        if revision in found:
            return revision
        raise FileNotFoundError(f"revision {revision!r} of fm={fm!r} is not cached; found {found}")
    if not found:
        raise FileNotFoundError(f"the cache has no vectors of fm={fm!r}")
    if len(found) > 1:
        raise ValueError(
            f"fm={fm!r} has several revisions {found}; choose one with revision="
        )
    return found[0]


def _wanted_places(locations: Sequence[str] | str | None) -> list[str]:
    return [locations] if isinstance(locations, str) else list(locations or TRAIN_LOCATIONS)


def select_slice(
    cache: DataFrame,
    fm: str,
    revision: str,
    split: str,
    locations: Sequence[str] | str | None = None,
) -> DataFrame:
    """Rows of one slice: partition filters only, so unwanted files are never opened.

    The location is ignored for the test split. Without one, the other splits pool the known
    locations, whichever of them are there. Missing ``pooling`` reads as the default and the
    pooled or empty location as NULL.
    """
    check_split(split)
    rows = cache.where(
        (F.col("fm") == fm) & (F.col("revision") == revision) & (F.col("split") == split)
    )
    if split != "test":
        rows = rows.where(F.col("location").isin(_wanted_places(locations)))
    place = F.when(~F.col("location").isin("", POOLED_LOCATION), F.col("location"))
    return rows.select(
        "fm",
        "revision",
        "split",
        place.alias("location"),
        "frame_idx",
        F.col("features").cast("array<float>").alias("features"),
        F.col("y").cast("int").alias("y"),
        F.coalesce("pooling", F.lit(DEFAULT_POOLING)).alias("pooling"),
    )


def shape(rows: DataFrame) -> DataFrame:
    """One row: count, smallest and largest width, whether every row has a label."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("features")).alias("min_dim"),
        F.max(F.size("features")).alias("max_dim"),
        F.coalesce(F.every(F.col("y").isNotNull()), F.lit(False)).alias("labelled"),
    )


def logged_shape(log: DataFrame, by: Sequence[str] = CACHE_KEYS) -> DataFrame:
    """The same per ``by`` from the log alone."""
    return log.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("min_dim").alias("min_dim"),
        F.max("max_dim").alias("max_dim"),
        F.every(F.col("n") == F.col("n_labelled")).alias("labelled"),
    )


def drop_partial_labels(rows: DataFrame) -> DataFrame:
    """Keep ``y`` only if every row of the slice has one (lazy form, one scan of ``y``)."""
    labelled = rows.agg(F.every(F.col("y").isNotNull())).scalar()
    return rows.withColumn("y", F.when(labelled, F.col("y")))


def label_set(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("y").isNotNull()).select("y").distinct()


def pooled_order(rows: DataFrame) -> DataFrame:
    """Sort by the fixed location order, then by frame."""
    rank = F.array_position(F.array(*[F.lit(p) for p in TRAIN_LOCATIONS]), F.col("location"))
    return rows.orderBy(rank, "frame_idx")


@dataclass(frozen=True)
class EmbeddingSet:
    """A lazy slice of the cache together with what identifies it."""

    df: DataFrame
    fm: str
    revision: str
    split: str
    location: str | None
    pooling: str
    has_labels: bool
    n: int
    dims: tuple[int, int] | None = None

    @cached_property
    def dim(self) -> int:
        """The width of the vectors, from the log if there is one."""
        sizes = dict(zip(("min_dim", "max_dim"), self.dims)) if self.dims else shape(self.df).first()
        if sizes["min_dim"] != sizes["max_dim"]:
            raise ValueError(f"mixed widths: {sizes['min_dim']} to {sizes['max_dim']}")
        return int(sizes["max_dim"])


def embeddings(
    spark: SparkSession,
    fm: str,
    split: str,
    location: str | None = None,
    *,
    locations: Sequence[str] | None = None,
    revision: str | None = None,
    root: str | None = None,
) -> EmbeddingSet:
    """Load cached vectors of one model and split.

    ``location`` picks one place and ``locations`` several (for instance the three that occur
    in the test split); without either all places are pooled. The log tells whether the slice
    exists and is fully labelled, so no row is read; without a log one small aggregate over the
    label and pooling columns does.
    """
    check_split(split)
    places = location if location is not None else locations
    log = slice_log(spark, root)
    dims = None
    if log is None:
        cache = read_cache(spark, root)
        rev = resolve_revision(cache, fm, revision)
        rows = select_slice(cache, fm, rev, split, places)
        facts = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.count("y").alias("n_labelled"),
            F.min("pooling").alias("pooling"),
            F.max("pooling").alias("other_pooling"),
        ).first()
    else:
        # One record per revision, split and location of the model.
        known = log.where(F.col("fm") == fm).collect()
        rev = _pick_revision(sorted({r["revision"] for r in known}), fm, revision)
        chosen = [r for r in known if (r["revision"], r["split"]) == (rev, split)]
        if split != "test":
            chosen = [r for r in chosen if r["location"] in _wanted_places(places)]
        rows = select_slice(read_slices(spark, cache_root(spark, root), chosen), fm, rev, split, places)
        facts = {
            "n": sum(r["n"] for r in chosen),
            "n_labelled": sum(r["n_labelled"] for r in chosen),
            "pooling": min((r["pooling"] for r in chosen), default=None),
            "other_pooling": max((r["other_pooling"] for r in chosen), default=None),
        }
        if chosen and all(r["max_dim"] is not None for r in chosen):
            dims = (min(r["min_dim"] for r in chosen), max(r["max_dim"] for r in chosen))
    if facts["n"] == 0:
        place = f"/{location}" if location else ""
        raise FileNotFoundError(f"nothing cached at {fm}@{rev}/{split}{place}")
    if facts["pooling"] != facts["other_pooling"]:
        raise ValueError(f"mixed pooling: {facts['pooling']!r} and {facts['other_pooling']!r}")
    labelled = facts["n_labelled"] == facts["n"]
    if not labelled:
        if facts["n_labelled"]:
            warnings.warn(
                f"{fm}@{rev} {split}: some parts have no labels, so all labels are dropped",
                stacklevel=2,
            )
        rows = rows.withColumn("y", F.lit(None).cast("int"))
    return EmbeddingSet(
        df=rows,
        fm=fm,
        revision=rev,
        split=split,
        location=None if split == "test" else location,
        pooling=facts["pooling"],
        has_labels=labelled,
        n=int(facts["n"]),
        dims=dims,
    )


def write_commit(rows: DataFrame, root: str, commit: str, *, rebalance: bool = True) -> None:
    """Write rows into a folder of their own, where no reader looks before it is logged."""
    have = set(rows.columns)
    y = F.col("y") if "y" in have else F.lit(None)
    pooling = F.col("pooling") if "pooling" in have else F.lit(DEFAULT_POOLING)
    features = F.col("features").cast("array<float>")
    shaped = rows.select(
        F.col("frame_idx").cast("bigint").alias("frame_idx"),
        features.alias("features"),
        # The width beside the vectors: the log gets it without reading them.
        F.size(features).alias("dim"),
        y.cast("smallint").alias("y"),
        pooling.alias("pooling"),
        *CACHE_KEYS,
    )
    if rebalance:
        shaped = shaped.hint("rebalance", *[F.col(k) for k in CACHE_KEYS])
    shaped.write.mode("overwrite").partitionBy(*CACHE_KEYS).parquet(f"{root}/commit={commit}")


def log_commit(spark: SparkSession, root: str, commit: str) -> None:
    """Add the slices of a written commit to the log: from here on they count. A commit without rows adds nothing."""
    kind = T.StructType(
        [*[f for f in CACHE_SCHEMA.fields if f.name not in ("frame_idx", "features")], T.StructField("dim", T.IntegerType())]
    )
    light = spark.read.schema(kind).parquet(f"{root}/commit={commit}").withColumn("file", F.col("_metadata.file_path"))
    before = commit_log.read_records(spark, _log_path(root), SLICE_SCHEMA)
    if before is not None and light.isEmpty():
        return
    pooling = F.coalesce("pooling", F.lit(DEFAULT_POOLING))
    facts = light.groupBy(*CACHE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("y").alias("n_labelled"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.min(pooling).alias("pooling"),
        F.max(pooling).alias("other_pooling"),
        F.count_distinct("file").alias("files"),
        F.lit(commit).alias("commit"),
    )
    # How many slices the commit has: with fewer that count, the others must not be read.
    facts = facts.withColumn("slices", F.count(F.lit(1)).over(W.partitionBy("commit")))
    commit_log.append(facts, _log_path(root), commit_log.next_sequence(before), commit)


def write_cache(rows: DataFrame, root: str | None = None, *, rebalance: bool = True) -> str:
    """Write rows that carry their own key columns; the slices they touch are replaced.

    The rebalance hint lets adaptive execution merge small partitions and split large ones, so
    a slice that holds most of the rows is still written by many tasks. Rows that come straight
    from a scan of files already kept by slice need no such shuffle. Slices of a folder without
    a log are not replaced silently: :func:`adopt_cache` comes first.
    """
    spark = rows.sparkSession
    target = cache_root(spark, root)
    if commit_log.folders(spark, f"{target}/fm=*") and slice_log(spark, target) is None:
        raise ValueError(f"{target} holds slices without a log; adopt_cache() makes it one with a log")
    commit = commit_log.new_write_id()
    write_commit(rows, target, commit, rebalance=rebalance)
    log_commit(spark, target, commit)
    return target


def adopt_cache(spark: SparkSession, plain: str, root: str) -> str:
    """Copy a folder without a log into a cache at another place."""
    if cache_root(spark, root) == plain:
        raise ValueError("a cache is adopted into another folder")
    return write_cache(spark.read.schema(CACHE_SCHEMA).parquet(plain), root, rebalance=False)


def compact_log(spark: SparkSession, root: str | None = None) -> int:
    """One file for the log of a cache that was written often; how many files went."""
    return commit_log.compact(spark, _log_path(cache_root(spark, root)), SLICE_SCHEMA, CACHE_KEYS)


def vacuum(spark: SparkSession, root: str | None = None, keep_hours: float = 168) -> list[str]:
    """Remove the folders of commits without a slice that counts, unless a write may still be filling them.

    ``keep_hours`` has to be longer than any write and any query takes.
    """
    target = cache_root(spark, root)
    log = slice_log(spark, target)
    used = set() if log is None else {r["commit"] for r in log.select("commit").distinct().collect()}
    oldest = time.time() - 3600 * keep_hours
    gone = [p for p, at in commit_log.folders(spark, f"{target}/commit=*") if p.rpartition("=")[2] not in used and at < oldest]
    for path in gone:
        commit_log.remove(spark, path)
    return gone


def save_embedding_set(
    rows: DataFrame,
    *,
    fm: str,
    revision: str,
    split: str,
    location: str | None,
    pooling: str = DEFAULT_POOLING,
    root: str | None = None,
) -> str:
    """Write one slice: columns ``frame_idx``, ``features`` and optionally ``y``."""
    check_split(split)
    if split == "test":
        location = POOLED_LOCATION
    elif location is None:
        raise ValueError(f"vectors of {split!r} need a location, usually one of {TRAIN_LOCATIONS}")
    keyed = rows.withColumns(
        {
            "fm": F.lit(fm),
            "revision": F.lit(revision),
            "split": F.lit(split),
            "location": F.lit(location),
            "pooling": F.lit(pooling),
        }
    )
    return write_cache(keyed, root)
