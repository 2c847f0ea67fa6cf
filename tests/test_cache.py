from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake import embeddings, list_available, save_embedding_set
from framelake.schemas import SLICE_SCHEMA
from framelake.sources.commit_log import latest, read_records
from framelake.sources.vector_cache import (
    CACHE_ROOT_CONF,
    DEFAULT_CACHE_ROOT,
    adopt_cache,
    cache_root,
    catalog,
    compact_log,
    log_commit,
    pooled_order,
    read_cache,
    resolve_revision,
    revisions,
    select_slice,
    slice_log,
    vacuum,
    write_cache,
    write_commit,
)


def vectors(spark, n=4, label="1"):
    return spark.range(n).selectExpr(
        "id AS frame_idx", "array(float(id), 1f) AS features", f"CAST({label} AS INT) AS y"
    )


def test_catalogue_reads_no_rows(spark, tmp_path):
    root = str(tmp_path / "c")
    odd = ["org/n", "a__b", "x@y", "a=b", "100%", "sp ace", "007"]
    rows = spark.createDataFrame([(k, [1.0], fm, "r/1") for k, fm in enumerate(odd)], "frame_idx long, features array<double>, fm string, revision string")
    write_cache(rows.selectExpr("*", "'train' AS split", "'Bag' AS location"), root)
    cache = read_cache(spark, root)
    assert [tuple(r) for r in catalog(cache).collect()] == sorted((fm, "r/1") for fm in odd)
    assert [r["revision"] for r in revisions(cache, "a=b").collect()] == ["r/1"]
    assert "FileScan" not in catalog(cache)._jdf.queryExecution().toString()


def test_names_survive(spark, tmp_path):
    root = str(tmp_path / "c")
    models = ["plain", "org/name", "a__b", "x@y", "a=b", "tab le"]
    revisions = ["007", "r/1", "1.50", "null"]
    pairs = sorted((m, r) for m in models for r in revisions)
    keys = spark.createDataFrame(pairs, "fm string, revision string")
    rows = keys.selectExpr(
        "*", "'train' AS split", "'Bag' AS location", "0 AS frame_idx", "array(1f, 2f) AS features",
        "1 AS y",
    )
    write_cache(rows, root)
    assert list_available(spark, root) == pairs
    for fm, revision in (("org/name", "007"), ("a__b", "r/1"), ("x@y", "null")):
        got = embeddings(spark, fm, "train", "Bag", revision=revision, root=root)
        assert (got.fm, got.revision, got.n, got.dim) == (fm, revision, 1, 2)


def test_rules_for_revisions(spark, tmp_path):
    root = str(tmp_path / "c")
    assert list_available(spark, root) == []
    with pytest.raises(FileNotFoundError):
        embeddings(spark, "m", "train", root=root)
    for rev in ("b", "a"):
        save_embedding_set(
            vectors(spark), fm="m", revision=rev, split="train", location="Bag", root=root
        )
    cache = read_cache(spark, root)
    with pytest.raises(ValueError, match=r"several revisions \['a', 'b'\]"):
        resolve_revision(cache, "m")
    assert resolve_revision(cache, "m", "a") == "a"
    with pytest.raises(FileNotFoundError, match="'c'"):
        resolve_revision(cache, "m", "c")
    with pytest.raises(FileNotFoundError):
        resolve_revision(cache, "other")


def test_errors(spark, tmp_path):
    root = str(tmp_path / "c")
    rows = vectors(spark)
    with pytest.raises(ValueError, match="a split is one of"):
        save_embedding_set(rows, fm="m", revision="1", split="dev", location="Bag", root=root)
    with pytest.raises(ValueError, match="need a location"):
        save_embedding_set(rows, fm="m", revision="1", split="train", location=None, root=root)
    save_embedding_set(rows, fm="m", revision="1", split="train", location="Bag", root=root)
    with pytest.raises(ValueError, match="a split is one of"):
        embeddings(spark, "m", "dev", root=root)
    with pytest.raises(FileNotFoundError, match="validation"):
        embeddings(spark, "m", "validation", root=root)
    with pytest.raises(FileNotFoundError, match="Hand"):
        embeddings(spark, "m", "train", "Hand", root=root)


def test_write_replaces_only_its_slice(spark, tmp_path):
    root = str(tmp_path / "c")
    for place in ("Bag", "Hips"):
        save_embedding_set(
            vectors(spark), fm="m", revision="1", split="train", location=place, root=root
        )
    save_embedding_set(
        vectors(spark, 9), fm="m", revision="1", split="train", location="Bag", root=root
    )
    assert embeddings(spark, "m", "train", "Bag", root=root).n == 9
    assert embeddings(spark, "m", "train", "Hips", root=root).n == 4
    assert embeddings(spark, "m", "train", root=root).n == 13


def test_one_unlabelled_part_drops_all_labels(spark, tmp_path):
    root = str(tmp_path / "c")
    for place, label in (("Bag", "1"), ("Hips", "NULL")):
        save_embedding_set(
            vectors(spark, label=label), fm="m", revision="1", split="train", location=place, root=root
        )
    with pytest.warns(UserWarning, match="no labels"):
        pooled = embeddings(spark, "m", "train", root=root)
    assert not pooled.has_labels
    assert pooled.df.where("y IS NOT NULL").isEmpty()
    assert embeddings(spark, "m", "train", "Bag", root=root).has_labels


def test_pooled_read_uses_known_places_in_their_order(spark, tmp_path):
    root = str(tmp_path / "c")
    for place in ("Hand", "Bag", "Elsewhere"):
        save_embedding_set(
            vectors(spark, 2), fm="m", revision="1", split="train", location=place, root=root
        )
    pooled = embeddings(spark, "m", "train", root=root)
    got = [(r["location"], r["frame_idx"]) for r in pooled_order(pooled.df).collect()]
    assert got == [("Bag", 0), ("Bag", 1), ("Hand", 0), ("Hand", 1)]


def test_mixed_pooling_is_an_error(spark, tmp_path):
    root = str(tmp_path / "c")
    for place, pooling in (("Bag", "mean"), ("Hips", "max")):
        save_embedding_set(
            vectors(spark), fm="m", revision="1", split="train", location=place, pooling=pooling, root=root
        )
    with pytest.raises(ValueError, match="mixed pooling"):
        embeddings(spark, "m", "train", root=root)
    assert embeddings(spark, "m", "train", "Hips", root=root).pooling == "max"


def test_test_split_ignores_the_location(spark, tmp_path):
    root = str(tmp_path / "c")
    save_embedding_set(
        vectors(spark).drop("y"), fm="m", revision="1", split="test", location="Bag", root=root
    )
    got = embeddings(spark, "m", "test", "Hand", root=root)
    assert (got.n, got.location, got.has_labels) == (4, None, False)
    assert got.df.first()["location"] is None


def test_scan_prunes_partitions_and_columns(spark, cache):
    rows = select_slice(read_cache(spark, cache), "synthetic", "v1", "train", "Bag")
    plan = rows.select("y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fm" in plan
    assert "ReadSchema: struct<y:smallint>" in plan
    files = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("location=Bag" in r["f"] for r in files)


def test_large_slice_is_written_by_several_tasks(spark, tmp_path):
    root = str(tmp_path / "c")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        rows = spark.range(20_000).selectExpr(
            "'m' AS fm", "'1' AS revision", "'train' AS split",
            "CASE WHEN id % 3 = 0 THEN 'Bag' ELSE 'Hips' END AS location", "id AS frame_idx",
            "transform(sequence(0, 31), i -> float(rand(7))) AS features", "1 AS y",
        )
        write_cache(rows, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "c").glob("commit=*/fm=m/revision=1/split=train/location=Hips/*.parquet"))
    assert len(files) > 1
    assert read_cache(spark, root).count() == 20_000


def keyed(spark, n, places=("Bag", "Hips"), fm="m"):
    rows = vectors(spark, n).crossJoin(spark.createDataFrame([(p,) for p in places], "location string"))
    return rows.selectExpr("*", f"'{fm}' AS fm", "'1' AS revision", "'train' AS split")


def test_the_log_tells_what_a_slice_holds(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    write_cache(keyed(spark, 5), root)
    log = {r["location"]: r for r in slice_log(spark, root).collect()}
    assert {p: (r["n"], r["n_labelled"], r["min_dim"], r["max_dim"], r["pooling"]) for p, r in log.items()} == {
        p: (5, 5, 2, 2, "mean") for p in ("Bag", "Hips")
    }
    got = embeddings(spark, "m", "train", root=root)
    assert (got.n, got.dim, got.has_labels, got.dims) == (10, 2, True, (2, 2))
    # Neither the whole cache nor any row is looked at.
    monkeypatch.setattr("framelake.sources.vector_cache.read_cache", None)
    monkeypatch.setattr("framelake.sources.vector_cache.shape", None)
    assert embeddings(spark, "m", "train", "Bag", root=root).dim == 2
    assert list_available(spark, root) == [("m", "1")]


def test_a_killed_write_leaves_the_old_slice(spark, tmp_path):
    root = str(tmp_path / "c")
    write_cache(keyed(spark, 3), root)
    write_commit(keyed(spark, 9), root, "killed")
    assert embeddings(spark, "m", "train", root=root).df.count() == 6
    assert read_cache(spark, root).count() == 6
    # The folder stays while its writer may be alive, and goes later.
    assert vacuum(spark, root) == []
    assert [p.rpartition("=")[2] for p in vacuum(spark, root, keep_hours=-1)] == ["killed"]
    assert read_cache(spark, root).count() == 6


def test_the_last_write_of_a_slice_counts(spark, tmp_path):
    root = str(tmp_path / "c")
    write_cache(keyed(spark, 3), root)
    write_cache(keyed(spark, 7, ["Hips"]), root)
    write_cache(keyed(spark, 4, ["Bag"], fm="n"), root)
    got = embeddings(spark, "m", "train", root=root)
    assert got.n == got.df.count() == 10
    assert {r["location"]: r["count"] for r in got.df.groupBy("location").count().collect()} == {"Bag": 3, "Hips": 7}
    assert read_cache(spark, root).count() == 14
    assert compact_log(spark, root) == 3 and compact_log(spark, root) == 0
    assert embeddings(spark, "m", "train", root=root).n == 10 and read_cache(spark, root).count() == 14
    assert vacuum(spark, root, keep_hours=-1) == []


def test_two_writers_leave_one_slice(spark, tmp_path):
    # Both saw the same log: the records have one sequence number, and the ids of the writes decide.
    root = str(tmp_path / "c")
    for commit, n in (("a" * 32, 3), ("b" * 32, 5)):
        write_commit(keyed(spark, n, ["Bag"]), root, commit)
    for commit in ("b" * 32, "a" * 32):
        log_commit(spark, root, commit)
        log = slice_log(spark, root)
    records = read_records(spark, f"{root}/_slices", SLICE_SCHEMA)
    assert sorted((r["sequence"], r["commit"][0]) for r in records.collect()) == [(1, "b"), (2, "a")]
    same = records.withColumn("sequence", F.lit(1).cast("long"))
    assert [r["commit"][0] for r in latest(same, ["fm", "revision", "split", "location"]).collect()] == ["b"]
    assert [r["commit"][0] for r in log.collect()] == ["a"] and embeddings(spark, "m", "train", root=root).n == 3


def test_a_folder_without_a_log(spark, tmp_path):
    plain, root = str(tmp_path / "plain"), str(tmp_path / "c")
    rows = keyed(spark, 4).withColumn("pooling", F.lit("mean")).withColumn("y", F.col("y").cast("smallint"))
    rows.write.partitionBy("fm", "revision", "split", "location").parquet(plain)
    got = embeddings(spark, "m", "train", root=plain)
    assert (got.n, got.dim, list_available(spark, plain)) == (8, 2, [("m", "1")])
    with pytest.raises(ValueError, match="without a log"):
        write_cache(keyed(spark, 1), plain)
    adopt_cache(spark, plain, root)
    assert embeddings(spark, "m", "train", "Hips", root=root).n == 4


def test_odd_places(spark, tmp_path):
    root = str(tmp_path / "c")
    rows = keyed(spark, 2, ["Bag"]).unionByName(keyed(spark, 3, ["Bag"]).withColumn("location", F.lit(None).cast("string")))
    write_cache(rows, root)
    write_cache(keyed(spark, 4, ["Bag"]), root)
    assert {r["location"]: r["n"] for r in slice_log(spark, root).collect()} == {None: 3, "Bag": 4}
    assert read_cache(spark, root).count() == 7
    # Nothing to write is no slice.
    write_cache(keyed(spark, 0), root)
    assert read_cache(spark, root).count() == 7


def test_root_order(spark):
    assert cache_root(spark, "x") == "x"
    assert cache_root(spark) == DEFAULT_CACHE_ROOT
    spark.conf.set(CACHE_ROOT_CONF, "set")
    try:
        assert cache_root(spark) == "set"
    finally:
        spark.conf.unset(CACHE_ROOT_CONF)
