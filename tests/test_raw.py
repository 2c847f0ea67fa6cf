from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import embeddings, read_experiments, read_runs
from framelake.constants import CHANNELS, EXPECTED_SHARDS
from framelake.operators.embed import embed_frames, embed_statistics
from framelake.operators.frames import (
    assemble_frames,
    channel_stats,
    check_counts,
    frame_sanity,
    incomplete_frames,
    line_stats,
    normalise,
    repeated_lines,
)
from framelake.operators.leaderboard import ablation, run_table
from framelake.plans import jobs
from framelake.session import TableError
from framelake.sources.raw_files import read_raw, unexpected_files

N, WIDTH = 40, 6


def write_file(root, split, place, channel, rows):
    folder = root / split / place
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{channel}.txt").write_text("\n".join(" ".join(map(str, r)) for r in rows) + "\n")


@pytest.fixture
def raw_root(tmp_path):
    """Three splits; classes differ in the mean of every channel."""
    rng = np.random.default_rng(5)
    root = tmp_path / "raw"
    for split, places in (
        ("train", ("Bag", "Hips", "Torso", "Hand")),
        ("validation", ("Bag", "Hips", "Torso", "Hand")),
        ("test", ("Bag",)),
    ):
        for place in places:
            y = 1 + np.arange(N) % 8
            for j, c in enumerate(CHANNELS):
                mean = np.sin(y * (j + 1.0)) * 5
                block = (mean[:, None] + rng.normal(0, 0.2, (N, WIDTH))).round(4)
                write_file(root, split, place, c, block)
            if split != "test":
                labels = np.repeat(y[:, None], WIDTH, axis=1)
                labels[:, :2] = 1 + labels[:, :2] % 8
                write_file(root, split, place, "Label", labels)
    return root


@pytest.mark.parametrize("size", ["128m", "1k", "333", "64"])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, size):
    root = tmp_path / "raw"
    rows = [[i, i + 0.5] for i in range(700)]
    write_file(root, "train", "Bag", "Acc_x", rows)
    write_file(root, "train", "Hips", "Acc_x", rows[:123])
    # Blank and comment lines are not frames.
    folder = root / "train" / "Hand"
    folder.mkdir(parents=True)
    (folder / "Acc_x.txt").write_text("# head\n" + "".join(f"{i} 1\n\n" for i in range(90)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_raw(spark, str(root)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 700 + 123 + 90
    assert all(r["samples"][0] == r["frame_idx"] for r in got)


def test_part_files_count_as_one_file(spark, tmp_path):
    folder = tmp_path / "raw" / "train" / "Bag" / "Acc_x.txt"
    folder.mkdir(parents=True)
    for part in range(3):
        (folder / f"part-{part:05d}.txt").write_text("".join(f"{part * 10 + i}\n" for i in range(10)))
    got = read_raw(spark, str(tmp_path / "raw")).collect()
    assert sorted(r["frame_idx"] for r in got) == list(range(30))
    assert all(r["samples"][0] == r["frame_idx"] for r in got)


def test_frames_and_labels(spark, raw_root):
    frames = assemble_frames(read_raw(spark, str(raw_root)))
    assert frames.count() == 9 * N
    row = frames.where("split = 'train' AND location = 'Hips' AND frame_idx = 9").first()
    assert row["y"] == 2
    lines = (raw_root / "train" / "Hips" / "Magn_z.txt").read_text().splitlines()
    assert row["Magn_z"] == pytest.approx([float(x) for x in lines[9].split()])
    assert frames.where("split = 'test' AND y IS NOT NULL").isEmpty()


def test_label_tie_takes_the_smallest(spark):
    raw = spark.createDataFrame(
        [("train", "Bag", 0, "Label", [5.0, 3.0, 5.0, 3.0]), ("train", "Bag", 0, "Acc_x", [1.0])],
        "split string, location string, frame_idx long, channel string, samples array<float>",
    )
    assert assemble_frames(raw).first()["y"] == 3


def test_sanity(spark, tmp_path):
    root = tmp_path / "raw"
    for c in CHANNELS[:-1]:
        n = 3 if c == "Gyr_x" else 4
        write_file(root, "train", "Bag", c, [[1, 2]] * n)
    write_file(root, "train", "Bag", "Acc_y", [[1, 2], [1], [1, "x"], [1, 2, 3]])
    raw = read_raw(spark, str(root))
    got = {(r["check"], r["detail"], r["found"], r["expected"]) for r in frame_sanity(raw, 2).collect()}
    assert got == {
        ("channel missing", "Magn_z", 0, 1),
        ("frame count", "Gyr_x", 3, 4),
        ("shortest line", "Acc_y", 1, 2),
        ("longest line", "Acc_y", 3, 2),
        ("unreadable lines", "Acc_y", 1, 0),
    }
    published = frame_sanity(raw, 2, frames_per_file={"train": 5}).where(F.col("check") == "frame count")
    assert published.count() == 8
    with pytest.raises(TableError, match="[0-9]+ violations") as caught:
        check_counts(raw, 2)
    found = {(r["split"], r["location"], r["check"], r["detail"]) for r in caught.value.rows.collect()}
    # Labels of the one train folder, and every folder that is not there.
    assert ("train", "Bag", "channel missing", "Label") in found
    assert {(s, p) for s, p, check, _ in found if check == "location missing"} == set(EXPECTED_SHARDS) - {("train", "Bag")}
    assert caught.value.rows.count() == len(found)
    short = incomplete_frames(assemble_frames(raw), 2).collect()
    assert {(r["frame_idx"], r["channel"]) for r in short} == (
        {(i, "Magn_z") for i in range(4)} | {(3, "Gyr_x"), (1, "Acc_y"), (3, "Acc_y")}
    )


def test_zscore(spark, raw_root):
    frames = assemble_frames(read_raw(spark, str(raw_root)))
    scaled = normalise(frames)
    stats = channel_stats(scaled.where("split = 'train'")).first()
    for c in CHANNELS:
        assert stats[c]["mean"] == pytest.approx(0, abs=1e-6)
        assert stats[c]["std"] == pytest.approx(1, abs=1e-6)
    test = channel_stats(scaled.where("split = 'test'")).first()
    assert any(abs(test[c]["mean"]) > 1e-4 for c in CHANNELS)
    inside = normalise(frames, "frame").first()
    assert np.mean(inside["Acc_x"]) == pytest.approx(0, abs=1e-6)
    assert np.std(inside["Acc_x"]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError, match="unknown scope"):
        normalise(frames, "day")


def test_constant_channel_becomes_zero(spark):
    cols = [f"array(2f, 2f) AS {c}" for c in CHANNELS]
    frames = spark.range(3).selectExpr("id AS frame_idx", "'train' AS split", "'Bag' AS location", *cols)
    for scope in ("train", "frame"):
        assert normalise(frames, scope).first()["Gyr_y"] == [0.0, 0.0]


def test_embedders_agree(spark, raw_root):
    frames = assemble_frames(read_raw(spark, str(raw_root))).where("split = 'test'")

    def load():
        def embed(block):
            parts = [block.mean(2), block.std(2), block.min(2), block.max(2)]
            return np.stack(parts, axis=2).reshape(len(block), -1)

        return embed

    a = {r["frame_idx"]: r["features"] for r in embed_statistics(frames).collect()}
    b = {r["frame_idx"]: r["features"] for r in embed_frames(frames, load, n_samples=WIDTH, batch_rows=7).collect()}
    assert len(a) == N and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-4)


def test_missing_and_short_channels_enter_as_zeros(spark):
    schema = "frame_idx long, Acc_x array<float>, Acc_y array<float>"
    frames = spark.createDataFrame([(0, [1.0, 2.0, 3.0], None), (1, [4.0], [5.0, 6.0])], schema)
    flat = embed_frames(frames, lambda: lambda b: b.reshape(len(b), -1), channels=("Acc_x", "Acc_y"), n_samples=3)
    got = {r["frame_idx"]: r["features"] for r in flat.coalesce(1).collect()}
    assert {k: [x for x in v if x] for k, v in got.items()} == {0: [1.0, 2.0, 3.0], 1: [4.0, 5.0, 6.0]}


def test_width_does_not_depend_on_the_batch(spark):
    schema = "frame_idx long, Acc_x array<float>"
    frames = spark.createDataFrame([(0, [1.0]), (1, [1.0, 1.0])], schema).coalesce(1)
    mean = lambda: lambda block: block.mean(2)
    for rows in (1, 2):
        got = embed_frames(frames, mean, channels=("Acc_x",), n_samples=2, batch_rows=rows).collect()
        assert {r["frame_idx"]: r["features"] for r in got} == {0: [0.5], 1: [1.0]}
    with pytest.raises(Exception, match="does not fit frames of 1"):
        embed_frames(frames, mean, channels=("Acc_x",), n_samples=1).collect()


def test_other_files_are_reported_and_not_read(spark, raw_root, tmp_path):
    before = read_raw(spark, str(raw_root)).count()
    odd = {"README.txt": "layout", "train/notes.txt": "layout", "train/Bag/Temp.txt": "channel", "night/Bag/Acc_x.txt": "split", "train/Moon/Acc_x.txt": "location"}
    for rel in odd:
        (raw_root / rel).parent.mkdir(parents=True, exist_ok=True)
        (raw_root / rel).write_text("1 2 3\n")
    try:
        assert {r["rel"]: r["fault"] for r in unexpected_files(spark, str(raw_root)).collect()} == odd
        assert read_raw(spark, str(raw_root)).count() == before
        with pytest.raises(TableError, match="5 files are no raw files"):
            jobs.window_features(spark, str(raw_root), str(tmp_path / "out"), n_samples=WIDTH)
    finally:
        for rel in odd:
            (raw_root / rel).unlink()


def test_test_frames_of_two_locations_are_refused(spark, raw_root, tmp_path):
    frames = assemble_frames(read_raw(spark, str(raw_root)))
    again = frames.where("split = 'test'").withColumn("location", F.lit("Hips"))
    from framelake.operators.frames import write_frames

    root = str(tmp_path / "frames")
    write_frames(frames.where("split = 'test'").withColumn("location", F.lit("Bag")).unionByName(again), root)
    with pytest.raises(TableError, match=f"{N} test frames occur in several locations"):
        jobs.frozen_embeddings(spark, root, fm="m", revision="1", root=str(tmp_path / "cache"))


@pytest.fixture
def test_places(raw_root):
    """Three test folders of unequal size, written in another order than the fixed one."""
    rng = np.random.default_rng(6)
    sizes = {"Torso": 13, "Hips": 29, "Bag": N}
    for place, n in sizes.items():
        if place != "Bag":
            y = 1 + np.arange(n) % 8
            for j, c in enumerate(CHANNELS):
                mean = np.sin(y * (j + 1.0)) * 5
                write_file(raw_root, "test", place, c, (mean[:, None] + rng.normal(0, 0.2, (n, WIDTH))).round(4))
    return sizes


def test_test_locations_are_one_sequence(spark, raw_root, test_places):
    raw = read_raw(spark, str(raw_root), pool_test=True, facts=True)
    spans = raw.groupBy("split", "location", "channel").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    found = {(r["split"], r["location"]): (r["a"], r["b"]) for r in spans.collect()}
    assert found["test", "Bag"] == (0, N - 1)
    assert found["test", "Hips"] == (N, N + 28) and found["test", "Torso"] == (N + 29, N + 41)
    assert all(v == (0, N - 1) for k, v in found.items() if k[0] != "test")
    lines = (raw_root / "test" / "Torso" / "Gyr_y.txt").read_text().splitlines()
    row = raw.where(f"split = 'test' AND channel = 'Gyr_y' AND frame_idx = {N + 29 + 5}").first()
    assert row["location"] == "Torso" and row["samples"] == pytest.approx([float(x) for x in lines[5].split()])
    # Without a common sequence every location counts from 0.
    assert read_raw(spark, str(raw_root)).where("split = 'test'").agg(F.max("frame_idx")).first()[0] == N - 1


def test_the_number_of_test_frames_is_that_of_the_split(spark, raw_root, test_places):
    raw = read_raw(spark, str(raw_root), pool_test=True, facts=True)
    total = sum(test_places.values())

    def found(n):
        rows = frame_sanity(raw, WIDTH, frames_per_file={"train": N, "validation": N}, frames_per_split={"test": n}).collect()
        return [tuple(r) for r in rows]

    assert found(total) == []
    assert found(92_726) == [("test", "all", "frame count", "all locations", total, 92_726)]
    with pytest.raises(TableError) as caught:
        check_counts(raw, WIDTH)
    published = caught.value.rows.where("split = 'test'").collect()
    assert [(r["location"], r["found"]) for r in published] == [("all", total)]


def test_three_test_folders_reach_the_matrix(spark, raw_root, test_places, tmp_path):
    frames, cache, head, out = (str(tmp_path / k) for k in ("frames", "cache", "head", "predictions"))
    total = sum(test_places.values())
    jobs.window_features(spark, str(raw_root), frames, n_samples=WIDTH, check=False)
    jobs.frozen_embeddings(spark, frames, fm="stats", revision="1", root=cache)
    jobs.train_head(spark, "stats", "linear", root=cache, out=head)
    rows = jobs.predict_test(spark, head, out, root=cache).collect()
    assert sorted(r["frame_idx"] for r in rows) == list(range(total))
    starts = {"Bag": 0, "Hips": N, "Torso": N + 29}
    truth = {starts[p] + k: 1 + k % 8 for p, n in test_places.items() for k in range(n)}
    assert np.mean([truth[r["frame_idx"]] == r["y_pred"] for r in rows]) > 0.8
    report = jobs.format_submission(spark, out, str(tmp_path / "matrix"), expected_rows=total)
    assert report.ok and report.n_rows == total


def test_lines_are_not_moved_and_blocks_not_broadcast(spark, raw_root):
    raw = read_raw(spark, str(raw_root))
    raw.collect()
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Bucketed: true" in plan
    # What is shuffled are counts of blocks; samples are in no exchange.
    parts = plan.split("Exchange hashpartitioning")
    assert len(parts) > 1 and all("samples" not in p.split("FileScan")[0] for p in parts[1:])


def test_statistics_come_with_the_lines(spark, raw_root):
    raw = read_raw(spark, str(raw_root), facts=True)
    train = raw.where("split = 'train'")
    stored, again = line_stats(train).first(), channel_stats(assemble_frames(train)).first()
    for c in CHANNELS:
        assert (stored[c]["mean"], stored[c]["std"]) == pytest.approx((again[c]["mean"], again[c]["std"]), abs=1e-12)
    plan = line_stats(train)._jdf.queryExecution().executedPlan().toString()
    assert "samples" not in plan


def test_repeated_lines(spark):
    raw = spark.createDataFrame(
        [("train", "Bag", 0, "Acc_x", [1.0]), ("train", "Bag", 0, "Acc_x", [2.0]), ("train", "Bag", 0, "Acc_y", [1.0])],
        "split string, location string, frame_idx long, channel string, samples array<float>",
    )
    assert [(r["channel"], r["n"]) for r in repeated_lines(raw).collect()] == [("Acc_x", 2)]


def test_frames_are_sorted_once(spark):
    raw = spark.range(10).selectExpr(
        "concat('train', id) AS split", "concat('Bag', id) AS location", "id AS frame_idx", "'Acc_x' AS channel",
        "array(1f) AS samples",
    )
    plan = assemble_frames(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("- Sort [") == 1


def test_all_stages(spark, raw_root, tmp_path):
    frames, cache = str(tmp_path / "frames"), str(tmp_path / "cache")
    jobs.window_features(spark, str(raw_root), frames, n_samples=WIDTH, check=False)
    jobs.frozen_embeddings(spark, frames, fm="stats", revision="007", root=cache)
    train = embeddings(spark, "stats", "train", root=cache)
    assert (train.n, train.dim, train.has_labels, train.revision) == (4 * N, 36, True, "007")
    model, result = jobs.train_head(
        spark, "stats", "linear", root=cache, store=str(tmp_path / "store"), out=str(tmp_path / "head"),
        locations=["Bag", "Hips", "Torso"],
    )
    assert result.macro_f1 > 0.8
    predicted = jobs.predict_test(spark, str(tmp_path / "head"), str(tmp_path / "preds"), root=cache)
    truth = [1 + r["frame_idx"] % 8 for r in predicted.collect()]
    assert np.mean([r["y_pred"] == t for r, t in zip(predicted.collect(), truth)]) > 0.8
    store = str(tmp_path / "store")
    report = jobs.format_submission(
        spark, str(tmp_path / "preds"), str(tmp_path / "submission"), expected_rows=N, store=store, tags={"git_dirty": False}
    )
    assert report.ok and report.n_rows == N
    board = run_table(read_runs(spark, store), read_experiments(spark, store), params=("seed",))
    assert {r["run_name"] for r in board.collect()} == {"stats|3loc|linear", "submission"}
    best = ablation(board).collect()
    assert [(r["fm"], r["locations"], r["head"]) for r in best] == [("stats", "3loc", "linear")]
    # The logged digest is that of the files, whoever computes it.
    parts = sorted((tmp_path / "submission").glob("part-*"))
    own = hashlib.sha256("\n".join(hashlib.sha256(p.read_bytes()).hexdigest() for p in parts).encode()).hexdigest()
    logged = read_runs(spark, store).where("tags['run_name'] = 'submission'").first()["tags"]
    assert logged["submission_sha256"] == hashlib.sha256(own.encode()).hexdigest() and logged["git_dirty"] == "false"
    flat = tmp_path / "flat.txt"
    flat.write_text("# classes\n1 2 3\n\n4\n5 6\n")
    texts = jobs.format_submission(spark, str(flat), str(tmp_path / "from-text"), expected_rows=6, text=True)
    assert texts.ok
    lines = "".join(p.read_text() for p in sorted((tmp_path / "from-text").glob("part-*"))).splitlines()
    assert [int(x.split(" ", 1)[0]) for x in lines] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="expected 92726 rows"):
        jobs.format_submission(spark, str(tmp_path / "preds"), str(tmp_path / "submission"))


def test_cached_slices_are_not_embedded_again(spark, raw_root, tmp_path):
    frames, cache = str(tmp_path / "frames"), str(tmp_path / "cache")
    jobs.window_features(spark, str(raw_root), frames, check=False)
    jobs.frozen_embeddings(spark, frames, fm="m", revision="1", root=cache)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}

    def explode():
        raise AssertionError("nothing is left to embed")

    jobs.frozen_embeddings(spark, frames, fm="m", revision="1", root=cache, load=explode)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert before == after


def test_normalisation_needs_train_frames(spark, tmp_path):
    for c in CHANNELS:
        write_file(tmp_path / "raw", "test", "Bag", c, [[1, 2]])
    with pytest.raises(ValueError, match="train frames"):
        jobs.window_features(spark, str(tmp_path / "raw"), str(tmp_path / "out"), check=False)
