from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from framelake.operators.integrity import (
    check_manifest,
    folder_digest,
    generate_manifest,
    manifest_summary,
    messages,
    unlisted_files,
    verify_manifest,
)
from framelake.plans.jobs import verify_raw
from framelake.session import TableError
from framelake.sources.file_listing import digest_files, list_files, packed
from framelake.sources.manifest import parse_manifest, read_manifest


CONTENTS = {
    "train/Hips/Gyr_z.txt": "".join(f"{k} {k * k}\n" for k in range(400)).encode(),
    "train/Hips/Magn_x.txt": b"\n",
    "odd na%20me/a+b.txt": bytes(range(256)) * 9000,
}


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "data"
    for rel, content in CONTENTS.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(content)
    (root / "notes.md").write_text("not listed")
    return root


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_listing_and_digests(spark, raw):
    files = list_files(spark, str(raw))
    assert {r["rel"]: r["length"] for r in files.collect()} == {rel: len(c) for rel, c in CONTENTS.items()}
    digests = {r["rel"]: r["digest"] for r in digest_files(files).collect()}
    assert digests == {rel: hashlib.sha256(c).hexdigest() for rel, c in CONTENTS.items()}


@pytest.mark.parametrize("rel,place", [("train/Hips/Gyr_z.txt", 0), ("train/Hips/Gyr_z.txt", -1), ("odd na%20me/a+b.txt", 1 << 20)])
def test_a_flipped_bit_is_found_wherever_it_is(spark, raw, tmp_path, rel, place):
    manifest = str(tmp_path / "manifest")
    assert generate_manifest(spark, str(raw), manifest) == verify_raw(spark, manifest, str(raw)) == len(CONTENTS)
    changed = bytearray(CONTENTS[rel])
    changed[place] ^= 1
    (raw / rel).write_bytes(bytes(changed))
    with pytest.raises(TableError, match="1/3 files diverged") as caught:
        verify_raw(spark, manifest, str(raw))
    [row] = caught.value.rows.collect()
    assert row["rel"] == rel and row["message"].startswith(f"hash mismatch: {rel} (expected ")


def test_all_differences_are_kept(spark, tmp_path):
    root, manifest = tmp_path / "many", tmp_path / "MANIFEST"
    root.mkdir()
    (root / "there.txt").write_text("x")
    manifest.write_text("".join(f"{k:064x}  gone-{k}.txt\n" for k in range(50)))
    with pytest.raises(TableError, match="50/50 files diverged") as caught:
        verify_raw(spark, str(manifest), str(root))
    assert {r["message"] for r in caught.value.rows.collect()} == {f"missing: gone-{k}.txt" for k in range(50)}


def test_every_kind_of_entry(spark, raw, tmp_path):
    good, manifest = sha(raw / "train" / "Hips" / "Gyr_z.txt"), tmp_path / "MANIFEST"
    manifest.write_text(
        f"# comment\n\n   \n{good}  train/Hips/Gyr_z.txt\n{good}\ttrain/Hips/Magn_x.txt  \n"
        f"{good} gone.txt\nlonely\nforlorn\n{sha(raw / 'notes.md')}  notes.md\n"
    )
    statuses = verify_manifest(spark, str(manifest), str(raw))
    assert sorted((r["rel"] or "", r["status"]) for r in statuses.collect()) == [
        ("", "malformed"), ("", "malformed"), ("gone.txt", "missing"), ("notes.md", "ok"),
        ("train/Hips/Gyr_z.txt", "ok"), ("train/Hips/Magn_x.txt", "mismatch"),
    ]
    assert tuple(manifest_summary(statuses).first()) == (6, 1, 1, 2, 4, False)
    notes = sorted(r["message"] for r in messages(statuses).collect())
    assert notes[1:] == ["malformed line: forlorn", "malformed line: lonely", "missing: gone.txt"]
    extra = unlisted_files(read_manifest(spark, str(manifest)), list_files(spark, str(raw))).collect()
    assert [r["rel"] for r in extra] == ["odd na%20me/a+b.txt"]


def test_nothing_to_hash(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="nothing to hash"):
        generate_manifest(spark, str(tmp_path / "empty"), str(tmp_path / "out"))


def test_manifest_is_in_path_order(spark, tmp_path):
    root = tmp_path / "r"
    for rel in ("a-b/x.txt", "a/z.txt", "a/b/c.txt"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(rel)
    out = tmp_path / "m"
    generate_manifest(spark, str(root), str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert [x.split("  ")[1] for x in text.splitlines()] == ["a/b/c.txt", "a/z.txt", "a-b/x.txt"]


def test_path_with_spaces_stays_whole(spark):
    row = parse_manifest(spark.createDataFrame([("  ab \t c d  ",)], "value string")).first()
    assert (row["digest"], row["rel"], row["malformed"]) == ("ab", "c d", False)


def test_repeated_entries_are_each_reported(spark):
    """A third of the manifest names the same file."""
    listed = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS rel", "'d' AS digest", "false AS malformed"
    )
    files = spark.createDataFrame([("hot", "d"), ("1", "e")], "rel string, digest string")
    row = manifest_summary(check_manifest(listed, files)).first()
    assert (row["n"], row["n_missing"], row["n_mismatch"]) == (3000, 1999, 1)


def test_folder_digest_depends_on_names_and_contents(spark):
    def digest(*rows):
        return folder_digest(spark.createDataFrame(rows, "rel string, digest string")).first()[0]

    def joined(*parts):
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    base = digest(("part-0", "1"), ("part-1", "2"))
    assert base == digest(("part-1", "2"), ("part-0", "1")) == joined(joined("1", "2"))
    assert base != digest(("part-0", "2"), ("part-1", "1"))
    many = [(f"part-{k:05d}", str(k)) for k in range(2500)]
    thousands = [joined(*[d for _, d in many[k : k + 1000]]) for k in range(0, 2500, 1000)]
    assert digest(*many) == joined(*thousands)


def test_files_are_packed_by_their_bytes(spark):
    """Many small files and a few huge ones: tasks in proportion to bytes, the huge ones alone."""
    small = spark.range(100_000).selectExpr("concat('/s/', id) AS path", "concat('s', id) AS rel", "id % 2000 AS length")
    huge = spark.range(3).selectExpr("concat('/h/', id) AS path", "concat('h', id) AS rel", "(4L << 30) + id AS length")
    files = small.unionByName(huge).repartition(7)
    dealt, tasks = packed(files, 256 << 20)
    rows = dealt.collect()
    assert len(rows) == 100_003 and {r["rel"] for r in rows} >= {"h0", "h1", "h2"}
    cost, huge_tasks = {}, set()
    for r in rows:
        cost[r["task"]] = cost.get(r["task"], 0) + (64 << 10) + (int(r["rel"][1:]) % 2000 if r["rel"][0] == "s" else 0)
        if r["rel"][0] == "h":
            huge_tasks.add(r["task"])
    assert len(huge_tasks) == 3 and max(cost) < tasks and max(cost.values()) <= (256 << 20) + (66 << 10)
    # 100,000 files at 65 kB are 25 tasks; each huge file is one, however many numbers it spans.
    assert 25 <= len(cost) <= 31
    parts = dealt.repartitionById(tasks, "task").select("task", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r["task"] == r["p"] for r in parts) and packed(files.limit(0))[1] == 1


def test_hashing_a_folder_needs_no_task_per_file(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k:03d}.txt").write_text(f"content {k}" * (k + 1))
    (tmp_path / "large.txt").write_bytes(b"x" * (3 << 20))
    found = digest_files(list_files(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    digests = {r["rel"]: r["digest"] for r in found.collect()}
    assert len(digests) == 301
    assert all(digests[p.name] == hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.txt"))
