"""Sharding: the law of sizes, slots, groups together, hot groups and odd rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from framelake.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard int, slot string, row long, m long"


def frame(spark, texts, parts=4):
    rows = [(i, t, 5, "x", i, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def shards(df, n_shards=8):
    rows = sharding.shard_documents(df, n_shards).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(n_shards))
    counts = [sizes.get(j, 0) for j in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def spread(rows, texts):
    """Shards of each text that occurs more than once."""
    found = defaultdict(Counter)
    for r in rows:
        found[texts[r["doc_id"]] or ""][r["shard"]] += 1
    return {t: c for t, c in found.items() if sum(c.values()) > 1}


def test_columns(spark):
    texts = ["a", "é" * 3, None, ""]
    rows = {r["doc_id"]: r for r in shards(frame(spark, texts), 2)}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert rows[i]["law"] == "rows" and rows[i]["grown_shard"] is None
    assert rows[2]["shard"] == rows[3]["shard"]


@pytest.mark.parametrize("n", [0, 1, 3, 8, 17])
def test_few_rows(spark, n):
    assert len(shards(frame(spark, [f"t{i}" for i in range(n)]))) == n


def test_groups_meet(spark):
    texts = [f"group {i % 150}" for i in range(600)] + [f"single {i}" for i in range(400)]
    rows = shards(frame(spark, texts))
    assert all(len(c) == 1 for c in spread(rows, texts).values())


def test_only_groups(spark):
    # No free documents: borders between shards may cut one group each.
    texts = [f"group {i // 7}" for i in range(700)]
    assert sum(len(c) > 1 for c in spread(shards(frame(spark, texts)), texts).values()) <= 7


def test_hot_group(spark):
    texts = ["hot"] * 2000 + [f"pair {i // 2}" for i in range(1000)] + [f"single {i}" for i in range(3000)]
    found = spread(shards(frame(spark, texts, 16)), texts)
    hot = found.pop("hot")
    # A third of the rows needs 2.67 shards.
    assert len(hot) <= 4 and sum(sorted(hot.values())[-2:]) >= 1400
    assert all(len(c) == 1 for c in found.values())


def test_one_text(spark):
    assert len(shards(frame(spark, ["same"] * 1001))) == 1001


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 4 + [(None, "long " * 100_000)], "doc_id long, text string")
    rows = shards(df, 3)
    assert len(rows) == 10 and max(r["size"] for r in rows) == 500_001


def test_propagation_lessens_the_cut(spark):
    # Members dealt at random: the rounds bring each group together.
    rows = spark.range(2000).selectExpr("id AS row", "id % 100 AS group", "20L AS m", "CAST(pmod(xxhash64(id), 8) AS int) AS shard")
    before = sharding.cut_pairs(rows).first()
    state, moved = rows, 0
    for turn in range(8):
        state, n = sharding._round(state, sharding.quotas(8000, 8), 8, turn)
        moved += n
    after = sharding.cut_pairs(state).first()
    assert before["cut"] > 0.8 * float(before["pairs"]) and moved > 1000
    assert after["cut"] == 0 and after["pairs"] == 100 * 190
    assert max(r["count"] for r in state.groupBy("shard").count().collect()) <= 1000


def test_given_table(spark, sf):
    rows = queries.op13_sharding(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert dict(rows.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
        "grown_shard": "int",
    }


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op13_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
