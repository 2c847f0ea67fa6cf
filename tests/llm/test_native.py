"""Decontamination against SQL on hand-made and property-made tables."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from framelake.llm import decontamination as d
from framelake.llm import queries

WORDS = ["a", "b", "É", "é", "x1", "Zeta"]


def frames(spark, docs, bench):
    left = spark.createDataFrame([(i, t, "en", i) for i, t in docs], "doc_id long, text string, pos string, row long")
    return left, spark.createDataFrame(bench, "item_id long, text string")


def by_sql(docs, bench):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    con.register("benchmark", pd.DataFrame(bench, columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    rel = con.sql(queries.OP5)
    return sorted([dict(zip(rel.columns, r)) for r in rel.fetchall()], key=str)


def by_spark(spark, docs, bench):
    rows = d.find_contamination(*frames(spark, docs, bench)).drop("spans").collect()
    return sorted([{c: r[c] for c in r.asDict()} for r in rows], key=str)


def same(left, right):
    key = lambda rows: sorted(tuple(str(r[c]) for c in sorted(r)) for r in rows)
    return key(left) == key(right)


LONG = " ".join(f"w{k}" for k in range(40))
CASES = {
    "empty tables": ([], []),
    "no benchmark": ([(1, "a b c")], []),
    "nulls": ([(None, "w1 w2"), (1, None), (None, None)], [(None, "W1, w2!"), (2, None), (3, "")]),
    "repeats": ([(1, LONG), (1, LONG), (2, LONG + " " + LONG)], [(1, LONG), (1, LONG), (2, LONG)]),
    "short items": ([(1, "x a b y a b"), (2, "a")], [(1, "A-B"), (2, "a"), (3, "a b c")]),
    "case of other letters": ([(1, "É a"), (2, "é A")], [(7, "é a")]),
    "edges": ([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (2, "w30 " * 9), (3, LONG[:60])], [(10, LONG), (9, LONG)]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    docs, bench = CASES[name]
    if not docs:
        assert by_spark(spark, docs, bench) == []
        return
    assert same(by_spark(spark, docs, bench), by_sql(docs, bench))


@pytest.mark.parametrize("seed", range(2))
def test_random_against_sql(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(WORDS) + rnd.choice([" ", ", ", "--"]) for _ in range(rnd.randint(0, n)))
    docs = [(i, text(60)) for i in range(40)]
    bench = [(i, text(14)) for i in range(12)]
    want = by_sql(docs, bench)
    assert same(by_spark(spark, docs, bench), want)
    # The way beyond the broadcast bound gives the same rows.
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert same(by_spark(spark, docs, bench), want)


def test_plan_has_no_python_and_a_hash_join(spark, sf):
    from framelake.llm.common import table

    df = d.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_removal(spark):
    docs, bench = frames(spark, [(1, f"Before. {LONG}! After."), (2, "clean text"), (3, None), (4, "")], [(1, LONG.upper())])
    whole = {r["doc_id"]: r for r in d.decontaminate(docs, bench).collect()}
    assert sorted(whole) == [2, 3, 4] and whole[2]["pos"] == "en"
    cut = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, bench, mode="spans").collect()}
    assert cut == {1: "Before. After.", 2: "clean text", 3: None, 4: ""}
    lead = spark.createDataFrame([(5, f"- {LONG} end")], "doc_id long, text string")
    assert d.decontaminate(lead, bench, mode="spans").first()["text"] == "- end"
    with pytest.raises(ValueError, match="documents or spans"):
        d.decontaminate(docs, bench, mode="words")
