"""Structure audits: the search against plain strings, whole tables against SQL."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.llm import queries
from framelake.llm import structure_audit as s

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pos long, audit string, operation string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
INITIALS = "?sua"


def put_in(held):
    """States after any insertions: {role initial: (cost, audit)}."""
    for _ in range(4):
        for state, (cost, audit) in list(held.items()):
            for role in FOLLOWS[state]:
                if role in "ua":
                    held[role] = min(held.get(role, (10**9, "")), (cost + 5, audit + "I"))
    return held


def plain(rows):
    """Least cost and audit by whole strings."""
    held = {"": (0, "")}
    for code, fault in rows:
        new = {}
        for state, (cost, audit) in put_in(dict(held)).items():
            ways = [(state, cost + 2, audit + "D")]
            if fault in (s.FINE, s.CUT_OFF):
                stays = cost + 5 * (fault == s.CUT_OFF)
                ways += [(r, stays, audit + "K") for r in FOLLOWS[state] if r == INITIALS[code]]
                ways += [(r, stays + 1, audit + "R") for r in FOLLOWS[state] if r in "ua"]
            for role, price, letters in ways:
                new[role] = min(new.get(role, (10**9, "")), (price, letters))
        held = new
    return min(v for k, v in put_in(held).items() if k in ("", "a"))


def chunked(rows, size):
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    measured = [s.transfer(p, (0, 1, 2, 3)) for p in parts]
    goal, goals = s.closing_costs(), []
    for costs, _ in reversed(measured):
        goals.append(goal)
        goal = [min(min(costs[4 * p + q] + goal[q] for q in range(4)), s._FAR) for p in range(4)]
    state, cost, audit = 0, 0, ""
    for part, (costs, ranks), goal in zip(parts, measured, reversed(goals)):
        end, tree = s.choose(costs, ranks, state, goal), s.AuditTree()
        price, node = s.search(part, state, tree)[end]
        state, cost, audit = end, cost + price, audit + tree.text(node)
    more = len(s._CLOSE[state])
    return cost + 5 * more, audit + "I" * more


@pytest.mark.parametrize("prime", [None, 3])
def test_search_against_plain_strings(prime, monkeypatch):
    if prime:
        # Nearly all hashes collide: the letters have to decide.
        monkeypatch.setattr(s, "_PRIME", prime)
    rnd = random.Random(1)
    for _ in range(400):
        rows = [(rnd.randrange(4), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 16))]
        want = plain(rows)
        assert all(chunked(rows, size) == want for size in (100, 4, 1)), rows


def test_long_run():
    rnd = random.Random(2)
    rows = [(rnd.choice([2, 3, 3, 0]), rnd.choice([0, 0, 3])) for _ in range(1500)]
    assert chunked(rows, 512) == plain(rows)


def test_comparison():
    tree, rnd = s.AuditTree(), random.Random(4)
    known = {0: ""}
    for _ in range(600):
        node, letters = rnd.choice(list(known)), "".join(rnd.choice("DIKR") for _ in range(rnd.randint(1, 9)))
        known[tree.add(node, letters)] = known[node] + letters
    for _ in range(3000):
        a, b = rnd.choice(list(known)), rnd.choice(list(known))
        sign = (known[a] > known[b]) - (known[a] < known[b])
        found = tree.compare(a, b)
        assert (found > 0) - (found < 0) == sign and tree.text(a) == known[a]


def by_sql(rows):
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    table = table.astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
    con.register("conversations", table)
    rel = con.sql(queries.OP11)
    at = [rel.columns.index(c) for c in COLUMNS]
    return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)


def by_spark(spark, rows):
    found = s.audit_damaged(frame(spark, rows))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def random_rows(seed, n):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "User", "tool", "", None, "agent"]
    texts = ["One. Two.", "No end", "", " \t\n", None, "Really?!  ", "a:b\nc.", "É.", "x" * 5000 + "."]
    text = lambda: rnd.choice(texts) if rnd.random() < 0.4 else f"Text {rnd.randint(0, 10**6)}{rnd.choice(['.', '?', ''])}"
    turn = lambda k: rnd.choice([k, k, k, k + 3, None, -k])
    return [(rnd.choice([*range(30), None]), turn(k % 9), rnd.choice(roles), text()) for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_random_tables_against_sql(spark, seed):
    rows = random_rows(seed, 400)
    assert by_spark(spark, rows) == by_sql(rows)


def test_hot_conversation_in_small_chunks(spark, monkeypatch):
    rnd = random.Random(9)
    hot = [(7, k, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"Text {k}.", f"Cut {k}", "Same."])) for k in range(700)]
    rows = hot + [(k, t, r, f"Turn {k} {t}.") for k in range(8, 200) for t, r in enumerate(["user", "assistant"])]
    want = by_sql(rows)
    found = s.repair_structure(s.damage(frame(spark, rows)), chunk=16)
    got = {r["conv_id"]: tuple(r) for r in found.summary.select(COLUMNS).collect()}
    assert all(got.get(w[0], w) == w for w in want) and len(got[7][7]) >= 600
    # The turns give what the summary says.
    turns = found.turns.where("conv_id = 7").orderBy("pos", "step").collect()
    letters = {"keep": "K", "rerole": "R", "delete": "D", "insert": "I"}
    assert "".join(letters[t["operation"]] for t in turns) == got[7][7]
    kept = "\n".join(f"{t['role']}:{t['text']}" for t in turns if t["operation"] != "delete")
    assert found.turns.sparkSession.range(1).select(F.sha2(F.lit(kept).cast("binary"), 256)).first()[0] == got[7][8]
    roles = "".join(t["role"][0] for t in turns if t["operation"] != "delete")
    assert roles.lstrip("s") == "ua" * (len(roles) // 2)


def test_repeated_rows(spark):
    rows = [(1, 0, "user", "Hello.")] * 300 + [(1, 1, "assistant", "Yes.")]
    assert by_spark(spark, rows) == by_sql(rows)


def test_nothing_left_and_empty_table(spark):
    gone = [(c, t, "user", "Hi.") for c in range(400) for t in range(1)]
    found = by_spark(spark, gone)
    assert found == by_sql(gone) and any(r[7] == "" and r[6] == 0 for r in found)
    assert by_spark(spark, []) == []


def test_text_keys(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), (None, 0, "user", "Cut")], "c string, t int, r string, x string")
    rows = {r["conv_id"]: r for r in s.repair_structure(df, "c", "t", "r", "x").summary.collect()}
    assert rows["a"]["audit"] == "KK" and rows[None]["audit"] == "D"


def test_given_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(queries.OP11)
    at = [rel.columns.index(c) for c in COLUMNS]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(map(tuple, queries.op11_structure_audit(spark, sf).select(COLUMNS).collect())) == want
