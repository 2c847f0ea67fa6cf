"""Chat repair against a search over all ways."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from framelake.llm import chat_repair as c
from framelake.llm import queries
from framelake.llm.common import table

LEGAL_AFTER = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def least_cost(roles):
    """Try every choice of role, merge and up to two empty turns before each turn."""
    best = {None: 0}
    fill = [(), *[(a,) for a in c.ROLES], *itertools.product(c.ROLES, repeat=2)]

    def walk(state, names):
        for name in names:
            if name not in LEGAL_AFTER[state]:
                return "no"
            state = name
        return state

    for role in roles:
        after = {}
        for state, cost in best.items():
            for name in c.ROLES:
                change = 0 if role == name else c.RELABEL if role in c.ROLES else c.NAME
                if state == name:
                    after[name] = min(after.get(name, 1e9), cost + change + c.MERGE)
                for extra in fill:
                    if walk(state, (*extra, name)) != "no":
                        after[name] = min(after.get(name, 1e9), cost + change + c.INSERT * len(extra))
        best = after
    ends = [cost + c.INSERT * len(e) for s, cost in best.items() for e in fill if walk(s, e) in ("assistant", None) and (e or s != "no")]
    return min(ends)


def cost_of(rows):
    price = {"keep": 0, "end": 0, "insert": c.INSERT, "merge": c.MERGE}
    total = 0
    for r in rows:
        if "relabel" in r["operation"]:
            total += c.RELABEL if c.code(r["was"]) else c.NAME
        total += price.get(r["operation"], c.MERGE if "merge" in r["operation"] else 0)
    return total


def repaired(spark, rows, chunk=c.CHUNK):
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    was = {(conv, turn): role for conv, turn, role, _ in rows}
    found = defaultdict(list)
    for r in c.repair(chats, chunk=chunk).collect():
        found[r["conv_id"]].append(r.asDict() | {"was": was.get((r["conv_id"], r["turn"]))})
    return {k: sorted(v, key=lambda r: (r["position"], r["step"])) for k, v in found.items()}


def legal(rows):
    state = None
    for r in rows:
        if r["operation"] == "end":
            assert state == "assistant"
        elif "merge" in r["operation"]:
            assert r["role"] == state
        else:
            assert r["role"] in LEGAL_AFTER[state]
            state = r["role"]


@pytest.fixture(scope="module")
def chats():
    rnd = random.Random(3)
    names = ["system", "user", "assistant", "tool", None, " User "]
    return [(k, t, rnd.choice(names), f"t{k}.{t}") for k in range(60) for t in range(rnd.randint(1, 9))]


def test_cheapest_and_legal(spark, chats):
    found = repaired(spark, chats)
    by_conv = defaultdict(list)
    for conv, _, role, _ in chats:
        by_conv[conv].append((role or "").strip().lower())
    assert set(found) == set(by_conv)
    for conv, rows in found.items():
        legal(rows)
        assert cost_of(rows) == least_cost(by_conv[conv]), by_conv[conv]


def test_chunks_do_not_matter(spark, chats):
    hot = [(1000, t, ["user", "assistant", "user", "tool"][t * 7 % 4], f"x{t}") for t in range(700)]
    whole = repaired(spark, chats + hot)
    assert repaired(spark, chats + hot, chunk=3) == whole
    legal(whole[1000])
    assert cost_of(whole[1000]) == least_cost([r[2] for r in hot])


def test_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b<|im_end|>"), (2, 0, "assistant", None), (3, 5, "system", "s")]
    found = repaired(spark, rows)
    text = {k: "".join(r["fragment"] for r in v) for k, v in found.items()}
    assert text[1] == "<|im_start|>user\na\n\nb<| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[3].startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|im_end|>")


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "n"), (1, 0, "assistant", "z" * 100_000)]
    chats = spark.createDataFrame([(*r, 0, "p") for r in rows], "conv_id long, turn long, role string, text string, position int, step string")
    got = c.repair(chats).collect()
    assert {r["conv_id"] for r in got} == {None, 1}
    assert [r["operation"] for r in sorted(got, key=lambda r: (r["position"], r["step"])) if r["conv_id"] == 1] == ["keep", "keep", "end"]
    assert c.repair(chats.limit(0)).count() == 0


def test_query(spark, sf):
    chats = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = defaultdict(list)
    was = {(a, b): r for a, b, r, _ in chats}
    for r in queries.op2_chat_repair(spark, sf).collect():
        found[r["conv_id"]].append(r.asDict() | {"was": was.get((r["conv_id"], r["turn"]))})
    assert len(found) == len({a for a, *_ in chats})
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r["position"], r["step"]))
        legal(rows)
        roles = [r for _, _, r in sorted((b, t, r) for a, b, r, t in chats if a == conv)]
        assert cost_of(rows) == least_cost(roles)
        for a, b, _, t in chats:
            if a == conv:
                assert any(r["turn"] == b and r["fragment"].endswith(t) for r in rows)
