"""Fingerprints, trees, shards and components against plain loops."""

from __future__ import annotations

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import queries, simhash
from framelake.llm.common import table
from framelake.llm.components import connected_components


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """Smallest key reachable over all pairs within the radius; ``prints``: key -> number."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "É a b c\x85d e", "a b a b a b a b", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 100)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def close(rnd, center, flips):
    for _ in range(flips):
        center ^= 1 << rnd.randrange(64)
    return center


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 6))
def test_tree_finds_what_a_scan_finds(seed, n, radius):
    rnd = random.Random(seed)
    center = rnd.getrandbits(64)
    values = list({close(rnd, center, rnd.randint(0, 9)) for _ in range(n)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:10] + [rnd.getrandbits(64)]:
        want = {x for x in values if (x ^ v).bit_count() <= radius}
        assert {tree.values[p] for p in tree.near(v, radius)} == want


def as_signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("most", [2000, 40])
def test_links_keep_every_component(spark, most):
    """With small shards hot blocks are cut again and dealt out to several trees."""
    rnd = random.Random(8)
    centers = [rnd.getrandbits(64) for _ in range(4)]
    values = {close(rnd, rnd.choice(centers), rnd.randint(0, 7)) for _ in range(600)} | {0, (1 << 64) - 1, 1 << 63, 7}
    prints = spark.createDataFrame([(as_signed(v),) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(prints, most=most)).collect()}
    want = plain_groups({v: v for v in values})
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(found.get(as_signed(v), as_signed(v)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_hot_group_emits_no_pairs(spark):
    rnd = random.Random(1)
    center = rnd.getrandbits(64)
    values = {close(rnd, center, rnd.randint(1, 3)) for _ in range(500)}
    prints = spark.createDataFrame([(as_signed(v),) for v in values], "fp long")
    assert simhash.links(prints).count() <= 4 * len(values)


def test_no_task_holds_a_hot_shard(spark):
    """A tree and the searches that come to it stay near their bound, and every two trees meet once."""
    rnd = random.Random(2)
    center = rnd.getrandbits(64)
    values = {close(rnd, center, rnd.randint(1, 3)) for _ in range(900)}
    prints = spark.createDataFrame([(as_signed(v),) for v in values], "fp long")
    rows = simhash.shards(prints, most=10).collect()
    groups, members, searches = {}, {}, {}
    for r in rows:
        groups[r["key"], r["part"], r["salt"]] = groups.get((r["key"], r["part"], r["salt"]), 0) + 1
        side = searches if r["searches"] else members
        side.setdefault((r["key"], r["part"], r["salt"]), set()).add(r["fp"])
    assert max(p for _, p, _ in groups) >= 16 and max(groups.values()) <= 2 * (simhash.TOGETHER + 1) * 10
    assert set(searches) <= set(members)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(500, k) for k in range(50)], [(None, 2), (3, 2), (2, 3), (9, 8)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


ROWS = [
    (5, "same words in this text"), (3, "SAME words  in this text"), (None, "same words in this text"), (9, None), (8, ""),
    (None, "alone here"), (None, "alone here"), (4, "repeat me now"), (4, "repeat me now"), (4, "another text for four"), (7, "alone"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "f", 1) for r in ROWS], "doc_id long, text string, fingerprint string, h int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_print(t) for _, t in ROWS]
    want = []
    for (i, _), p in zip(ROWS, prints):
        ids = [j for (j, _), q in zip(ROWS, prints) if p == q and j is not None]
        want.append((i, f"{p:016x}", min(ids) if ids else None))
    assert got == sorted(want, key=str)
    kept = sorted(((r["doc_id"], r["text"], r["h"]) for r in simhash.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted(
        [(3, ROWS[1][1], 1), (8, "", 1), (None, "alone here", 1), (4, "repeat me now", 1), (4, "another text for four", 1), (7, "alone", 1)],
        key=str,
    )
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    want = {(i, f"{prints[i]:016x}", g) for i, g in plain_groups(prints).items()}
    assert {tuple(r) for r in queries.op7_simhash(spark, sf).collect()} == want
