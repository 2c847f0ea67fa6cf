"""Collocations against SQL on hand-made and random tables, and the trie against plain counting."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from framelake.llm import collocations as c
from framelake.llm import queries

WORDS = ["the", "of", "and", "new", "york", "city", "É", "é", "x1", "-", "\xa0", "日本"]


def frame(spark, docs, parts=3):
    rows = [(i, text, lang, 0, "p", i) for i, (lang, text) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, phrase string, a long").repartition(parts)


def by_sql(docs):
    con = duckdb.connect()
    table = pd.DataFrame(docs, columns=["lang", "text"]).astype("string")
    con.register("documents", table)
    rel = con.sql(queries.OP12)
    at = [rel.columns.index(k) for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    return sorted(tuple(row[i] for i in at) for row in rel.fetchall())


def by_spark(spark, docs):
    return sorted(tuple(r) for r in c.collocations(frame(spark, docs)).collect())


def random_docs(seed, n=60, longest=200):
    rnd = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "? ", " ; "]
    text = lambda: "".join(rnd.choice(WORDS) + rnd.choice(gaps) for _ in range(rnd.randint(0, longest)))
    return [(rnd.choice(["en", "en", "en", "de", None, "und", ""]), rnd.choice([text, text, text, str])()) for _ in range(n)]


CASES = {
    "none": [("en", None), ("en", ""), (None, " \t.,")],
    "rare": [("en", "a b c")],
    "repeats": [("en", "New York City")] * 12 + [("en", "new YORK")] * 30 + [("en", "city of")] * 10,
    "overlaps": [("en", "the " * 40 + "."), (None, "the the the " * 10)],
    "marks": [("en", "a.b,c;d:e!f?g\nh\x0bi\x0cj\rk " * 11)],
    "ties": [("en", f"{x} {y}") for x in "abcd" for y in "efgh" for _ in range(10)],
    "covered by half": [("en", "a b c")] * 10 + [("en", "a b")] * 10 + [("en", "d e f")] * 10 + [("en", "d e")] * 11,
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert by_spark(spark, CASES[name]) == by_sql(CASES[name])


def test_empty_table(spark):
    assert by_spark(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_with_bursts_and_spills(spark, seed, monkeypatch):
    docs = random_docs(seed) + [("en", "the new york city of " * 3000)]
    want = by_sql(docs)
    assert want and by_spark(spark, docs) == want
    monkeypatch.setattr(c, "BURST", 8)
    monkeypatch.setattr(c, "OWN", 3)
    monkeypatch.setattr(c, "PART_BYTES", 999)
    monkeypatch.setattr(c, "PENDING", 64)
    monkeypatch.setattr(c, "ENTRIES", 200)
    monkeypatch.setattr(c, "_BLOCK", 256)
    assert by_spark(spark, docs) == want
    monkeypatch.setattr(c, "ENTRIES", 20)
    assert by_spark(spark, docs) == want


def test_only_the_first_of_each_language(spark):
    docs = [("en", f"w{k} v{k}. " * 10) for k in range(40)] + [("de", "ein wort. " * 10)]
    whole = [tuple(r) for r in c.collocations(frame(spark, docs)).collect()]
    first = [tuple(r) for r in c.collocations(frame(spark, docs), top=7).collect()]
    assert sorted(first) == sorted(r for r in whole if r[1] <= 7) and len(first) == 8


def test_large_numbers(spark):
    # a * a * 1,000,000 and l * r pass 64 bits.
    rows = [("en", "", 7 * 10**15), ("en", "x", 3 * 10**14 + 1), ("en", "y", 3 * 10**14 + 7), ("en", "x y", 3 * 10**14)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n long")
    row = c.score_phrases(counts).first()
    a, l, r = row["a"], row["l"], row["r"]
    assert row["score"] == 1_000_000 * a * a // (l * r) == 999_999


def test_trie(monkeypatch):
    monkeypatch.setattr(c, "BURST", 8)
    monkeypatch.setattr(c, "OWN", 4)
    trie = c.HatTrie()
    rnd = random.Random(5)
    words = [[rnd.choice(WORDS[:6]) for _ in range(rnd.randint(0, 30))] for _ in range(50)]
    want = Counter(" ".join(p[s : s + m]) for p in words for m in (1, 2, 3) for s in range(len(p) - m + 1))
    for k, piece in enumerate(words):
        list(trie.read(" ".join(piece).encode()))
        if k % 10 == 0:
            trie.count()
    trie.count()
    assert trie.size == len(want) == trie.root.size() and trie.words == sum(map(len, words))
    assert trie.root.own and any(n.own for n in trie.root.own.values())
    found, seen = Counter(), {}
    chosen = [w for _, w in trie.subtrees()]
    for subtrees in (chosen[:2], chosen[2:]):
        for part, phrases, counts in trie.run(*trie.take(subtrees), 3):
            phrases = [p.decode() for p in phrases.to_pylist()]
            assert [p.split(" ") for p in phrases] == sorted(p.split(" ") for p in phrases)
            assert all(seen.setdefault(p, part) == part for p in phrases)
            found.update(dict(zip(phrases, counts.tolist())))
    assert found == want and trie.size == trie.root.size() == 0 and set(seen.values()) == {0, 1, 2}


def test_container():
    rnd, held, want = random.Random(3), c.Container(), Counter()
    for _ in range(30):
        some = Counter(rnd.randint(1, 3000) << rnd.choice([0, 21, 42]) for _ in range(500))
        keys = np.array(list(some), np.int64)
        new = held.add(keys, np.array([some[k] for k in some]))
        assert new == len(set(some) - set(want))
        want.update(some)
    keys, counts = held.items()
    assert dict(zip(keys.tolist(), counts.tolist())) == want and held.n == len(want)


def test_given_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(queries.OP12)
    df = queries.op12_collocations(spark, sf)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
