"""Phrase collocations: phrases whose words meet more often than their parts would by chance.

Phrases of up to three words are counted with a HAT-trie in every task: a shallow trie of word ids whose
leaves are hash containers. A word id has 21 bits, so a phrase is one 63-bit number. All phrases of a
language start in the container of the root; a container above ``BURST`` phrases bursts, and each next word
with ``OWN`` phrases of its own gets a subtree. A task that holds ``ENTRIES`` phrases spills whole
subtrees, the largest first, as sorted runs; what is frequent stays and goes on counting.

A run is cut by hash partitions of the whole phrase, and a piece is one small row: phrases in the order of
their words, compressed. The partitions are as many as the text has ``PART_BYTES``, so a merge task
holds one partition whatever the input. They are not cut by first words, since the runs below one common
word, or pair of words, would be more than a task can take. Only phrases that occur ``min_count`` times leave
the merge. Every part of such a phrase is at least as frequent, so scores come from joins of that much
smaller table with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.session import materialise

from .common import small_batches

#: What parts pieces, and what parts words.
PIECE_MARKS = b".,;:!?\n\x0b\x0c\r"
WORD_MARKS = b" \t"
LONGEST = 3
MIN_COUNT = 10
TOP = 2000
UNIT = 1_000_000
COVERED_PERCENT = 50

#: Phrases in a container before it bursts, and those of a next word that become a subtree.
BURST, OWN = 1 << 18, 1 << 13
#: Phrases in a task before it spills; a word counts as four.
ENTRIES = 900_000
#: Word places read before they are counted.
PENDING = 1 << 18
#: Text per partition of the merge.
PART_BYTES = 4 << 20
_BLOCK = 1 << 20
_BITS = 21
_MASK = (1 << _BITS) - 1
_SHIFTS = (2 * _BITS, _BITS, 0)
_RUNS = "lang string, part long, entries long, raw long, phrases binary, counts binary"
_COUNTS = "lang string, phrase string, n long"

#: A byte of the text to what the splitting reads: A-Z in lower case, one mark for pieces, one for words.
_PLAIN = bytes(
    10 if b in PIECE_MARKS else 32 if b in WORD_MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


class WordIds(dict):
    """Word ids in order of first use; 0 parts pieces and 1 is no word."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Container:
    """Counts by phrase number, hashed with open addressing; whole arrays of phrases are added at once."""

    def __init__(self) -> None:
        self.n = 0
        self._clear(10)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.int64)
        self.counts = np.zeros(1 << bits, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys != 0
        return self.keys[used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> int:
        """Add phrases, each once; how many of them are new."""
        before = self.n
        if (self.n + len(keys)) * 2 > len(self.keys):
            old = self.items()
            self._clear(int((self.n + len(keys)) * 2).bit_length())
            self.n = 0
            self._put(*old)
        self._put(keys, counts)
        return self.n - before

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.keys) - 1
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            found = self.keys[at]
            free = found == 0
            self.keys[at[free]] = keys[free]
            # Of several phrases for one free place the last is there now.
            mine = self.keys[at] == keys
            self.n += int((mine & free).sum())
            self.counts[at[mine]] += counts[mine]
            other = ~mine
            keys, counts, at = keys[other], counts[other], (at[other] + 1) & mask


class Node:
    """Phrases below a place of the trie: a container, and subtrees of the next words that have many."""

    def __init__(self, level: int = 0) -> None:
        self.level = level
        self.rest = Container()
        self.own: dict[int, Node] = {}
        self.limit = BURST

    def size(self) -> int:
        return self.rest.n + sum(n.size() for n in self.own.values())

    def add(self, keys: np.ndarray, counts: np.ndarray) -> int:
        """Add sorted phrases, each once; how many of them are new."""
        new, left = 0, np.ones(len(keys), bool)
        if self.own:
            words = keys >> _SHIFTS[self.level] & _MASK
            known = np.fromiter(self.own, np.int64, len(self.own))
            starts, ends = np.searchsorted(words, known, "left"), np.searchsorted(words, known, "right")
            for k in np.flatnonzero(starts < ends).tolist():
                start, end = int(starts[k]), int(ends[k])
                new += self.own[int(known[k])].add(keys[start:end], counts[start:end])
                left[start:end] = False
        new += self.rest.add(keys[left], counts[left])
        if self.rest.n > self.limit and self.level + 1 < LONGEST:
            self._burst()
        return new

    def _burst(self) -> None:
        keys, counts = self.rest.items()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        words, sizes = np.unique(keys >> _SHIFTS[self.level] & _MASK, return_counts=True)
        self.rest = Container()
        for word in words[sizes >= OWN].tolist():
            self.own[word] = Node(self.level + 1)
        self.limit = 1 << 62
        self.add(keys, counts)
        self.limit = max(BURST, 2 * self.rest.n)

    def items(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.rest.items(), *[pair for n in self.own.values() for pair in n.items()]]


class HatTrie:
    """Phrases of one language."""

    def __init__(self) -> None:
        self.ids = WordIds()
        self.root = Node()
        self.size = 0
        self.words = 0
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.last = np.zeros(0, np.int64)

    def held(self) -> int:
        """Phrases and words in memory, and a part for the places still to be counted."""
        return self.size + 4 * len(self.ids) + self.n_pending // 8

    def read(self, text: bytes) -> Iterator[None]:
        """Take in a whole text, block by block; blocks end between words."""
        text = text.translate(_PLAIN)
        start = 0
        while start < len(text):
            end = start + _BLOCK
            if end < len(text):
                ends = [e for e in (text.find(b" ", end), text.find(b"\n", end)) if e >= 0]
                end = min(ends, default=len(text))
            tokens = text[start:end].replace(b"\n", b" \n ").split(b" ")
            places = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
            self._add(places[places != 1])
            start = end
            if start >= len(text):
                self._add(np.zeros(1, np.int64))
            yield

    def _add(self, places: np.ndarray) -> None:
        self.pending.append(places)
        self.n_pending += len(places)
        if self.n_pending >= PENDING:
            self.count()

    def count(self) -> None:
        """Count the phrases that end in the places read since the last time."""
        old = len(self.last)
        w = np.concatenate([self.last, *self.pending])
        self.pending, self.n_pending, self.last = [], 0, w[-(LONGEST - 1) :]
        real = w > 0
        self.words += int(real[old:].sum())
        keys = [w[old:][real[old:]] << _SHIFTS[0]]
        for more in range(1, LONGEST):
            # A phrase of ``more + 1`` words ends in place k if none of its places is a mark.
            ends = np.arange(max(old, more), len(w))
            whole = real[ends]
            key = w[ends - more] << _SHIFTS[0]
            for k in range(1, more + 1):
                whole = whole & real[ends - k]
                key = key | w[ends - more + k] << _SHIFTS[k]
            keys.append(key[whole])
        keys = np.sort(np.concatenate(keys))
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.size += self.root.add(keys[starts], np.diff(np.append(starts, len(keys))))

    def subtrees(self) -> list[tuple[int, int]]:
        """(phrases, first word) of every subtree, and of what has no subtree under word 0."""
        return [(n.size(), word) for word, n in self.root.own.items()] + [(self.root.rest.n, 0)]

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees: their phrases and counts."""
        found = []
        for word in words:
            if word:
                found += self.root.own.pop(word).items()
            else:
                found.append(self.root.rest.items())
                self.root.rest, self.root.limit = Container(), BURST
        keys = np.concatenate([k for k, _ in found])
        self.size -= len(keys)
        return keys, np.concatenate([c for _, c in found])

    def run(self, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(partition, phrases in the order of their words, counts) of some phrases."""
        names = list(self.ids)
        order = pc.sort_indices(pa.array(names, pa.binary())).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        rank[0] = 0
        hashes = np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)
        places = [keys >> s & _MASK for s in _SHIFTS]
        mixed = np.zeros(len(keys), np.uint64)
        for p in places:
            mixed = (mixed ^ hashes[p]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        part = (mixed % np.uint64(parts)).astype(np.int64)
        order = np.argsort(rank[places[0]] << _SHIFTS[0] | rank[places[1]] << _SHIFTS[1] | rank[places[2]])
        order = order[np.argsort(part[order], kind="stable")]
        part, counts = part[order], counts[order]
        words = pa.array(names, pa.binary())
        spelled = [words.take(pa.array(p[order], mask=p[order] == 0)) for p in places]
        phrases = pc.binary_join_element_wise(*spelled, b" ", null_handling="skip")
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            yield int(part[start]), phrases[start:end], counts[start:end]

    def forget(self) -> None:
        """New ids, when all phrases have been taken; the last places keep their words."""
        names = list(self.ids)
        last = [names[k] for k in self.last.tolist()]
        self.ids = WordIds()
        self.last = np.array([self.ids[w] for w in last], np.int64)


def _pack(rows: list[tuple[str, int, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """Pieces of runs as rows; a phrase has no line feed."""
    out = []
    for lang, part, phrases, counts in rows:
        whole = pa.ListArray.from_arrays(pa.array([0, len(phrases)], pa.int32()), phrases)
        text = pc.binary_join(whole, b"\n")[0].as_py()
        small = [pa.compress(b, "zstd", asbytes=True) for b in (text, counts.astype("<i8").tobytes())]
        out.append((lang, part, len(phrases), len(text), *small))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["lang", "part", "entries", "raw", "phrases", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def _unpack(entries: int, raw: int, phrases: bytes, counts: bytes) -> pa.Table:
    text = pa.array([pa.decompress(phrases, raw, "zstd", asbytes=True)], pa.binary())
    numbers = np.frombuffer(pa.decompress(counts, 8 * entries, "zstd", asbytes=True), "<i8")
    return pa.table({"phrase": pc.split_pattern(text, b"\n").flatten(), "n": numbers})


def _spill(tries: dict[str, HatTrie], down_to: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of the largest subtrees, until ``down_to`` phrases are left."""
    subtrees = sorted(((n, lang, word) for lang, t in tries.items() for n, word in t.subtrees()), reverse=True)
    left, chosen = sum(t.size for t in tries.values()), {}
    for n, lang, word in subtrees:
        if left <= down_to:
            break
        chosen.setdefault(lang, []).append(word)
        left -= n
    for lang, words in chosen.items():
        rows = []
        for piece in tries[lang].run(*tries[lang].take(words), parts):
            rows.append((lang, *piece))
            if len(rows) == 64:
                yield _pack(rows)
                rows = []
        if rows:
            yield _pack(rows)


def _spill_all(tries: dict[str, HatTrie], parts: int) -> Iterator[pa.RecordBatch]:
    """All phrases, and the numbers of words read under the empty phrase."""
    for trie in tries.values():
        trie.count()
    yield from _spill(tries, 0, parts)
    for lang, trie in tries.items():
        if trie.words:
            yield _pack([(lang, 0, pa.array([b""], pa.binary()), np.array([trie.words]))])
            trie.words = 0


def _runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    tries: dict[str, HatTrie] = {}
    held = 0
    for batch in small_batches(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            trie = tries.get(lang)
            if trie is None:
                trie = tries[lang] = HatTrie()
            held -= trie.held()
            for _ in trie.read(text.as_py() or b""):
                full = len(trie.ids) + _BLOCK // 2 > _MASK
                if full or held + trie.held() > ENTRIES:
                    if full or sum(t.size for t in tries.values()) < ENTRIES // 2:
                        yield from _spill_all(tries, parts)
                        trie.forget()
                        tries = {lang: trie}
                    else:
                        yield from _spill(tries, ENTRIES // 4, parts)
                    held = sum(t.held() for t in tries.values()) - trie.held()
            held += trie.held()
    yield from _spill_all(tries, parts)


def _added(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).combine_chunks().group_by("phrase").aggregate([("n", "sum")])
    return summed.rename_columns({"n_sum": "n"}).select(["phrase", "n"])


def _merge(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Equal phrases of a partition added up; those that are frequent, and the numbers of words."""

    def done(lang: str, tables: list[pa.Table]) -> pa.RecordBatch:
        table = _added(tables)
        table = table.filter(pc.or_(pc.greater_equal(table["n"], min_count), pc.equal(table["phrase"], b"")))
        phrases = table["phrase"].combine_chunks().cast(pa.string())
        langs = pa.array([lang] * table.num_rows, pa.string())
        return pa.RecordBatch.from_arrays([langs, phrases, table["n"].combine_chunks()], ["lang", "phrase", "n"])

    key, tables, fresh = None, [], 0
    for batch in small_batches(batches, 16):
        for lang, part, entries, raw, phrases, counts in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (lang, part):
                if key is not None:
                    yield done(key[0], tables)
                key, tables, fresh = (lang, part), [], 0
            tables.append(_unpack(entries, raw, phrases, counts))
            fresh += entries
            if fresh > ENTRIES // 2:
                tables, fresh = [_added(tables)], 0
    if key is not None:
        yield done(key[0], tables)


def count_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, phrase, n): phrases of one to three words that occur ``min_count`` times in a language.

    The empty phrase of a language carries the number of all its words. See :func:`collocations`.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    runs = rows.mapInArrow(lambda b: _runs(b, parts), _RUNS)
    dealt = runs.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(lambda b: _merge(b, min_count), _COUNTS)


def _n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def _stretch(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _cuts(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, left, right) for every place where a candidate can be cut."""
    k = F.col("k")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    left, right = _stretch(F.col("words"), F.lit(1), k), _stretch(F.col("words"), k + 1, F.size("words") - k)
    return cut.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"))


def _inner(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longest_a): phrases inside longer candidates, and how often the most frequent such occurs."""
    size = F.size("words")
    longer = candidates.where(size > 2)
    longer = longer.withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    longer = longer.withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inner = longer.select("lang", _stretch(F.col("words"), F.col("s"), F.col("m")).alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among counted phrases that no longer one covers."""
    grams = counts.where("phrase <> ''")
    words = F.split("phrase", " ", -1)
    candidates = grams.where(_n_words(F.col("phrase")) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    lefts = grams.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = grams.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    parts = _cuts(candidates).join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    # Both products may pass 64 bits; the quotient is at most UNIT, as a part is never rarer than the whole.
    share = (exact["a"] * exact["a"]).cast("decimal(31,0)") * F.lit(UNIT).cast("decimal(7,0)")
    parts = parts.withColumns({"share": share, "product": exact["l"] * exact["r"]})
    parts = parts.withColumn("score", F.expr("share div product"))
    best = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    covered = best.join(_inner(candidates), ["lang", "phrase"], "left")
    kept = covered.where(F.coalesce(F.col("longest_a") * 100 < F.col("a") * COVERED_PERCENT, F.lit(True)))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``.

    Rows are sorted by ranges, so no task holds a language; a row's rank is its place in its range and
    the number of rows in earlier ones.
    """
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    scored = materialise(scored, "phrase-scores")
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("place", F.monotonically_increasing_id()), "phrase-order")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("lang", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("lang", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    parts = parts.where(F.col("before") < top)
    rank = (F.col("before") + F.col("place") - F.col("first") + 1).alias("rank")
    return placed.join(parts, ["lang", "part"]).select("*", rank).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of every language.

    A-Z are lower-cased, texts are split into pieces at ``PIECE_MARKS`` and pieces into words at ``WORD_MARKS``.
    A phrase of two or three words that occurs ``a >= min_count`` times is cut in two parts that occur ``l`` and
    ``r`` times, where ``a * a / (l * r)``, in whole millionths, is least; of equal cuts the first. Phrases
    inside a longer candidate at least half as frequent are dropped. ``n`` is the number of words of the
    language. Order: score, then ``a``, both descending, then phrase by its bytes.

    A null language is ``und``; a null or empty text has no words; repeated rows count again; an empty
    table, or one without frequent phrases, has no rows. Texts of any length are read in blocks. Other
    columns are not read.
    """
    counts = materialise(count_phrases(docs, min_count, lang_col, text_col), "phrase-counts")
    totals = counts.where("phrase = ''").select("lang", F.col("n"))
    ranked = _ranked(score_phrases(counts), top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
