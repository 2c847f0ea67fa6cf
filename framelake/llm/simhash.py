"""Near-duplicates by 64-bit SimHash fingerprints and BK-trees.

Two fingerprints that differ in at most ``RADIUS`` bits agree on at least one of ``RADIUS + 1``
blocks of bits, so every link lies inside a shard: the distinct fingerprints that share one block. A
BK-tree per shard finds the links; children are keyed by their Hamming distance to the parent, and a
search follows only edges within the radius of its own distance. Shards reach their tasks by shuffle
and not by broadcast, since together they grow with the data.

A shard above ``SHARD`` fingerprints is cut again by blocks of its remaining bits, by the same argument;
what is still above it (a large group of near copies) is dealt out to several trees that all its
fingerprints search. No pair of a shard is emitted as such: a tree reports a spanning forest of its
links, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.session import fits_broadcast, materialise

from .common import fresh, small_batches, texts
from .components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tree, at most.
SHARD = 2000
#: Trees whose members search an earlier tree in one task.
TOGETHER = 8
#: Shingles held at once while a long text is hashed.
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the hashes of the shingles, repeats included.

    A-Z are lower-cased and words are parted by ASCII white space. Fewer words than a shingle are
    one shingle; a null or empty text is 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(size, len(found))
    total = len(found) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _CHUNK):
        part = found[start : start + _CHUNK + size - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(size)]))
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius`` bits."""
        found, values, children = [], self.values, self.children
        stack = [0] if values else []
        while stack:
            place = stack.pop()
            distance = (value ^ values[place]).bit_count()
            if distance <= radius:
                found.append(place)
            below = children[place]
            if below:
                low, high = distance - radius, distance + radius
                stack += [child for edge, child in below.items() if low <= edge <= high]
        return found

    def add(self, value: int) -> None:
        """Insert a value that is not in the tree."""
        new = len(self.values)
        if new:
            place = 0
            while True:
                below = self.children[place]
                nearer = below.setdefault((value ^ self.values[place]).bit_count(), new)
                if nearer == new:
                    break
                place = nearer
        self.values.append(value)
        self.children.append({})


class Forest:
    """A tree of members that reports a spanning forest of their links, and searches that join its parts."""

    def __init__(self, radius: int) -> None:
        self.tree, self.parent, self.radius = BKTree(), [], radius

    def root(self, place: int) -> int:
        parent = self.parent
        while parent[place] != place:
            parent[place] = parent[parent[place]]
            place = parent[place]
        return place

    def add(self, value: int) -> list[tuple[int, int]]:
        """Links of a new member to the parts that it joins."""
        links, place = [], len(self.parent)
        self.parent.append(place)
        for other in self.tree.near(value, self.radius):
            above = self.root(other)
            if above != self.root(place):
                links.append((value, self.tree.values[other]))
                self.parent[self.root(place)] = above
        self.tree.add(value)
        return links

    def search(self, value: int) -> list[tuple[int, int]]:
        """A link to each part that lies near a value which is not a member."""
        met = {}
        for other in self.tree.near(value, self.radius):
            if self.tree.values[other] != value:
                met.setdefault(self.root(other), other)
        return [(value, self.tree.values[other]) for other in met.values()]


def _blocks(value: Column, widths: list[int], low: int = 0) -> list[Column]:
    """The bits of each block, counted from bit ``low``."""
    out = []
    for width in widths:
        out.append(F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1)))
        low += width
    return out


def _widths(bits: int, parts: int) -> list[int]:
    return [bits // parts + (k < bits % parts) for k in range(parts)]


def _rest(value: Column, low: int, width: int) -> Column:
    """The 64 bits of ``value`` without one block."""
    below = value.bitwiseAND(F.lit((1 << low) - 1))
    above = F.lit(0).cast("long") if low + width >= 64 else F.shiftleft(F.shiftrightunsigned(value, low + width), low)
    return above.bitwiseOR(below)


def shards(prints: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(key, part, salt, searches, fp): where each distinct fingerprint is a member of a tree or searches one.

    The searches of a tree are dealt out by ``salt``, ``TOGETHER`` later trees at a time, and its members
    come to each of them; so a task holds one tree however large the shard is.
    """
    widths = _widths(64, radius + 1)
    lows = [sum(widths[:k]) for k in range(len(widths))]
    first = [
        F.struct(F.lit(k).alias("block"), bits.alias("bits"), _rest(F.col("fp"), lows[k], widths[k]).alias("rest"))
        for k, bits in enumerate(_blocks(F.col("fp"), widths))
    ]
    placed = prints.select("fp", F.explode(F.array(*first)).alias("s")).select("fp", "s.*")
    counts = placed.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    # A row per value of a block: (radius + 1) * 2^width at most, 262,144 by default.
    large = F.broadcast(counts) if max(widths) <= 16 else counts
    key = F.concat_ws(".", "block", "bits")
    small = placed.join(large, ["block", "bits"], "left_anti").select(key.alias("key"), "fp")
    inner = _widths(64 - max(widths), radius + 1)
    second = [
        F.struct(F.lit(k).alias("block2"), bits.alias("bits2")) for k, bits in enumerate(_blocks(F.col("rest"), inner))
    ]
    hot = placed.join(large, ["block", "bits"], "left_semi").select(key.alias("key"), "fp", F.explode(F.array(*second)).alias("s"))
    hot = hot.select(F.concat_ws(".", "key", "s.block2", "s.bits2").alias("key"), "fp")
    again = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    again = again.select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    hot = hot.join(again, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A tree is searched by its own members as they come in and by the members of later trees.
    dealt = hot.select("key", "fp", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), own)).alias("part"))
    block = lambda part: F.floor(part / TOGETHER).cast("int")
    searches = F.col("part") < F.col("own")
    salts = F.when(searches, F.array(block(F.col("own")))).otherwise(
        F.sequence(block(F.col("own")), block(F.col("parts") - 1))
    )
    dealt = dealt.select("key", "part", F.explode(salts).alias("salt"), searches.alias("searches"), "fp")
    alone = small.select("key", F.lit(0).alias("part"), F.lit(0).alias("salt"), F.lit(False).alias("searches"), "fp")
    return alone.unionByName(dealt)


def links(prints: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(a, b) among the distinct fingerprints ``fp``: links that join all that lie within ``radius`` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, forest, found = None, Forest(radius), []

        def out() -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        # Members come before the searches of their tree, so links go out as they are found.
        for batch in batches:
            shard = zip(*[batch.column(k).to_pylist() for k in range(3)])
            roles = batch.column(3).to_pylist()
            values = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for place, role, value in zip(shard, roles, values):
                if place != current:
                    current, forest = place, Forest(radius)
                if role:
                    found += forest.search(value)
                else:
                    own = forest.add(value)
                    # A tree that comes to several tasks reports its own links in the first.
                    if place[2] == place[1] // TOGETHER:
                        found += own
                if len(found) >= _CHUNK:
                    yield out()
            if found:
                yield out()

    placed = shards(prints, radius, most)
    dealt = placed.repartition("key", "part", "salt").sortWithinPartitions("key", "part", "salt", "searches")
    return dealt.select("key", "part", "salt", "searches", "fp").mapInArrow(search, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, h, fp): one row per document row, the fingerprint as a signed 64-bit number; ``h`` hashes the text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = np.array([fingerprint(t, size) for t in texts(batch.column(2))], np.uint64)
            fp = pa.array(prints.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["id", "h", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(hashed, "id long, h long, fp long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Document rows (id, h, fp), and the distinct fingerprints (fp, least id, root of the component)."""
    rows = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    # Copies become one fingerprint here, before anything is searched.
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    groups = connected_components(links(prints.select("fp"), radius, most))
    rooted = prints.join(groups, prints["fp"] == groups["node"], "left")
    return rows, materialise(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    radius: int = RADIUS,
    most: int = SHARD,
) -> DataFrame:
    """(id, fingerprint, component_id) per document row.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that can be reached. Null and empty texts have fingerprint zero and link like any
    other. Repeated rows are linked by their equal fingerprint. A null id is larger than any other,
    so a group of null ids alone has a null component. Other columns are not read, and an empty table
    gives no rows.
    """
    rows, rooted = _grouped(docs, id_col, text_col, size, radius, most)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(known, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    radius: int = RADIUS,
    most: int = SHARD,
) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`, chosen by :func:`keep_first`, all columns kept."""
    rows, rooted = _grouped(docs, id_col, text_col, size, radius, most)
    keys = rows.groupBy("id", "h", "fp").agg(F.count(F.lit(1)).alias("n")).join(rooted.select("fp", "root"), "fp")
    return keep_first(docs, keys, id_col, text_col)


def keep_first(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group; ``keys``: (id, h, n, root), the rows of an id and text hash and their group.

    The row with the smallest id stays, null ids last; of several texts under that id the one with the
    smallest hash, and of rows that repeat both any one.
    """
    columns = docs.columns
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "h")
    best = keys.groupBy("root").agg(F.min(rank).alias("best"))
    # (id, h) that do not stay as they are: dropped, or kept once out of several equal rows.
    judged = keys.join(best, "root").withColumn("stays", rank == F.col("best"))
    moved = judged.where(~F.col("stays") | (F.col("n") > 1)).select("id", "h", "stays")
    moved = materialise(moved, "copies")
    id_name, hash_name = fresh(docs, "copy_id"), fresh(docs, "copy_hash")
    moved = moved.withColumnsRenamed({"id": id_name, "h": hash_name})
    wide = F.broadcast(moved) if fits_broadcast(moved) else moved
    row_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(F.col(id_name)) & (row_hash == F.col(hash_name))
    single = docs.join(wide, same, "left_anti")
    repeated = docs.join(wide.where("stays"), same, "inner").select(
        F.col(id_name), F.col(hash_name), F.struct(*[docs[c] for c in columns]).alias("row")
    )
    once = repeated.groupBy(id_name, hash_name).agg(F.first("row").alias("row")).select("row.*")
    return single.select(*columns).unionByName(once.select(*columns))
