"""Sharding with balanced label propagation: linked documents meet in one shard, and shards stay even.

Documents of one group are linked. Every round counts, for each group that lies in several shards, its
members per shard (its neighbours' labels), picks the shard where the group can best meet, joins that back to the
members and moves them there under the quota of the shard. Documents without links take no part;
they fill the shards up at the end, so all shards hold equally many documents, to within one.

The first labels are slices of the linked documents in the order of their groups, so few groups start
apart: those at a border between slices, and groups too large for a slice. A group is never one
task's work: members are counted before they are shuffled, the join back is one that adaptive execution
splits, and members of large groups are admitted by a hash of their own.

Everything is a DataFrame expression. The driver sees the number of documents, sizes of shards and a
histogram of at most ``n_shards * BUCKETS`` movers per round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.session import materialise

MAX_ROUNDS = 16
#: Movers into a shard are admitted by hash buckets, as many as fit under its quota.
BUCKETS = 1024
#: A group above this part of a shard is admitted member by member, a smaller one whole.
_LARGE_PART = 64
_UNIT = 1 << 20


def quotas(n: int, n_shards: int) -> list[int]:
    """Documents per shard, at most one apart."""
    return [n // n_shards + (j < n % n_shards) for j in range(n_shards)]


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _fraction(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(_UNIT)) / F.lit(_UNIT)


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """Rows with a bucket of about the square root of ``n`` rows, so that neither rows nor buckets pile up."""
    many = max(1, math.ceil(n / max(4096, math.isqrt(n))))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(many)))


def numbered(rows: DataFrame, n: int, within: tuple[str, ...] = (), name: str = "number") -> DataFrame:
    """Count rows from 0 without gaps, per ``within``, in the order of a hash of their ``row``.

    Rows are counted inside hash buckets; the small table of buckets says how many come before each.
    """
    rows = _bucketed(rows, n)
    keys = [*within, "bucket"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_bucket"))
    before = W.partitionBy(*within).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy(*keys).orderBy("row")).alias("own")
    inside = rows.select("*", own)
    joined = inside.join(offsets, keys)
    return joined.withColumn(name, F.col("offset") + F.col("own") - 1).drop("bucket", "offset", "own")


def _first_labels(rows: DataFrame, groups: DataFrame, n_linked: int, n_groups: int, n_shards: int) -> DataFrame:
    """(row, group, m, shard): slices of the linked documents in the order of their groups."""
    many = max(1, math.ceil(n_groups / max(4096, math.isqrt(n_groups))))
    cells = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(many)))
    sums = cells.groupBy("bucket").agg(F.sum("m").alias("in_bucket"))
    before = W.partitionBy().orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    earlier = W.partitionBy("bucket").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    inside = cells.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    starts = inside.join(offsets, "bucket").select("group", "m", (F.col("offset") + F.col("earlier")).alias("start"))
    place = F.col("start") + F.floor(_fraction(F.col("row"), F.lit(3)) * F.col("m"))
    shard = F.least(F.floor(place * n_shards / F.lit(n_linked)), F.lit(n_shards - 1)).cast("int")
    return rows.select("row", "group").join(starts, "group").select("row", "group", "m", shard.alias("shard"))


def _targets(state: DataFrame, room: list[int], n_shards: int, turn: int) -> DataFrame:
    """For each group in several shards: where it is to meet, whether all of it fits, its members per shard.

    Shards with room for all members elsewhere come first, then those with most members, open ones
    before full ones; a hash that all members share decides ties.
    """
    counts = state.groupBy("group", "m").agg(*[F.count_if(F.col("shard") == j).alias(f"c{j}") for j in range(n_shards)])
    here = F.array(*[F.col(f"c{j}") for j in range(n_shards)])
    counts = counts.select("group", "m", here.alias("here")).where(F.array_max("here") < F.col("m"))
    rooms = _literal(room)

    def option(j: int) -> Column:
        here_j, room_j = F.col("here")[j], F.get(rooms, F.lit(j))
        fits = room_j >= F.col("m") - here_j
        order = F.pmod(F.xxhash64("group", F.lit(j), F.lit(turn)), F.lit(_UNIT))
        return F.struct(
            fits.alias("fits"), (room_j > 0).alias("open"), here_j.alias("members"), order.alias("order"), F.lit(j).alias("shard")
        )

    best = F.array_max(F.array(*[option(j) for j in range(n_shards)]))
    found = counts.withColumn("best", best).where("best.fits or best.open")
    return found.select("group", "here", F.col("best.shard").alias("target"), F.col("best.fits").alias("fits"))


def _round(state: DataFrame, quota: list[int], n_shards: int, turn: int) -> tuple[DataFrame, int]:
    """One round: the new state and how many documents moved."""
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = [max(0, quota[j] - held.get(j, 0)) for j in range(n_shards)]
    targets = _targets(state, room, n_shards, turn)
    votes = state.join(targets, "group", "left")
    gains = F.col("fits") | (F.get("here", F.col("target")) > F.get("here", F.col("shard")))
    moves = F.coalesce((F.col("shard") != F.col("target")) & gains, F.lit(False))
    large = F.col("m") > max(1, sum(quota) // (n_shards * _LARGE_PART))
    key = F.when(large, F.xxhash64("row", F.lit(turn))).otherwise(F.xxhash64("group", F.lit(turn)))
    votes = votes.select("row", "group", "m", "shard", F.when(moves, F.col("target")).alias("to"), F.pmod(key, F.lit(BUCKETS)).alias("b"))
    votes = materialise(votes, "shard-votes")
    wanted = votes.where("to is not null").groupBy("to", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    cut, moved = [0] * n_shards, 0
    for j in range(n_shards):
        taken, flow = 0, {r["b"]: r["n"] for r in wanted if r["to"] == j}
        while cut[j] < BUCKETS and taken + flow.get(cut[j], 0) <= room[j]:
            taken += flow.get(cut[j], 0)
            cut[j] += 1
        moved += taken
    admitted = F.col("b") < F.get(_literal(cut), F.col("to"))
    shard = F.when(F.coalesce(admitted, F.lit(False)), F.col("to")).otherwise(F.col("shard")).alias("shard")
    return votes.select("row", "group", "m", shard), moved


def propagate(rows: DataFrame, n: int, n_shards: int) -> DataFrame | None:
    """(row, group, m, shard) of the linked ones among ``rows`` (row, group); None if nothing is linked.

    A shard gets no more linked documents than its quota of all ``n``, but for what the first labels gave it.
    The rounds end when nothing moves twice running, or after ``MAX_ROUNDS``.
    """
    groups = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = materialise(groups, "shard-groups")
    size = groups.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if not size["groups"]:
        return None
    state = materialise(_first_labels(rows, groups, size["n"], size["groups"], n_shards), "shard-labels")
    still = 0
    for turn in range(MAX_ROUNDS):
        state, moved = _round(state, quotas(n, n_shards), n_shards, turn)
        still = 0 if moved else still + 1
        if still == 2:
            break
    return state


def cut_pairs(state: DataFrame) -> DataFrame:
    """One row: linked pairs of documents, and those of them that lie in two shards."""
    cells = state.groupBy("group", "shard").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("c"))
    whole = cells.groupBy("group").agg(F.sum("c").cast("decimal(19,0)").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("kept"))
    pairs = F.col("m") * (F.col("m") - 1)
    return whole.agg(F.sum(pairs / 2).alias("pairs"), F.sum((pairs - F.col("kept")) / 2).alias("cut"))


def shard_rows(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (row, group, ...) with ``shard`` and ``slot``; row ids have to be unique.

    Linked documents keep their label up to the quota of the shard; all others are counted and fill
    the shards in order.
    """
    n = rows.count()
    quota = quotas(n, n_shards)
    state = propagate(rows.select("row", "group"), n, n_shards)
    if state is None:
        kept = rows.sparkSession.createDataFrame([], "row long, shard int")
    else:
        kept = numbered(state.select("row", "shard"), n, ("shard",))
        kept = kept.where(F.col("number") < F.get(_literal(quota), F.col("shard"))).select("row", "shard")
    kept = materialise(kept, "shard-kept")
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, end = [], 0
    for j in range(n_shards):
        end += quota[j] - held.get(j, 0)
        ends.append(end)
    free = numbered(rows.select("row").join(kept, "row", "left_anti"), n)
    filled = F.size(F.filter(_literal(ends), lambda e: e <= F.col("number"))).cast("int")
    placed = materialise(kept.unionByName(free.select("row", filled.alias("shard"))), "shard-placed")
    return rows.join(numbered(placed, n, ("shard",), "slot"), "row")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every document in one of ``n_shards`` shards.

    Documents with equal texts are linked and lie together as far as the law ``rows`` lets them: shards
    hold equally many documents, at most one apart. ``slot`` counts the documents of a shard from 0 without
    gaps, in hashed order. ``size`` is the UTF-8 length plus 1. ``grown_shard`` is null under this law.

    A null text has no bytes and is linked to empty ones. Repeated rows and repeated or null ids are
    documents of their own; fewer documents than shards leave shards empty; an empty table has no rows.
    Texts of any length are read once, for their checksum and digest. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
    )
    placed = shard_rows(materialise(rows, "shard-rows"), n_shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
