"""Conversation structure repair: the cheapest edits that make a conversation legal, as an audit string.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant. Every row is
kept (``K``), given the role that is due (``R``) or deleted (``D``), and empty turns may be inserted (``I``);
the letters of the edits in order are the audit. Of the cheapest audits the first in ASCII order is taken.

The search runs forward over the rows. Each state of the automaton (nothing yet, or the role last put)
holds its cost and the last node of its audit. Audits share their beginnings as linked nodes; a node
knows its ancestors at distances 1, 2, 4, ... and the rolling hash of its audit, so two audits of equal
cost are compared by a search for their longest common beginning. Equal hashes are verified letter by
letter. The letters of an audit so far tell its state, so audits that end in different states differ.

Rows are put in order once and written; the search reads only a role code and a fault per row. It works
on chunks of ``CHUNK`` rows, so that a conversation of any length is shared out: a chunk tells for each
pair of states before and after the cost and the rank of its best audit. Passes over one small row per
chunk, back and forth, choose the states between chunks, and the chunks are then searched again for
their letters. Only the digest of a repaired conversation runs through one task, in constant memory:
SHA-256 cannot be split.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelake.session import materialise

#: What edits cost, and what a truncated row costs that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Rows of a chunk at most; a power of two.
CHUNK = 512

# States and role codes: 0 nothing yet (as a role: unknown), 1 system, 2 user, 3 assistant.
_STATES = 4
_ROLES = {2: "user", 3: "assistant"}
#: Roles that may follow a state.
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Roles to put in to get from a state to another one, the shortest way; only user and assistant.
_PUT = {
    0: {0: (), 2: (2,), 3: (2, 3)},
    1: {1: (), 2: (2,), 3: (2, 3)},
    2: {2: (), 3: (3,)},
    3: {3: (), 2: (2,)},
}
#: Roles to put in at the end.
_CLOSE = {0: (), 1: (2, 3), 2: (3,), 3: ()}
_FAR = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class AuditTree:
    """Audits as paths from a root; node 0 is the empty audit."""

    def __init__(self) -> None:
        self.letter = [""]
        self.depth = [0]
        self.hash = [0]
        self.up: list[list[int]] = [[]]
        self._equal: set[tuple[int, int]] = set()

    def add(self, node: int, letters: str) -> int:
        """The audit of ``node`` with more letters."""
        for letter in letters:
            new = len(self.letter)
            ups, far = [node], node
            while len(self.up[far]) >= len(ups):
                far = self.up[far][len(ups) - 1]
                ups.append(far)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
            self.up.append(ups)
            node = new
        return node

    def lift(self, node: int, steps: int) -> int:
        while steps:
            jump = steps.bit_length() - 1
            node = self.up[node][jump]
            steps -= 1 << jump
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two audits of one length are equal; equal hashes are verified."""
        if x == y:
            return True
        if self.hash[x] != self.hash[y]:
            return False
        seen = []
        while x != y and (x, y) not in self._equal:
            if self.letter[x] != self.letter[y]:
                return False
            seen.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        self._equal.update(seen)
        return True

    def compare(self, a: int, b: int) -> int:
        """Below, at or above 0 as audit ``a`` comes before, with or after ``b`` in ASCII order."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - short), self.lift(b, self.depth[b] - short)
        if self.same(x, y):
            return self.depth[a] - self.depth[b]
        # Down to the first letter that differs: skip while the ancestors still differ.
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return -1 if self.letter[x] < self.letter[y] else 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _edits(role: int, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state, what a row can become: (state after, cost, letters), insertions before it included."""
    out: list[list[tuple[int, int, str]]] = []
    for state in range(_STATES):
        found = []
        for between, put in _PUT[state].items():
            before, letters = COST["I"] * len(put), "I" * len(put)
            found.append((between, before + COST["D"], letters + "D"))
            if fault in (FINE, CUT_OFF):
                stays = before + TRUNCATED * (fault == CUT_OFF)
                for after in _NEXT[between]:
                    if after == role:
                        found.append((after, stays + COST["K"], letters + "K"))
                    if after in _ROLES:
                        found.append((after, stays + COST["R"], letters + "R"))
        out.append(found)
    return out


_WAYS = {(role, fault): _edits(role, fault) for role in range(_STATES) for fault in range(4)}


def search(codes: list[tuple[int, int]], start: int, tree: AuditTree) -> dict[int, tuple[int, int]]:
    """The cheapest audits of a run of rows (role code, fault) from a state: {state after: (cost, node)}."""
    held = {start: (0, 0)}
    for code in codes:
        best: dict[int, tuple[int, int, str]] = {}
        ways = _WAYS[code]
        for state, (cost, node) in held.items():
            for after, price, letters in ways[state]:
                total = cost + price
                found = best.get(after)
                if found is None or total < found[0]:
                    best[after] = (total, node, letters)
                elif total == found[0]:
                    old, new = tree.add(found[1], found[2]), tree.add(node, letters)
                    best[after] = (total, old, "") if tree.compare(old, new) <= 0 else (total, new, "")
        held = {after: (cost, tree.add(node, letters)) for after, (cost, node, letters) in best.items()}
    return held


def transfer(codes: list[tuple[int, int]], starts: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Costs and ranks of the best audits between states, 4 x 4 row by row; ranks compare within a row."""
    costs, ranks = [_FAR] * _STATES**2, [0] * _STATES**2
    for start in starts:
        tree = AuditTree()
        found = search(codes, start, tree)
        order = sorted(found, key=functools.cmp_to_key(lambda p, q: tree.compare(found[p][1], found[q][1])))
        for rank, end in enumerate(order):
            costs[start * _STATES + end], ranks[start * _STATES + end] = found[end][0], rank
    return costs, ranks


def choose(costs: list[int], ranks: list[int], start: int, goal: list[int]) -> int:
    """The state after a chunk on the best way on, given the costs from there to the end."""
    at = start * _STATES
    return min(range(_STATES), key=lambda end: (min(costs[at + end] + goal[end], _FAR), ranks[at + end]))


def closing_costs() -> list[int]:
    return [COST["I"] * len(_CLOSE[s]) for s in range(_STATES)]


# ---- Rows in order ---------------------------------------------------------------------------------


def _ordered(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(pos, conv_id, turn, role, text, code, blank, cut_off, digest), written; ``pos`` rises in order."""
    blank_text = F.lit(" ")
    rows = chats.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank_text).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), blank_text).alias("text"),
        # Only tells repeated rows apart, so that any number of them can be dealt out.
        F.monotonically_increasing_id().alias("nth"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    end = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    return materialise(
        rows.select(
            F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text",
            code.alias("code"),
            (end == "").alias("blank"),
            (~end.isin(".", "!", "?")).alias("cut_off"),
            F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        ),
        "audit-rows",
    )


def _faults(ordered: DataFrame) -> DataFrame:
    """(pos, conv_id, code, fault): the first fault of each row."""
    seen = ordered.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows, seen = ordered.select("pos", "conv_id", "code", "blank", "cut_off", "digest").alias("r"), seen.alias("s")
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.digest") == F.col("s.digest"))
    later = F.coalesce(F.col("r.pos") > F.col("s.first"), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut_off"), CUT_OFF).otherwise(FINE)
    return rows.join(seen, same, "left").select("r.pos", "r.conv_id", "r.code", fault.alias("fault"))


def _chunks(ordered: DataFrame, chunk: int) -> DataFrame:
    """(g, conv_id, codes, faults): at most ``chunk`` rows of a conversation; ``g`` is the first row's place."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "code", "fault")))
    bucket = F.floor(F.col("pos") / F.lit(chunk)).alias("bucket")
    cells = _faults(ordered).groupBy("conv_id", bucket).agg(packed.alias("rows"))
    codes, faults = F.col("rows.code").alias("codes"), F.col("rows.fault").alias("faults")
    return materialise(cells.select(F.col("rows")[0]["pos"].alias("g"), "conv_id", codes, faults), "audit-chunks")


# ---- States between chunks --------------------------------------------------------------------------

_HEADS = "g long, costs array<long>, ranks array<int>, first int, last int, illegal long"


def _batch(kind: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], schema=kind)


def _legal(before: int, after: int) -> bool:
    """su, ua or au; other initials never are."""
    return (before, after) in ((1, 2), (2, 3), (3, 2))


def _measure(chunk: int):
    kind = pa.schema(
        [("g", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("first", pa.int32()),
         ("last", pa.int32()), ("illegal", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, codes, faults in zip(*[c.to_pylist() for c in batch.columns]):
                # Rows of a conversation are neighbours, so one that starts inside a bucket starts with this chunk.
                starts = (0,) if g % chunk else tuple(range(_STATES))
                costs, ranks = transfer(list(zip(codes, faults)), starts)
                illegal = sum(not _legal(p, q) for p, q in zip(codes, codes[1:]))
                out.append((g, costs, ranks, codes[0], codes[-1], illegal))
            yield _batch(kind, out)

    return run


def _back(batches: Iterator[pa.RecordBatch], kind: pa.Schema, key: str) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from its end, each with the costs from its end to the conversation's."""
    conv, goal = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if conv is None or conv[0] != row[key]:
                conv, goal = (row[key],), closing_costs()
                row["last_chunk"] = True
            else:
                row["last_chunk"] = False
            row["goal"] = goal
            costs = row["costs"]
            goal = [min(min(costs[p * _STATES + q] + goal[q] for q in range(_STATES)), _FAR) for p in range(_STATES)]
            out.append(tuple(row[f.name] for f in kind))
        yield _batch(kind, out)


def _forth(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation in order: the states around each, and illegal pairs up to its end."""
    kind = pa.schema(
        [("g", pa.int64()), ("start", pa.int32()), ("finish", pa.int32()), ("illegal", pa.int64()), ("last_chunk", pa.bool_())]
    )
    conv, state, before = None, 0, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if conv is None or conv[0] != row[key]:
                conv, state, before = (row[key],), 0, None
            end = choose(row["costs"], row["ranks"], state, row["goal"])
            illegal = row["illegal"] + (before is not None and not _legal(before, row["first"]))
            out.append((row["g"], state, end, illegal, row["last_chunk"]))
            state, before = end, row["last"]
        yield _batch(kind, out)


def _states(chunks: DataFrame, chunk: int) -> DataFrame:
    """(g, start, finish, illegal, last_chunk) of every chunk, written."""
    heads = chunks.select("g", "codes", "faults").mapInArrow(_measure(chunk), _HEADS)
    heads = materialise(heads.join(chunks.select("g", "conv_id"), "g"), "audit-heads")
    back = heads.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("g"))
    schema = f"conv_id {heads.schema['conv_id'].dataType.simpleString()}, {_HEADS}, goal array<long>, last_chunk boolean"
    kind = pa.schema(
        [("conv_id", _arrow(heads)), ("g", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
         ("first", pa.int32()), ("last", pa.int32()), ("illegal", pa.int64()), ("goal", pa.list_(pa.int64())),
         ("last_chunk", pa.bool_())]
    )
    aimed = materialise(back.mapInArrow(lambda b: _back(b, kind, "conv_id"), schema), "audit-goals")
    forth = aimed.repartition("conv_id").sortWithinPartitions("conv_id", "g")
    out = "g long, start int, finish int, illegal long, last_chunk boolean"
    return materialise(forth.mapInArrow(lambda b: _forth(b, "conv_id"), out), "audit-states")


def _arrow(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv_id"].dataType)


# ---- Letters ----------------------------------------------------------------------------------------

_PIECES = (
    "g long, audit string, cost long, blank long, duplicate long, truncated long, "
    "edits array<struct<letter: string, role: string, before: array<string>, after: array<string>>>"
)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each chunk between its chosen states, and the edit of each of its rows."""
    text = pa.list_(pa.string())
    edit = pa.struct([("letter", pa.string()), ("role", pa.string()), ("before", text), ("after", text)])
    kind = pa.schema(
        [("g", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
         ("truncated", pa.int64()), ("edits", pa.list_(edit))]
    )
    for batch in batches:
        out = []
        for g, codes, faults, start, finish, last in zip(*[c.to_pylist() for c in batch.columns]):
            tree = AuditTree()
            cost, node = search(list(zip(codes, faults)), start, tree)[finish]
            audit = tree.text(node)
            edits = [
                {"letter": letter, "role": _ROLES[state] if letter == "R" else None, "before": [_ROLES[r] for r in put], "after": []}
                for letter, state, put in _decoded(audit, start, codes)
            ]
            if last:
                edits[-1]["after"] = [_ROLES[r] for r in _CLOSE[finish]]
                cost += COST["I"] * len(_CLOSE[finish])
                audit += "I" * len(_CLOSE[finish])
            out.append((g, audit, cost, *[faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)], edits))
        yield _batch(kind, out)


def _decoded(audit: str, start: int, codes: list[int]) -> Iterator[tuple[str, int, list[int]]]:
    """(letter, state after, roles put in before) for each row of a chunk."""
    state, put, k = start, [], 0
    for letter in audit:
        if letter in "IR":
            state = 3 if state == 2 else 2
        elif letter == "K":
            state = codes[k]
        if letter == "I":
            put.append(state)
            continue
        yield letter, state, put
        put, k = [], k + 1


_OPERATIONS = {"K": "keep", "R": "rerole", "D": "delete"}


def _turns(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, pos, step, turn, operation, role, text): rows with their edits, inserted turns in between."""
    edits = pieces.select("g", F.posexplode("edits").alias("k", "edit"))
    edits = edits.select((F.col("g") + F.col("k")).alias("pos"), "edit.*")
    rows = ordered.select("pos", "conv_id", "turn", "role", "text").join(edits.withColumnRenamed("role", "new_role"), "pos")

    def turn(step: Column, turn_no: Column, operation: Column, role: Column, text: Column) -> Column:
        return F.struct(
            step.cast("int").alias("step"), turn_no.cast("long").alias("turn"), operation.alias("operation"),
            role.alias("role"), text.alias("text"),
        )

    def put(roles: Column, first: Column) -> Column:
        return F.transform(roles, lambda r, k: turn(first + k, F.lit(None), F.lit("insert"), r, F.lit("")))

    names = F.create_map(*[F.lit(v) for pair in _OPERATIONS.items() for v in pair])
    own = turn(F.size("before"), F.col("turn"), names[F.col("letter")], F.coalesce("new_role", "role"), F.col("text"))
    all_turns = F.concat(put(F.col("before"), F.lit(0)), F.array(own), put(F.col("after"), F.size("before") + 1))
    return rows.select("conv_id", "pos", F.inline(all_turns))


def _digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation that keeps a turn; turns pass one by one."""
    kind = pa.schema([("conv_id", _arrow(turns)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for key, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if conv is None or conv[0] != key:
                    if conv is not None:
                        out.append((conv[0], state.hexdigest()))
                    conv, state = (key,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batch(kind, out)
        if conv is not None:
            yield _batch(kind, [(conv[0], state.hexdigest())])

    left = turns.where("operation <> 'delete'").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    return left.select("conv_id", "role", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Repaired:
    """``turns``: every row and insertion with its operation. ``summary``: one row per conversation."""

    turns: DataFrame
    summary: DataFrame


def repair_structure(
    chats: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> Repaired:
    """Repair every conversation at least cost, by the first audit in ASCII order.

    ``turns`` has (conv_id, pos, step, turn, operation, role, text), ordered by (pos, step); what is not
    deleted is the repaired conversation. ``summary`` has (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256): missing turn numbers between the least and the greatest, rows by their
    first fault, neighbours whose role initials are not su, ua or au, and the SHA-256 of the repaired
    ``role:text`` lines.

    Rows are ordered by turn, nulls first, then role and text. A null role or text is one space. A role counts
    by its first letter as written; others than s, u, a cannot be kept. Blank rows and those whose role
    and text were seen before are deleted; repeated rows are such. Rows with a null conversation are one
    conversation. Texts of any length pass one by one. An empty table gives empty ones; other columns are
    not read.
    """
    ordered = _ordered(chats, conv_col, turn_col, role_col, text_col)
    chunks = _chunks(ordered, chunk)
    states = _states(chunks, chunk)
    solved = chunks.join(states, "g").select("g", "codes", "faults", "start", "finish", "last_chunk")
    pieces = solved.mapInArrow(_spell, _PIECES)
    pieces = materialise(pieces.join(states.select("g", "illegal"), "g").join(chunks.select("g", "conv_id"), "g"), "audit-pieces")
    turns = _turns(ordered, pieces)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "audit"))), lambda p: p["audit"]), "")
    found = pieces.groupBy("conv_id").agg(*sums, spelled.alias("audit"))
    gaps = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    empty = F.sha2(F.lit("").cast("binary"), 256)
    summary = _null_safe(_null_safe(found, gaps, "gaps"), _digests(turns), "repaired_sha256")
    digest = F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return Repaired(turns, summary.select(*columns, digest))


def _null_safe(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``column`` of the row of the same conversation, which may be null."""
    other = right.select(F.col("conv_id").alias("other_id"), column)
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")


# ---- Damage for the query ----------------------------------------------------------------------------


def damage(chats: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given the role user, by a checksum of their key."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    rows = chats.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.where("kind <> 0").withColumn("copy", times)
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.otherwise(F.col("text")).alias("text"),
    )


def audit_damaged(chats: DataFrame) -> DataFrame:
    """The summary of all conversations after :func:`damage`; those without rows left have zeros."""
    found = repair_structure(damage(chats)).summary
    all_ids = chats.select(F.col("conv_id").alias("id")).distinct()
    rows = all_ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    digest = F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)
