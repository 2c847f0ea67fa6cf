"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last.
Dynamic programming over that automaton picks for every turn whether it stays, takes another role, is
merged into the turn before it, or has empty turns put before it. All operations have whole-number costs, so
the costs of a run of turns are a small matrix (state before, state after), and matrices of neighbouring
runs combine by (min, +) products.

Turns are dealt out by ranges of (conversation, turn), which splits a conversation of any length, and
packed into chunks. A conversation within one chunk is repaired there. For the rest only the matrices of
chunks travel: a pass forward gives the costs at each chunk's start, a pass back its state at the end, and the
chunks are then repaired one by one. Rows of a conversation meet only as one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import materialise

ROLES = ("system", "user", "assistant")
#: Costs of the operations. A turn without a known role takes one at the last cost.
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
#: Turns, and characters, of a chunk at most; a single longer turn is a chunk of its own.
CHUNK = 512
CHUNK_CHARS = 4 << 20
START_MARK, END_MARK = "<|im_start|>", "<|im_end|>"
_FAR = 1 << 60

# States: 0 before the first turn, then the role of the turn before, counted from 1.
_STATES = 4
#: Roles to put in between so that a turn of role q (1 to 3) may follow state p; None if it never may.
_BETWEEN: dict[tuple[int, int], tuple[int, ...] | None] = {
    (0, 1): (), (0, 2): (), (0, 3): (2,),
    (1, 1): None, (1, 2): (), (1, 3): (2,),
    (2, 1): None, (2, 2): (3,), (2, 3): (),
    (3, 1): None, (3, 2): (), (3, 3): (2,),
}
#: Roles to put behind the last turn so that the assistant ends it; a conversation without turns stays empty.
_CLOSING: dict[int, tuple[int, ...]] = {0: (), 1: (2, 3), 2: (3,), 3: ()}

_CHUNK_KIND = (
    "g long, conv_id long, whole boolean, n long, turns array<long>, codes binary, roles array<string>, "
    "texts array<string>, matrix array<long>"
)
_OUT = "conv_id long, position long, step int, turn long, operation string, role string, fragment string"


def code(role: str | None) -> int:
    """1 to 3 for a known role, whatever its case and outer spaces, else 0."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _step(role: int, before: int, after: int) -> tuple[int, str]:
    """(cost, operation) of a turn of ``role`` between two states; an equal cost prefers not to merge."""
    change = 0 if role == after else RELABEL if role else NAME
    between = _BETWEEN.get((before, after))
    put = INSERT * len(between) + change if between is not None else _FAR
    merge = MERGE + change if before == after and before else _FAR
    return (put, "put") if put <= merge else (merge, "merge")


_COST = [[[_step(r, p, q)[0] if q else _FAR for q in range(_STATES)] for p in range(_STATES)] for r in range(_STATES)]
_WAYS = [
    [(p, q, _COST[r][p][q]) for q in range(1, _STATES) for p in range(_STATES) if _COST[r][p][q] < _FAR]
    for r in range(_STATES)
]


def advance(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Costs of the states after a turn, and the state before on the cheapest way, the first of equals."""
    after, back = [_FAR] * _STATES, [0] * _STATES
    for p, q, cost in _WAYS[role]:
        if costs[p] + cost < after[q]:
            after[q], back[q] = costs[p] + cost, p
    return after, back


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state to each other over a run of turns, row by row."""
    rows = [[0 if p == q else _FAR for q in range(_STATES)] for p in range(_STATES)]
    for role in codes:
        rows = [advance(row, role)[0] for row in rows]
    return [min(x, _FAR) for row in rows for x in row]


def times(costs: list[int], run: list[int]) -> list[int]:
    return [min(min(costs[p] + run[p * _STATES + q] for p in range(_STATES)), _FAR) for q in range(_STATES)]


def closing_state(costs: list[int]) -> int:
    """The last state with which closing the conversation is cheapest."""
    return min(range(_STATES), key=lambda s: (costs[s] + INSERT * len(_CLOSING[s]), s))


def ways_back(codes: bytes, costs: list[int]) -> list[int]:
    """For each state after a run, the state before it on the way that the whole search takes."""
    start = list(range(_STATES))
    for role in codes:
        costs, back = advance(costs, role)
        start = [start[back[q]] for q in range(_STATES)]
    return start


def states(codes: bytes, costs: list[int], end: int) -> list[int]:
    """The states before, between and after the turns of a run that ends in ``end``."""
    backs = []
    for role in codes:
        costs, back = advance(costs, role)
        backs.append(back)
    path = [end]
    for back in reversed(backs):
        path.append(back[path[-1]])
    return path[::-1]


def _plain(text: str | None) -> str:
    """A text whose own marks cannot open or close a turn: a space breaks them."""
    return (text or "").replace(START_MARK, "<| im_start|>").replace(END_MARK, "<| im_end|>")


def _open(role: int, first: bool) -> str:
    return f"{'' if first else END_MARK + chr(10)}{START_MARK}{ROLES[role - 1]}\n"


def render(
    path: list[int], codes: bytes, turns: list, roles: list, bodies: list, conv_id, position: int, last: bool
) -> Iterator[tuple]:
    """The rows of a run of turns; their fragments, in order, are its part of the rendered conversation."""
    for k, (before, after) in enumerate(zip(path, path[1:])):
        operation = _step(codes[k], before, after)[1]
        step = 0
        if operation == "merge":
            name, fragment = "merge", "\n\n" + _plain(bodies[k])
        else:
            for role in _BETWEEN[before, after]:
                yield conv_id, position + k, step, None, "insert", ROLES[role - 1], _open(role, before == 0 and step == 0)
                step += 1
            name, fragment = "keep", _open(after, before == 0 and step == 0) + _plain(bodies[k])
        if codes[k] != after:
            name = "relabel" if name == "keep" else "relabel and merge"
        yield conv_id, position + k, step, turns[k], name, ROLES[after - 1], fragment
    if last:
        end, at = path[-1], position + len(codes)
        for step, role in enumerate(_CLOSING[end]):
            yield conv_id, at, step, None, "insert", ROLES[role - 1], _open(role, False)
        yield conv_id, at, len(_CLOSING[end]), None, "end", None, END_MARK + "\n"


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    fields = [part.split() for part in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[f[0] for f in fields]
    )


def _chunks(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, most: int) -> DataFrame:
    """Turns in order, packed; ``whole`` says that a chunk surely holds all of its conversation."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        serial, out = 0, []
        held: list[tuple] = []
        key, chars, pieces, first_of_task = None, 0, 0, True

        def chunk(whole: bool) -> None:
            nonlocal serial, held, chars, pieces
            codes = bytes(code(r[1]) for r in held)
            out.append(
                (
                    (part << 40) + serial, key[0], whole, len(held), [r[0] for r in held], codes,
                    [r[1] for r in held], [r[2] for r in held], matrix(codes),
                )
            )
            serial, held, chars, pieces = serial + 1, [], 0, pieces + 1

        for batch in batches:
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if key is None or conv != key[0]:
                    if key is not None:
                        # A conversation may go on from the task before or into the next one.
                        chunk(whole=not first_of_task and pieces == 0)
                        first_of_task = False
                    key, pieces = (conv,), 0
                elif len(held) >= most or chars + len(text or "") > CHUNK_CHARS:
                    chunk(whole=False)
                held.append((turn, role, text))
                chars += len(text or "")
                if len(out) >= 256 or chars > CHUNK_CHARS // 4 and out:
                    yield _rows(_CHUNK_KIND, out)
                    out.clear()
        if held:
            chunk(whole=False)
        if out:
            yield _rows(_CHUNK_KIND, out)

    rows = chats.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    ).withColumns({"h": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv", "turn", "role", "text").mapInArrow(pack, _CHUNK_KIND)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation in order: (g, costs at its start, turns before it, costs at its end)."""
    key, costs, turns = None, [], 0
    for batch in batches:
        rows = []
        for conv, g, n, run in zip(*[c.to_pylist() for c in batch.columns]):
            if key is None or key[0] != conv:
                key, costs, turns = (conv,), [0, _FAR, _FAR, _FAR], 0
            after = times(costs, run)
            rows.append((g, costs, turns, after))
            costs, turns = after, turns + n
        yield _rows("g long, costs array<long>, position long, after array<long>", rows)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from its end: (g, state at its end, whether it is the last one)."""
    key, state = None, 0
    for batch in batches:
        rows = []
        for conv, g, back, after in zip(*[c.to_pylist() for c in batch.columns]):
            last = key is None or key[0] != conv
            if last:
                key, state = (conv,), closing_state(after)
            rows.append((g, state, last))
            state = back[state]
        yield _rows("g long, state int, last boolean", rows)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for conv, turns, codes, roles, bodies, costs, position, state, last in zip(*[c.to_pylist() for c in batch.columns]):
            if costs is None:
                costs, position, last = [0, _FAR, _FAR, _FAR], 0, True
                state = closing_state(times(costs, matrix(codes)))
            path = states(codes, costs, state)
            for row in render(path, codes, turns, roles, bodies, conv, position, last):
                out.append(row)
                held += len(row[-1])
                if len(out) == 4096 or held > CHUNK_CHARS:
                    yield _rows(_OUT, out)
                    out, held = [], 0
        if out:
            yield _rows(_OUT, out)


def repair(
    chats: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """(conv_id, position, step, turn, operation, role, fragment): the cheapest legal form of each conversation.

    Ordered by (position, step), the fragments of a conversation joined are its rendered form.
    ``position`` counts its turns from 0; ``turn`` is null for inserted turns and for the end. Operations
    are keep, relabel, merge, relabel and merge, insert and end. Of several cheapest ways the one with
    the first states from the end is taken, whatever the chunks.

    Turns are ordered by ``turn``, nulls first, then by a hash of role and text, so repeated rows are
    turns of their own. A null or unknown role has to take one; a null text is empty; rows with a
    null conversation form one conversation. Other columns are not read; an empty table has no rows.
    """
    chunks = materialise(_chunks(chats, conv_col, turn_col, role_col, text_col, chunk), "chat-chunks")
    body = ["conv_id", "turns", "codes", "roles", "texts"]
    none = {"costs": "array<long>", "position": "long", "state": "int", "last": "boolean"}
    whole = chunks.where("whole").select(*body, *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    cut = chunks.where("not whole")
    heads = cut.select("conv_id", "g", "n", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "g")
    ahead = heads.mapInArrow(_forward, "g long, costs array<long>, position long, after array<long>")
    ahead = materialise(ahead, "chat-costs")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            found = [(conv, g, ways_back(codes, costs), after) for conv, g, codes, costs, after in rows]
            yield _rows("conv_id long, g long, back array<long>, after array<long>", found)

    maps = cut.select("conv_id", "g", "codes").join(ahead, "g").select("conv_id", "g", "codes", "costs", "after")
    maps = maps.mapInArrow(back, "conv_id long, g long, back array<long>, after array<long>")
    maps = maps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("g"))
    ends = materialise(maps.mapInArrow(_backward, "g long, state int, last boolean"), "chat-states")
    solved = cut.join(ahead.select("g", "costs", "position"), "g").join(ends, "g")
    solved = solved.select(*body, "costs", "position", "state", "last")
    return whole.unionByName(solved).mapInArrow(_repair, _OUT)
