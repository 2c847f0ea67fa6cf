"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a tree hold runs of pre-tokens with their token counts, the nodes above the sums of
characters and tokens. An edit finds its place by descending on the character sums. Pre-tokens whose
match could have looked at edited characters are read anew from the last unaffected boundary on, until a
new boundary falls on an old one; behind it nothing can differ. Only new pre-tokens are encoded, and the
sums on the way from the changed leaves to the root are updated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, texts, worker_memory
from .token_records import Encoder

#: Pre-tokens in a leaf when a tree is built; a leaf is cut up once it has four times as many.
LEAF = 64
#: Characters behind its end that a match of the pre-token pattern may depend on.
LOOK = 3
#: Pre-tokens whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000

EDITS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
    )
)


class Counts:
    """Token counts of pre-tokens by the tokenizers library; special tokens' strings count as plain text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.encoder = Encoder(path, 0)
        if not self.encoder.cut:
            raise ValueError("only byte-level tokenizers have independent pre-tokens")
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.find = self.encoder.pre_tokens.find
        self.spans = self.encoder.pre_tokens.spans

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.remembered:
            self.known.clear()
        new = list(pieces.difference(self.known))
        size = self.encoder.dtype.itemsize
        found = self.encoder._ids(new, np.ones(len(new), np.int64))
        self.known.update(zip(new, [len(x) // size for x in found]))

    def of(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return list(map(self.known.__getitem__, pieces))


class PreTokenTree:
    """Pre-tokens of one text and their counts, in leaves below sums of characters and tokens."""

    def __init__(self, pieces: list[str], counts: list[int], counter: Counts):
        self.counter = counter
        self.encoded = 0
        self._build([(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)])

    def _build(self, leaves: list[tuple[list[str], list[int]]]) -> None:
        self.pieces = [leaf[0] for leaf in leaves] or [[]]
        self.counts = [leaf[1] for leaf in leaves] or [[]]
        self.base = 1 << (len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (pieces, counts) in enumerate(zip(self.pieces, self.counts)):
            self.chars[self.base + k], self.tokens[self.base + k] = sum(map(len, pieces)), sum(counts)
        for node in range(self.base - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join([p for leaf in self.pieces for p in leaf])

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.pieces[leaf], self.counts[leaf] = pieces, counts
        node = self.base + leaf
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the pre-token that holds the character at ``place``, or of the end."""
        node, left = 1, 0
        while node < self.base:
            node *= 2
            if place - left >= self.chars[node] and place < self.chars[1]:
                left += self.chars[node]
                node += 1
            elif place >= self.chars[1]:
                left += self.chars[node]
                node += 1
        leaf = min(node - self.base, len(self.pieces) - 1)
        if place >= self.chars[1]:
            return len(self.pieces) - 1, len(self.pieces[-1]), self.chars[1]
        for index, piece in enumerate(self.pieces[leaf]):
            if place < left + len(piece):
                return leaf, index, left
            left += len(piece)
        raise AssertionError("sums do not match the leaves")

    def _before(self, leaf: int, index: int) -> tuple[int, int] | None:
        while index == 0:
            leaf -= 1
            if leaf < 0:
                return None
            index = len(self.pieces[leaf])
        return leaf, index - 1

    def edit(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the characters from ``start`` to ``end``; places beyond the end are the end."""
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        leaf, index, left = self._find(start)
        # Step back over every pre-token whose match may have looked at the edited characters.
        while (back := self._before(leaf, index)) is not None and left + LOOK > start:
            leaf, index = back
            left -= len(self.pieces[leaf][index])
        # Old pre-tokens from there on, taken in as they are needed.
        old, bounds, at = [], {left: 0}, left
        far_leaf, far_index = leaf, index

        def take(until: int) -> None:
            nonlocal far_leaf, far_index, at
            while at < until:
                while far_index >= len(self.pieces[far_leaf]):
                    far_leaf, far_index = far_leaf + 1, 0
                piece = self.pieces[far_leaf][far_index]
                far_index += 1
                old.append(piece)
                at += len(piece)
                bounds[at] = len(old)

        whole, reach = self.chars[1], 64
        while True:
            take(min(end + reach, whole))
            joined = "".join(old)
            head = joined[: start - left] + text
            buffer = head + joined[end - left :]
            last = at >= whole
            new, stop = [], None
            for begun, ended in self.counter.spans(buffer):
                if not last and ended + LOOK > len(buffer):
                    break
                new.append(buffer[begun:ended])
                place = end + ended - len(head)
                if ended >= len(head) and place in bounds:
                    stop = bounds[place]
                    break
            if not buffer:
                stop = len(old)
            if stop is not None:
                break
            reach *= 4
        counts = self.counter.of(new)
        self.encoded += len(new)
        self._replace(leaf, index, stop, new, counts)

    def _replace(self, leaf: int, index: int, gone: int, new: list[str], counts: list[int]) -> None:
        """Put new pre-tokens in place of the ``gone`` ones that start at (leaf, index)."""
        far_leaf, far_index = leaf, index
        while gone:
            step = min(gone, len(self.pieces[far_leaf]) - far_index)
            gone -= step
            far_index += step
            if gone:
                far_leaf, far_index = far_leaf + 1, 0
        pieces, numbers = self.pieces[leaf][:index] + new, self.counts[leaf][:index] + counts
        if far_leaf == leaf:
            pieces += self.pieces[leaf][far_index:]
            numbers += self.counts[leaf][far_index:]
        else:
            for k in range(leaf + 1, far_leaf):
                self._set(k, [], [])
            self._set(far_leaf, self.pieces[far_leaf][far_index:], self.counts[far_leaf][far_index:])
        self._set(leaf, pieces, numbers)
        if len(pieces) > 4 * LEAF:
            flat = [p for leaf in self.pieces for p in leaf], [n for leaf in self.counts for n in leaf]
            self._build([(flat[0][k : k + LEAF], flat[1][k : k + LEAF]) for k in range(0, len(flat[0]), LEAF)])


def clean_edits(edits: list[dict] | None, size: int) -> tuple[list[tuple[int, int, str]], int]:
    """Edits by ascending place and the number left out: those without places and those that overlap an earlier one."""
    out, skipped, reached = [], 0, 0
    given = [e for e in edits or [] if e is not None and e["start"] is not None and e["end"] is not None]
    skipped = len(edits or []) - len(given)
    for e in sorted(given, key=lambda e: (e["start"], e["end"], e["text"] or "")):
        start = min(max(e["start"], 0), size)
        end = min(max(e["end"], start), size)
        if start < reached:
            skipped += 1
            continue
        out.append((start, end, e["text"] or ""))
        reached = max(end, start)
    return out, skipped


def _counts(path: str) -> Counts:
    return worker_memory(f"counts {path}", lambda: Counts(path))


_TREE = "id long, text string, lengths array<int>, counts array<int>, n_tokens long"
_EDITED = "id long, text string, lengths array<int>, counts array<int>, n_tokens_before long, n_tokens long, n_edits long, n_skipped long, n_encoded long"


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(offsets, flat)


def _edited(out: dict[str, list]) -> pa.RecordBatch:
    columns = [
        _lists(v) if k in ("lengths", "counts") else pa.array(v, pa.string() if k == "text" else pa.int64())
        for k, v in out.items()
    ]
    return pa.RecordBatch.from_arrays(columns, names=list(out))


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, lengths, counts, n_tokens) per document row: the leaves of its tree, as a table keeps them.

    ``lengths`` and ``counts`` have an entry per pre-token: its characters and its tokens. A null text
    counts as empty and has none. Repeated rows and null ids keep their rows; other columns are not read.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counts(tokenizer)
        for batch in small_batches(batches):
            bodies = texts(batch.column(1))
            pieces = [counter.find(t) for t in bodies]
            counter.learn(set().union(*pieces))
            counts = [counter.of(p) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(bodies, pa.string()),
                    _lists([list(map(len, p)) for p in pieces]),
                    _lists(counts),
                    pa.array([sum(c) for c in counts], pa.int64()),
                ],
                names=["id", "text", "lengths", "counts", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(build, _TREE)


def apply_edits(trees: DataFrame, edits_col: Column, tokenizer: str) -> DataFrame:
    """Trees after the edits of each row, with the counts before and after.

    ``edits_col`` is an array of (start, end, text): characters of the text as it stands in the row, all
    applied together. A null array has no edits and a null text deletes. Places beyond the text are its
    end. Edits without places, and edits that overlap an earlier one, are left out and counted in
    ``n_skipped``. ``n_encoded`` counts the pre-tokens read anew.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counts(tokenizer)
        for batch in small_batches(batches, 128):
            out = {c.split()[0]: [] for c in _EDITED.split(", ")}
            for doc_id, text, lengths, counts, before, edits in zip(*[c.to_pylist() for c in batch.columns]):
                wanted, skipped = clean_edits(edits, len(text))
                encoded = 0
                after = before
                if wanted:
                    ends = np.cumsum(lengths, dtype=np.int64).tolist()
                    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
                    tree = PreTokenTree(pieces, counts, counter)
                    # From the end, so that places before an edit stay what they are.
                    for start, end, new in reversed(wanted):
                        tree.edit(start, end, new)
                    pieces = [p for leaf in tree.pieces for p in leaf]
                    text, lengths, counts = "".join(pieces), list(map(len, pieces)), [n for leaf in tree.counts for n in leaf]
                    encoded, after = tree.encoded, tree.total()
                row = (doc_id, text, lengths, counts, before, after, len(wanted), skipped, encoded)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield _edited(out)

    return trees.select("id", "text", "lengths", "counts", "n_tokens", edits_col.alias("edits")).mapInArrow(apply, _EDITED)


def count_edited(
    docs: DataFrame,
    tokenizer: str,
    edits: Callable[[str], list[dict]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """:func:`build_trees` and :func:`apply_edits` in one pass, the edits found in each text by a function."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counts(tokenizer)
        for batch in small_batches(batches, 256):
            bodies = texts(batch.column(1))
            pieces = [counter.find(t) for t in bodies]
            counter.learn(set().union(*pieces))
            counts = [counter.of(p) for p in pieces]
            found = [clean_edits(edits(t), len(t)) for t in bodies]
            out = {c.split()[0]: [] for c in _EDITED.split(", ")}
            for doc_id, text, own, numbers, (wanted, skipped) in zip(batch.column(0).to_pylist(), bodies, pieces, counts, found):
                before = after = sum(numbers)
                encoded = 0
                if wanted:
                    tree = PreTokenTree(own, numbers, counter)
                    for start, end, new in reversed(wanted):
                        tree.edit(start, end, new)
                    own, numbers = [p for leaf in tree.pieces for p in leaf], [n for leaf in tree.counts for n in leaf]
                    text, encoded, after = "".join(own), tree.encoded, tree.total()
                row = (doc_id, text, list(map(len, own)), numbers, before, after, len(wanted), skipped, encoded)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield _edited(out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, _EDITED)


#: What :func:`redactions` looks for, in this order, and what it puts there.
PRIVATE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"\+?\d[\d ().-]{7,}\d", "[NUMBER]"),
)


def private_edits(text: str) -> list[dict]:
    """Edits that put a tag in place of mail addresses, IP addresses and long numbers.

    Finds that overlap become one edit over all of them, with the tag of the first, of those the longest.
    """
    found = []
    for pattern, tag in PRIVATE:
        if tag == "[EMAIL]" and "@" not in text:
            continue
        found += [{"start": m.start(), "end": m.end(), "text": tag} for m in re.finditer(pattern, text)]
    merged = []
    for e in sorted(found, key=lambda e: (e["start"], -e["end"])):
        if merged and e["start"] < merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], e["end"])
        else:
            merged.append(e)
    return merged


@F.arrow_udf(EDITS)
def redactions(column: pa.Array) -> pa.Array:
    """:func:`private_edits` of a text column."""
    out = [private_edits(t or "") for t in column.to_pylist()]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    return pa.array(out, kind)
