"""SentencePiece ids by a streaming search, and the text back from ids.

The search keeps, for every character, the one piece that ends there on the way from the start: its
backpointer. A window of the longest piece's length bounds what can still change, so once the
backpointers of all places in the window meet in one boundary, the ids before it are final and are
given out. Memory is bounded however long a text is.

A unigram model takes, at each place, the piece with the best sum of scores (Viterbi). In a BPE model
scores are merge ranks and not additive. There the piece that ends at a place is the one that may follow
the last piece at its start: two pieces are neighbours in a BPE result exactly if merging their
joined characters gives the two back. That leaves one path per place, which is the library's result.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, worker_memory

SPACE = "▁"
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
UNIGRAM, BPE = 1, 2


class PieceModel:
    """Pieces, scores and kind of a model file; encodes and decodes without the library's search."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.strings = [model.id_to_piece(k) for k in range(self.size)]
        self.scores = [model.get_score(k) for k in range(self.size)]
        self.kind = _model_kind(path)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have pieces to search")
        # Only an identity normaliser with a leading space gives the text back; others are refused.
        if model.encode("a  b", out_type=str) != model.encode("a  b ", out_type=str)[:-1] or model.encode(" a") == model.encode("a"):
            raise ValueError("the model changes white space")
        special = {k for k in range(self.size) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k)}
        self.unknown = model.unk_id()
        self.bytes = {int(self.strings[k][3:5], 16): k for k in range(self.size) if model.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.silent = {k for k in special if k != self.unknown}
        self.ids = {s: k for k, s in enumerate(self.strings) if k not in special and k not in self.byte_of}
        self.rank = {s: -self.scores[k] for s, k in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        # Characters that stand side by side in some piece; no merge goes across others.
        self.joined = {a + b for s in self.rank for a, b in pairwise(s)}
        if self.kind == BPE:
            # A piece that merging never makes cannot be in a result.
            self.usable = {s for s in self.ids if len(s) == 1 or self._merged(s) == [s]}
        else:
            self.usable = set(self.ids)
        self.longest = max(map(len, self.usable))
        # Every ending of a piece, with the piece's id or -1 where the ending is no piece itself.
        self.endings = {s[k:]: -1 for s in self.usable for k in range(len(s))}
        self.endings |= {s: self.ids[s] for s in self.usable}
        self.worst = min((self.scores[k] for k in self.ids.values()), default=0.0) - 10.0
        # Where no piece holds a space behind another character, every path has a boundary before a space.
        self.word_cut = not any(SPACE in s.lstrip(SPACE) for s in self.usable)
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _merged(self, text: str) -> list[str]:
        """Merge the neighbours of best rank, leftmost first, until none can be merged."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min(
                ((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                default=(0, -1),
            )
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _neighbours(self, left: int, right: int) -> bool:
        a, b = self.strings[left], self.strings[right]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        found = a[-1] + b[0] not in self.joined or self._merged(a + b) == [a, b]
        self.pairs[left << 32 | right] = found
        return found

    def _extend(self, window: str, last: list[int], sizes: list[int], total: list[float]) -> None:
        """Find the piece that ends at each further place of the window: its id, size and summed score.

        -1 stands for a character without a piece, -2 for the start of the text. BPE has no sums.
        """
        if self.kind == BPE:
            return self._extend_merged(window, last, sizes)
        endings, longest, scores = self.endings, self.longest, self.scores
        for end in range(len(last), len(window) + 1):
            chosen, width, best = -1, 1, 0.0
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                piece = endings.get(window[start:end])
                if piece is None:
                    break
                if piece >= 0 and (chosen < 0 or total[start] + scores[piece] > best):
                    chosen, width, best = piece, end - start, total[start] + scores[piece]
            last.append(chosen)
            sizes.append(width)
            total.append(best if chosen >= 0 else total[end - 1] + self.worst)

    def _extend_merged(self, window: str, last: list[int], sizes: list[int]) -> None:
        ending, fitting = self.endings.get, self.pairs.get
        for end in range(len(last), len(window) + 1):
            chosen, start = -1, end - 1
            while start >= 0:
                piece = ending(window[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    before = last[start]
                    if before < 0:
                        chosen = piece
                        break
                    fits = fitting(before << 32 | piece)
                    if fits is None:
                        fits = self._neighbours(before, piece)
                    if fits:
                        chosen = piece
                        break
                start -= 1
            last.append(chosen)
            sizes.append(end - start if chosen >= 0 else 1)

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, given out as soon as they are final; at most a few windows are held."""
        longest = self.longest
        block = 4 * longest
        window, last, sizes, total = "", [-2], [0], [0.0]
        for begin in range(0, len(text), block):
            window += text[begin : begin + block]
            self._extend(window, last, sizes, total)
            if begin + block >= len(text):
                break
            # Walk the places that a later piece can start at back to where all of them meet.
            end = len(window)
            heads = set(range(max(end - longest + 1, 0), end + 1))
            while len(heads) > 1:
                place = max(heads)
                heads.remove(place)
                heads.add(place - sizes[place])
            place = heads.pop()
            if place > 0:
                yield self._path(window, last, sizes, place)
                window, last, sizes = window[place:], last[place:], sizes[place:]
                total = [t - total[place] for t in total[place:]]
        yield self._path(window, last, sizes, len(window))

    def _path(self, window: str, last: list[int], sizes: list[int], place: int) -> list[int]:
        """The ids on the way to a place; a character without a piece becomes its bytes or the unknown id."""
        out = []
        while place > 0:
            piece = last[place]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(window[place - 1].encode())]
            else:
                out.append(self.unknown)
            place -= sizes[place]
        out.reverse()
        return out

    def _learn(self, words: Iterable[str]) -> None:
        """Remember the ids of words, each with the space before it.

        In sorted order a search goes on from the places that the word before it had found for their common start.
        """
        before, last, sizes, total = "", [-2], [0], [0.0]
        for word in sorted(words):
            text = SPACE + word
            if len(text) > 2 * self.longest:
                ids = array("i", [k for part in self.search(text) for k in part])
            else:
                same = 1
                for a, b in zip(before, text):
                    if a != b:
                        break
                    same += 1
                del last[same:], sizes[same:], total[same:]
                self._extend(text, last, sizes, total)
                before = text
                ids = array("i", self._path(text, last, sizes, len(text)))
            if sys.byteorder == "big":
                ids.byteswap()
            self.known[word] = ids.tobytes()

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of whole texts; an empty text has none.

        Words between boundaries that all paths share are searched once and remembered.
        """
        if not self.word_cut:
            spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in batch]
            return [np.array([k for part in self.search(t) for k in part], np.int32) for t in spaced]
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = []
        for text in batch:
            words = text.replace(SPACE, " ").split(" ")
            cut.append(_with_spaces(words) if "" in words else words)
        self._learn(set().union(*cut).difference(self.known))
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, words)) if text else b"", "<i4") for text, words in zip(batch, cut)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes become characters (wrong ones U+FFFD), control ids nothing."""
        strings, high = self._decoding()
        ids = list(ids)
        if high.isdisjoint(ids):
            text = "".join(map(strings.__getitem__, ids))
            return text[1:] if text.startswith(" ") else text
        out, held = [], bytearray()
        for k in ids:
            if k in high:
                held.append(self.byte_of[k])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(strings[k])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text

    def _decoding(self) -> tuple[list[str], set[int]]:
        """What each id stands for, and the ids of bytes that are characters only together with others.

        A byte below 128 is a character whatever stands around it.
        """
        if not hasattr(self, "_plain"):
            plain = [s.replace(SPACE, " ") for s in self.strings]
            plain[self.unknown] = " ⁇ "
            for k in self.silent:
                plain[k] = ""
            for k, b in self.byte_of.items():
                plain[k] = chr(b)
            self._plain = plain, {k for k, b in self.byte_of.items() if b >= 128}
        return self._plain


def _with_spaces(words: list[str]) -> list[str]:
    """Words with the spaces that stand before them, but for the first space of each."""
    out, held = [], ""
    for word in words[:-1]:
        if word:
            out.append(held + word)
            held = ""
        else:
            held += SPACE
    return [*out, held + words[-1]]


def _model_kind(path: str) -> int:
    """The model type from the trainer settings of the file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return int(model.trainer_spec.model_type)


def _model(path: str) -> PieceModel:
    return worker_memory(f"pieces {path}", lambda: PieceModel(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_ids, decoded) per document row; ``decoded`` is the text of the ids.

    A null text is encoded as empty and has no ids; its decoded text is empty. Repeated rows and null
    ids keep their rows, other columns are not read, and an empty table gives no rows. U+2581 in a
    text is decoded as a space, as the library does.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in small_batches(batches):
            found = pieces.encode_batch(texts(batch.column(1)))
            sizes = [len(f) for f in found]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.array(sizes, pa.int64()),
                    pa.array([pieces.decode(f.tolist()) for f in found], pa.string()),
                ],
                names=["id", "ids", "n_ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(encode, "id long, ids array<int>, n_ids long, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in small_batches(batches):
            found = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, "id long, text string").withColumnRenamed("id", id_col)
