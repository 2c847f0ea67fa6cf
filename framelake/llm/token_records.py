"""Token ids in files of length-delimited binary records, with an index for reading in any order.

A data file is a run of frames::

    length   u64  bytes of the payload
    masked crc of the eight length bytes, u32
    payload       u8 flag, i64 document id, then the ids
    masked crc of the payload, u32

Numbers are little-endian. The flag is 1 for ids of two bytes and 2 for four bytes (taken when the
vocabulary needs them), plus 4 if the document id is null. The checksum is CRC-32, rotated right by
15 bits and offset, so that checksums stored in a payload do not look like those of its frame. The
index file beside it holds (offset u64, first token u64) per frame and one closing pair, both counted
within the file. ``manifest`` (Parquet) lists the files in document order.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attempt_path, file_system, publish, small_batches, texts, worker_memory

#: Distinct pieces of text whose ids a worker remembers, the most recent ones.
REMEMBERED = 1_000_000
#: Records per reading task, at least.
BLOCK = 20_000
#: The pre-token pattern of byte-level vocabularies, and the alphabet that stands for bytes.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_ALPHABET = "".join(chr(b if b in _PLAIN else 256 + _OTHER.index(b)) for b in range(256))
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s]+)").fullmatch
#: White space in front of a space; searching for each pair is several times faster than one pattern.
_SPACES = [chr(c) + " " for c in [*range(0x3001), 0xFEFF] if chr(c).isspace()]
_MASK = 0xA282EAD8
_HEAD, _HEAD_SIZE = "<Bq", 9
_PAIR, _PAIR_SIZE = "<QQ", 16


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read: Callable[[int], bytes]) -> bytes:
    """The next payload; damage raises ValueError."""
    head = read(12)
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


class PreTokens:
    """The pre-token pattern, with the character classes of the tokenizers library.

    The library's Unicode tables are of another version than those here. A character is tried with both
    when it is first met; where they disagree, the pattern sees a character of the library's class in
    its place, so the pre-tokens are the library's.
    """

    #: One character of each class; both sides agree on them.
    STANDING = {"letter": "é", "number": "²", "space": "\xa0", "other": "§"}

    def __init__(self, library) -> None:
        self.library = library
        self.pattern = regex.compile(PRE_TOKEN)
        self.agreed: set[str] = set()
        self.odd: dict[str, str] = {}
        self.learn([chr(c) for c in range(128)])
        self.odd_ascii = list(self.odd)

    def _class_there(self, chars: list[str]) -> list[str]:
        """The library's class: a character is not cut off from one of its own class."""
        starts = {start for _, (start, _) in self.library.pre_tokenize_str("".join([f"x{c}\n1{c}\n!{c}\n" for c in chars]))}
        joined = (("letter", 1), ("number", 4), ("other", 7))
        return [next((name for name, k in joined if 9 * i + k not in starts), "space") for i in range(len(chars))]

    @staticmethod
    def _class_here(char: str) -> str:
        """The class of the pattern, or of Python's own tests where those say something else."""
        for name, pattern, test in (("letter", r"\p{L}", str.isalpha), ("number", r"\p{N}", None), ("space", r"\s", str.isspace)):
            found = regex.match(pattern, char) is not None
            if test is not None and test(char) != found:
                return "unsure"
            if found:
                return name
        return "other"

    def learn(self, chars: list[str]) -> None:
        """Try some characters with both sides."""
        for char, there in zip(chars, self._class_there(chars)):
            if self._class_here(char) == there:
                self.agreed.add(char)
            else:
                self.odd[char] = self.STANDING[there]

    def is_odd(self, text: str) -> bool:
        """Whether a text holds a character on which the two sides disagree."""
        if any(c in text for c in self.odd_ascii):
            return True
        if text.isascii():
            return False
        rest = set(text).difference(self.agreed)
        if rest:
            self.learn(sorted(rest.difference(self.odd)))
        return not rest.isdisjoint(self.odd)

    def seen(self, text: str) -> str:
        """The text as the pattern has to see it, character by character."""
        return "".join([self.odd.get(c, c) for c in text]) if self.is_odd(text) else text

    def find(self, text: str) -> list[str]:
        seen = self.seen(text)
        return self.pattern.findall(text) if seen is text else [text[m.start() : m.end()] for m in self.pattern.finditer(seen)]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.pattern.finditer(self.seen(text)))


class Slots(dict):
    """Numbers for keys in order of first use; ``new`` holds the keys that got one since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = found = len(self)
        self.new.append(key)
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the pieces between spaces.

    A byte-level pre-tokenizer never joins a space to what stands before it unless that is white
    space too, so a text may be cut before such a space and the ids of the parts are the ids of the
    text. Each new part goes through the library once. Texts that hold a special token's string or a
    character that the library files elsewhere, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.wide = self.whole.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        kind = self.whole.pre_tokenizer
        state = kind.__getstate__() if kind is not None else b""
        wanted = (b'"type":"ByteLevel"', b'"add_prefix_space":false', b'"use_regex":true')
        self.cut = self.whole.normalizer is None and all(w in state for w in wanted)
        # Parts reach the model as pre-tokens in the byte alphabet, joined by the byte 255, which no text holds.
        self.parts = Tokenizer.from_file(path)
        self.parts.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\xff")
        self.pre_tokens = PreTokens(kind) if self.cut else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        #: Parts behind a space, and marks behind a word as tuples; the ids of slot k are ``ids[starts[k]:][:sizes[k]]``.
        self.slots = Slots()
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, self.dtype)
        self.used = 0

    def _keep(self, slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of some slots, given one behind the other."""
        if len(self.slots) > len(self.sizes):
            more = np.zeros(2 * len(self.slots) - len(self.sizes), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[slots] = self.used + np.cumsum(sizes) - sizes
        self.sizes[slots] = sizes
        self.used += len(ids)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some slots one behind the other, and how many of each."""
        sizes = self.sizes[slots]
        at = np.repeat(self.starts[slots] - np.cumsum(sizes) + sizes, sizes)
        return self.ids[at + np.arange(len(at))], sizes

    def _arrays(self, pieces: list[str], sizes: np.ndarray, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as pre-tokens, ``sizes`` of them each, and how many of each text; 256 texts to a call's row.

        ``lead`` stands before every pre-token.
        """
        ends = np.concatenate([[0], np.cumsum(sizes)])
        rows, marks = [], []
        for start in range(0, len(sizes), 256):
            mark = ends[start : start + 257]
            joined = (lead + ("\udcff" + lead).join(pieces[mark[0] : mark[-1]])).encode(errors="surrogateescape")
            rows.append(codecs.charmap_decode(joined, "strict", BYTE_ALPHABET)[0])
            marks.append(mark - mark[0])
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for mark, row in zip(marks, self.parts.encode_batch(rows, add_special_tokens=False)):
            ids.append(np.array(row.ids, self.dtype))
            counts.append(np.diff(np.searchsorted(np.array(row.word_ids), mark)))
        return np.concatenate(ids), np.concatenate(counts)

    def _ids(self, pieces: list[str], sizes: np.ndarray) -> Iterator[bytes]:
        """The same, text by text."""
        ids, counts = self._arrays(pieces, sizes)
        whole, ends = ids.tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
        yield from map(whole.__getitem__, map(slice, [0, *ends], ends))

    def _learn(self) -> None:
        """Remember the ids of the keys that have a slot and no ids yet.

        Letters and the marks behind them are pre-tokens of their own, so of such a part only its
        letters are encoded, if they are not known either.
        """
        slots, fresh, self.slots.new = self.slots, self.slots.new, []
        base = len(slots) - len(fresh)
        alpha = np.fromiter(map(str.isalpha, fresh), bool, len(fresh))
        plain, places = list(compress(fresh, alpha)), [base + np.flatnonzero(alpha)]
        rest, whole, joined = list(compress(fresh, ~alpha)), [], []
        for slot, part, found in zip((base + np.flatnonzero(~alpha)).tolist(), rest, map(_WORD_AND_MARKS, rest)):
            if found and (word := found[1]).isalpha():
                joined.append((slot, slots[word], slots[(found[2],)]))
            else:
                whole.append((slot, " " + part))
        more = []
        for slot, key in enumerate(slots.new, base + len(fresh)):
            if isinstance(key, tuple):
                whole.append((slot, key[0]))
            else:
                plain.append(key)
                more.append(slot)
        slots.new = []
        if plain:
            places = np.concatenate([*places, np.array(more, np.int64)])
            self._keep(places, *self._arrays(plain, np.ones(len(plain), np.int64), " "))
        if whole:
            places, parts = zip(*whole)
            found = [self.find(p) for p in parts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(np.array(places), *self._arrays([x for f in found for x in f], sizes))
        if joined:
            places = np.array(joined)
            ids, sizes = self._gather(places[:, 1:].ravel())
            self._keep(places[:, 0], ids, sizes.reshape(-1, 2).sum(1))

    def _split(self, parts: list[str]) -> Iterator[bytes]:
        found = [self.find(p) for p in parts]
        return self._ids([x for f in found for x in f], np.fromiter(map(len, found), np.int64, len(found)))

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The first part, then what follows each space at which the text may be cut."""
        pieces = text.split(" ")
        if text[:1] != " " and not any(pair in text for pair in _SPACES):
            return pieces
        out, held = [], pieces[0]
        for piece in pieces[1:]:
            # No cut behind white space, nor at the start of the text.
            if held and not held[-1].isspace():
                out.append(held)
                held = piece
            else:
                held += " " + piece
        return [*out, held]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers."""
        odd = lambda t: any(s in t for s in self.special) or self.pre_tokens.is_odd(t)
        cut = [self._cut(t) if self.cut and not odd(t) else None for t in batch]
        if len(self.slots) > self.remembered:
            self._forget()
        sizes = [0 if c is None else len(c) - 1 for c in cut]
        every = chain.from_iterable([c[1:] for c in cut if c is not None])
        slots = np.fromiter(map(self.slots.__getitem__, every), np.int64, sum(sizes))
        if self.slots.new:
            self._learn()
        ids, counts = self._gather(slots)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *sizes])]
        first = self._split([c[0] for c in cut if c is not None])
        out = []
        for text, parts, start, end in zip(batch, cut, ends.tolist(), ends[1:].tolist()):
            if parts is None:
                whole = self.whole.encode(text, add_special_tokens=False).ids
                out.append(np.array(whole, self.dtype).tobytes())
            else:
                out.append(next(first) + ids[start:end].tobytes())
        return out


def _encoder(path: str) -> Encoder:
    return worker_memory(f"encoder {path}", lambda: Encoder(path))


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``id_col``; returns the manifest.

    ``folder`` is a new folder that driver and executors share. ``end_id`` closes every sequence. A
    null or empty text is a sequence of ``end_id`` alone. Null ids come first; rows that repeat an id
    stay, ordered by a hash of their text. Other columns are not read. An empty table writes an empty
    manifest. Each task writes its files under a name of its own attempt and renames them when
    they are whole, so a task that runs twice replaces its files by equal ones.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        task = TaskContext.get()
        fs, root = file_system(folder)
        name = f"part-{task.partitionId():06d}"
        attempt = attempt_path(root, name, task.taskAttemptId())
        data = index = None
        offset = tokens = records = 0
        for batch in small_batches(batches):
            if data is None:
                fs.create_dir(root, recursive=True)
                data, index = fs.open_output_stream(attempt + ".bin"), fs.open_output_stream(attempt + ".idx")
            pairs = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch.column(1)))):
                flag = (2 if encoder.wide else 1) + (4 if doc_id is None else 0)
                record = frame(struct.pack(_HEAD, flag, doc_id or 0) + ids + end)
                data.write(record)
                pairs.append(struct.pack(_PAIR, offset, tokens))
                offset += len(record)
                tokens += len(ids) // encoder.dtype.itemsize + 1
                records += 1
            index.write(b"".join(pairs))
        if data is None:
            return
        index.write(struct.pack(_PAIR, offset, tokens))
        data.close()
        index.close()
        publish(fs, attempt + ".idx", f"{root}/{name}.idx")
        publish(fs, attempt + ".bin", f"{root}/{name}.bin")
        yield pa.RecordBatch.from_pydict(
            {"part": [task.partitionId()], "file": [name], "records": [records], "tokens": [tokens], "bytes": [offset]},
            schema=pa.schema(
                [("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]
            ),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows that repeat an id are told apart by their text and place, so that they can be dealt out.
    keyed = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(F.col("id").asc_nulls_first(), "h", "row")
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "row").select("id", "text")
    manifest = ordered.mapInArrow(write, "part int, file string, records long, tokens long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _blocks(spark: SparkSession, folder: str, block: int, seed: int | None) -> DataFrame:
    """(file, first, last, base): runs of records, each for one task. The manifest has a row per file."""
    files = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    rows, base = [], 0
    for f in files:
        rows += [(f["file"], s, min(s + block, f["records"]), base) for s in range(0, f["records"], block)]
        base += f["tokens"]
    out = spark.createDataFrame(rows, "file string, first long, last long, base long")
    order = F.xxhash64("file", "first") if seed is None else F.xxhash64(F.lit(seed), "file", "first")
    return out.repartitionByRange(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)), order)


def read_records(spark: SparkSession, folder: str, seed: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every sequence, checksums verified.

    ``start`` counts the ids of all documents before it and ``ids`` holds little-endian unsigned
    32-bit numbers (:func:`as_list` makes an array of them). Reading starts at the offsets in the
    index. With ``seed`` blocks are dealt to tasks by a hash and each task visits the records of a
    block in a random order of that seed: the order of training data. Damage raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}.idx") as f:
                    f.seek(row["first"] * _PAIR_SIZE)
                    raw = f.read((row["last"] - row["first"] + 1) * _PAIR_SIZE)
                index = np.frombuffer(raw, "<u8").reshape(-1, 2)
                count = row["last"] - row["first"]
                order = np.arange(count)
                if seed is not None:
                    np.random.default_rng([seed, zlib.crc32(row["file"].encode()), row["first"]]).shuffle(order)
                with fs.open_input_file(f"{root}/{row['file']}.bin") as f:
                    for start in range(0, count, 256):
                        yield _read_some(f, index, order[start : start + 256], row["base"])

    return _blocks(spark, folder, block, seed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _read_some(f, index: np.ndarray, places: np.ndarray, base: int) -> pa.RecordBatch:
    ids, docs, starts, sizes = [], [], [], []
    for place in places:
        f.seek(int(index[place, 0]))
        payload = unframe(f.read)
        flag, doc_id = struct.unpack_from(_HEAD, payload)
        values = np.frombuffer(payload, "<u2" if flag & 1 else "<u4", offset=_HEAD_SIZE)
        if len(values) != int(index[place + 1, 1] - index[place, 1]):
            raise ValueError("the index does not match its file")
        docs.append(None if flag & 4 else doc_id)
        starts.append(base + int(index[place, 1]))
        sizes.append(len(values))
        ids.append(values.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def as_list(ids: pa.Array) -> pa.Array:
    """The ids of a sequence as an array."""
    return pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in ids.to_pylist()], pa.list_(pa.int32()))
