"""Token counts, token records and sentence pieces against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import queries, sentence_pieces, token_counts, token_records
from framelake.llm.common import shared_folder, table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b\n c \n\n d", "　 y\x85 z", "<|endoftext|> a b<|endoftext|>", "it's  'll\t we 've   ", "a,b (c) d... e",
    "é à  b", "x" * 3000, "the " * 2000, "naïve²  x_y z9", "▁a ▁ b", "é字𝄞 𝄞𝄞x", "<s> </s> <0x41> <unk>",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counts(BPE)


BITS = st.sampled_from(["'", "s", "'ll", " ", "  ", "\n", "a", "1", "!", " x", "'re é", "", "<|endoftext|>", "ab cd  ef"])
TEXT = st.lists(BITS, max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25), TEXT), max_size=5), st.sampled_from([2, 64]))
def test_tree_follows_edits(counter, plain, text, edits, leaf):
    token_counts.LEAF, before = leaf, token_counts.LEAF
    try:
        pieces = counter.find(text)
        tree = token_counts.PreTokenTree(pieces, counter.of(pieces), counter)
        for start, size, new in edits:
            tree.edit(start, start + size, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + size :]
            assert tree.text() == text
            assert [p for part in tree.pieces for p in part] == counter.find(text)
            assert tree.total() == len(plain.encode(text, add_special_tokens=False).ids)
    finally:
        token_counts.LEAF = before


def test_an_edit_encodes_its_surroundings_only(counter):
    pieces = counter.find("one two three " * 3000)
    tree = token_counts.PreTokenTree(pieces, counter.of(pieces), counter)
    tree.edit(20_000, 20_003, "new")
    assert 0 < tree.encoded < 20


def test_edits_of_rows(spark, plain):
    text = "mail a.b@c.org or call +49 123 456 7890 now"
    kind = "doc_id long, text string, edits array<struct<start int, end int, text string>>, counts int"
    rows = [
        (1, text, [(5, 14, "X"), (18, 22, None)], 1),
        (1, text, [(0, 4, "A"), (2, 6, "overlaps"), (None, 3, "lost"), (99, 120, "!")], 2),
        (None, None, [(0, 0, "new")], 3),
        (2, "", None, 4),
    ]
    docs = spark.createDataFrame(rows, kind)
    trees = token_counts.build_trees(docs, BPE)
    out = token_counts.apply_edits(
        trees.join(docs.select(F.col("doc_id").alias("id"), "edits", "text"), ["id", "text"], "left"), F.col("edits"), BPE
    )
    got = {(r["id"], r["text"], r["n_edits"], r["n_skipped"]) for r in out.collect()}
    assert (1, text.replace("a.b@c.org", "X").replace("call", ""), 2, 0) in got
    assert (1, "A" + text[4:] + "!", 2, 2) in got and (2, "", 0, 0) in got
    for r in out.collect():
        assert r["n_tokens"] == sum(r["counts"]) == len(plain.encode(r["text"], add_special_tokens=False).ids)
    edits = docs.select(token_counts.redactions("text").alias("e")).first()["e"]
    assert [(text[e["start"] : e["end"]], e["text"]) for e in edits] == [("a.b@c.org", "[EMAIL]"), ("+49 123 456 7890", "[NUMBER]")]
    assert token_counts.build_trees(docs.limit(0), BPE).count() == 0
    one_pass = token_counts.count_edited(docs, BPE, token_counts.private_edits)
    two = token_counts.apply_edits(token_counts.build_trees(docs, BPE), token_counts.redactions("text"), BPE)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one_pass) == key(two)


def test_count_query_against_the_library(spark, sf, plain):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op1_token_counts(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_edits"] for r in rows)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens_before"] == len(plain.encode(text, add_special_tokens=False).ids)
        wanted, _ = token_counts.clean_edits(token_counts.private_edits(text), len(text))
        for start, end, new in reversed(wanted):
            text = text[:start] + new + text[end:]
        assert r["n_tokens"] == len(plain.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["at 1.2.3.4 555 123 4567 now", "write 1234567890@x.com now"])
def test_overlapping_private_data_is_one_edit(text):
    edits, skipped = token_counts.clean_edits(token_counts.private_edits(text), len(text))
    assert skipped == 0 and len(edits) == 1
    start, end, tag = edits[0]
    assert not any(c.isdigit() or c == "@" for c in text[:start] + text[end:]) and tag.startswith("[")


def test_query_returns_skipped_edits(spark, sf):
    assert all(r["n_skipped"] == 0 for r in queries.op1_token_counts(spark, sf).select("n_skipped").collect())


def test_encoder_equals_the_library():
    whole = Tokenizer.from_file(BPE)
    encoder = token_records.Encoder(BPE, 3)
    assert encoder.cut
    for _ in range(2):  # the second time with a full memory
        got = encoder.encode(ODD)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in ODD]
    other = token_records.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.cut
    assert np.frombuffer(other.encode(["Some Text"])[0], "<u2").tolist() == other.whole.encode("Some Text", add_special_tokens=False).ids


def test_every_character_is_encoded_as_the_library_does():
    """All code points, in the contexts in which classes matter; the classes here may be of another version."""
    whole, encoder = Tokenizer.from_file(BPE), token_records.Encoder(BPE, 10)
    counter = token_counts.Counts(BPE, 10)
    # Beyond the second plane only the last is assigned, in part.
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200)]]
    for k in range(0, len(chars), 4096):
        encoder.pre_tokens.learn(chars[k : k + 4096])
    counter.encoder.pre_tokens.odd, counter.encoder.pre_tokens.agreed = encoder.pre_tokens.odd, encoder.pre_tokens.agreed
    odd = list(encoder.pre_tokens.odd)
    assert "\u0558" in odd
    # Some odd characters alone, all others a hundred to a text.
    sound = [c for c in chars if c not in encoder.pre_tokens.odd]
    groups = [[c] for c in odd[::20]] + [sound[k : k + 100] for k in range(0, len(sound), 100)]
    for n, context in enumerate(("x{}'s ", "{}1 ", "1{} x", "!{}! ", " {} ", "{}\n", "a{}{}b ", "'{}ll ")):
        texts = ["".join(context.replace("{}", c) for c in group) for group in groups[n::8]]
        want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        got = encoder.encode(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == want
        for text, ids in list(zip(texts, want))[::9]:
            pieces = counter.find(text)
            assert "".join(pieces) == text and sum(counter.of(pieces)) == len(ids)


def test_edits_beside_characters_of_another_class(counter, plain):
    text = "x\u0558's and \u0c5c1 then \u208f!\u208f end \U00010940s"
    for start, size, new in ((1, 1, "y"), (0, 0, "\u0558"), (4, 3, "\u0c5c"), (9, 2, ""), (2, 9, "1\u208f2")):
        pieces = counter.find(text)
        tree = token_counts.PreTokenTree(pieces, counter.of(pieces), counter)
        tree.edit(start, start + size, new)
        after = text[:start] + new + text[start + size :]
        assert tree.text() == after and tree.total() == len(plain.encode(after, add_special_tokens=False).ids)


def brute_records(rows):
    whole, at, out = Tokenizer.from_file(BPE), 0, []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_record_query(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect())
    got = sorted(tuple(r) for r in queries.op3_token_records(spark, sf).collect())
    assert got == brute_records(rows)


def test_records_of_odd_rows(spark):
    rows = [(5, "five"), (None, None), (5, "five"), (-1, ""), (3, "x" * 70_000), (None, "null id")]
    docs = spark.createDataFrame([(*r, "start", 0) for r in rows], "doc_id long, text string, ids string, start long")
    folder = shared_folder(spark, "t")
    token_records.write_records(docs, folder, BPE)
    got = token_records.read_records(spark, folder, block=2)
    got = sorted(got.select("start", "doc_id", "n_tokens", token_records.as_list("ids").alias("ids")).collect())
    assert [r["doc_id"] for r in got] == [None, None, -1, 3, 5, 5]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert all(r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"] for r in got)
    shuffled = token_records.read_records(spark, folder, seed=3, block=2)
    assert {r["start"]: r["n_tokens"] for r in shuffled.collect()} == {r["start"]: r["n_tokens"] for r in got}
    empty = shared_folder(spark, "t")
    token_records.write_records(docs.limit(0), empty, BPE)
    assert token_records.read_records(spark, empty).count() == 0


@pytest.mark.parametrize("place", [3, 9, 14, 40, -2])
def test_damage_is_found(spark, place):
    docs = spark.createDataFrame([(k, "some words here " * 9) for k in range(4)], "doc_id long, text string")
    folder = shared_folder(spark, "t")
    token_records.write_records(docs.coalesce(1), folder, BPE)
    path = folder.removeprefix("file://").removeprefix("file:")
    name = sorted(f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(path)) if f.path.endswith(".bin"))[0]
    raw = bytearray(open(name, "rb").read())
    raw[place] ^= 1
    open(name, "wb").write(bytes(raw))
    with pytest.raises(Exception, match="damaged|index|offset|negative|buffer"):
        token_records.read_records(spark, folder).collect()


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.PieceModel(PIECES, 50)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | TEXT)
def test_pieces_equal_the_library(pieces, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.encode(text).tolist() == library.encode(text)
    assert pieces.decode(library.encode(text)) == library.decode(library.encode(text))


def test_pieces_of_documents_as_words_and_as_a_stream(pieces, library, spark, sf):
    texts = [r["text"] for r in table(spark, sf, "documents").limit(60).collect()] + ODD
    assert [x.tolist() for x in pieces.encode_batch(texts)] == library.encode(texts)
    pieces.word_cut = False
    try:
        assert [x.tolist() for x in pieces.encode_batch(texts)] == library.encode(texts)
    finally:
        pieces.word_cut = True


def test_a_common_start_of_words_is_searched_once(library, monkeypatch):
    """A stem of 15 letters in 90 words with other endings: the places that the searches look at."""
    places, search = [], sentence_pieces.PieceModel._extend

    def counted(self, window, last, *rest):
        places.append(len(window) + 1 - len(last))
        return search(self, window, last, *rest)

    monkeypatch.setattr(sentence_pieces.PieceModel, "_extend", counted)
    pieces = sentence_pieces.PieceModel(PIECES)
    text = " ".join("thhationendlyer" + c for c in map(chr, range(33, 123)))
    assert pieces.encode(text).tolist() == library.encode(text)
    assert sum(places) < 200


def test_characters_as_bytes(pieces, library):
    """Ids of the bytes of characters, among others and a control id."""
    rnd = random.Random(3)
    for _ in range(200):
        chosen = [[pieces.bytes[b] for b in rnd.choice("\nAé中😀").encode()] for _ in range(rnd.randint(1, 5))]
        chosen.insert(rnd.randint(0, len(chosen)), [rnd.choice([pieces.ids["▁the"], pieces.unknown, 1])])
        ids = [pieces.ids["▁the"], *(k for part in chosen for k in part)]
        assert pieces.decode(ids) == library.decode(ids)


def test_ids_are_given_out_before_the_end(pieces):
    parts = pieces.search("▁" + "thequickbrownfox" * 500)
    assert 0 < len(next(parts)) < 200


def test_unigram_search_finds_the_best_sum(pieces, monkeypatch):
    """The same pieces and scores as a unigram model: compared with all segmentations."""
    monkeypatch.setattr(pieces, "kind", sentence_pieces.UNIGRAM)
    rnd = random.Random(4)
    for _ in range(60):
        text = "".join(rnd.choice("theranoc▁") for _ in range(rnd.randint(1, 9)))

        def best(rest):
            if not rest:
                return 0.0
            return max(pieces.scores[pieces.ids[rest[:k]]] + best(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in pieces.usable)

        ids = [k for part in pieces.search(text) for k in part]
        assert "".join(pieces.strings[k] for k in ids) == text
        assert sum(pieces.scores[k] for k in ids) == pytest.approx(best(text))


def test_piece_rows(spark, library):
    rows = [(1, "some text"), (1, "some text"), (None, None), (2, ""), (3, "y " * 30_000)]
    docs = spark.createDataFrame([(*r, [1], "d") for r in rows], "doc_id long, text string, ids array<int>, decoded string")
    got = sentence_pieces.encode_documents(docs, PIECES).collect()
    want = sorted([(i, library.encode(t or ""), len(library.encode(t or "")), t or "") for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    back = sentence_pieces.decode_documents(docs.withColumn("ids", F.lit(None).cast("array<int>")), PIECES)
    assert {r["text"] for r in back.collect()} == {None}
    assert sentence_pieces.encode_documents(docs.limit(0), PIECES).count() == 0


def test_piece_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in queries.op6_sentence_pieces(spark, sf).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
