"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Every window of
``size`` consecutive words of a benchmark item (or the whole item if it is shorter) is a key. Each
document window is hashed from its words in place, looked up in the broadcast set of keys, and a hit
counts only after its words were compared with those of the benchmark window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.session import fits_broadcast, materialise

from .common import ascii_lower, fresh

WINDOW = 10
#: What separates words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word with the separators behind it, or separators that stand first.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The key set is broadcast only when measured to stay below both bounds.
BROADCAST_WINDOWS = 2_000_000
BROADCAST_BYTES = 256 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _key(all_words: str, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(all_words, start + j) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(length, words, group): the distinct windows; ``group`` names the set of items that have it.

    Repeated items add nothing. An item without words has no window; a null item id is the text
    "null".
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item", F.col("w"), F.explode(starts).alias("s"))
    cut = cut.select("item", F.slice("w", F.col("s"), F.least(F.size("w"), F.lit(size))).alias("words"))
    return (
        cut.groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.size("words").alias("length"), "words", "items", F.sha2(F.to_json("items"), 256).alias("group"))
    )


def _spans(windows: DataFrame, docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Each document window that is in the benchmark, plus one row without ``group`` per document.

    ``docs`` has (row, id, words). Documents without words give one row.
    """
    places = docs.select("row", "id", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "_"))
    here = F.array(*[F.when(F.col("pos") + n <= F.col("n_words"), F.lit(n)) for n in lengths])
    if len(lengths) == 1:
        keyed = places.withColumn("length", F.when(F.col("pos") + lengths[0] <= F.col("n_words"), F.lit(lengths[0])))
    else:
        keyed = places.withColumn("length", F.explode(here))
    key = F.coalesce(*[F.when(F.col("length") == n, _key("w", F.col("pos"), n)) for n in lengths])
    keyed = keyed.select("row", "id", "n_words", "w", "pos", "length", key.alias("k"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    # A window that does not exist has no key; the first place of a document stands for the document.
    keyed = keyed.where(F.col("k").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    key_b = F.coalesce(*[F.when(F.col("length") == n, _key("words", F.lit(0), n)) for n in lengths])
    known = windows.select(
        F.col("length").alias("length_b"), F.col("words").alias("words_b"), "group", key_b.alias("k_b")
    )
    if fits_broadcast(known, BROADCAST_WINDOWS, BROADCAST_BYTES):
        met = keyed.join(
            F.broadcast(known), (F.col("k") == F.col("k_b")) & (F.col("length") == F.col("length_b")), "left"
        )
        # Words are compared behind the join: as a join key they would be cut out for every window.
        same = F.slice("w", F.col("pos") + 1, F.col("length")) == F.col("words_b")
        met = met.where(F.col("group").isNotNull() | first)
        return met.select("row", "id", "n_words", "pos", "length", F.when(same, F.col("group")).alias("group"))
    # A set beyond the bound is met by shuffle. Places travel with a digest of their words, which
    # takes the place of comparing the words.
    keyed = keyed.withColumn("text_key", F.sha2(F.concat_ws(" ", F.slice("w", F.col("pos") + 1, F.col("length"))), 256))
    there = known.select("length_b", "group", F.sha2(F.concat_ws(" ", "words_b"), 256).alias("text_key_b"))
    met = keyed.select("row", "id", "n_words", "pos", "length", "text_key", first.alias("first")).join(
        there, (F.col("text_key") == F.col("text_key_b")) & (F.col("length") == F.col("length_b")), "left"
    )
    met = met.where(F.col("group").isNotNull() | F.col("first"))
    return met.select("row", "id", "n_words", "pos", "length", "group")


def _covered() -> Column:
    """Words inside at least one of the collected (start, end) pairs."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(seen: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["start"], seen["end"]), F.lit(0))
        return F.struct(F.greatest(seen["end"], span["end"]).alias("end"), (seen["n"] + new).alias("n"))

    return F.aggregate(F.array_sort("spans"), begin, add, lambda seen: seen["n"].cast("long"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, spans, n_items, items_sha256, contaminated.

    ``spans`` holds the (start, end) of every hit window in words. A null text has no words and an
    empty or null benchmark text no window. Repeated rows and null ids each keep their own result
    row; other columns of the inputs are not read. With an empty benchmark nothing is hit. Texts of any
    length are searched whole, a document being one row of words.
    """
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, item_col, item_text_col, size), "benchmark-windows")
    # At most ``size`` lengths.
    lengths = sorted((r["length"] for r in windows.select("length").distinct().collect()), reverse=True) or [size]
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")
    )
    span = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("end"))
    per_doc = (
        _spans(windows, read, lengths)
        .groupBy("row", "id", "n_words")
        .agg(
            F.collect_set(F.when(F.col("group").isNotNull(), span)).alias("spans"),
            F.array_sort(F.collect_set("group")).alias("groups"),
        )
        .select(
            "row",
            "id",
            F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"),
            _covered().alias("n_hit"),
            "spans",
            "groups",
            F.sha2(F.to_json("groups"), 256).alias("case"),
        )
    )
    per_doc = materialise(per_doc, "contamination")
    # Documents that met the same sets of items share one list of items.
    cases = per_doc.where(F.size("groups") > 0).groupBy("case").agg(F.first("groups").alias("groups"))
    named = (
        cases.select("case", F.explode("groups").alias("group"))
        .join(windows.select("group", "items").dropDuplicates(["group"]), "group")
        .select("case", F.explode("items").alias("item"))
        .groupBy("case")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            "case",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )
    named = materialise(named, "contamination-cases")
    wide = F.broadcast(named) if fits_broadcast(named) else named
    hit = per_doc.where(F.size("groups") > 0).join(wide, "case", "left")
    clean = per_doc.where(F.size("groups") == 0).select(
        "*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256")
    )
    both = hit.unionByName(clean)
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        "spans",
        "n_items",
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _hit_spans(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int):
    """``docs`` with a row number and the spans that were hit, every column kept."""
    windows = materialise(benchmark_windows(benchmark, item_col, item_text_col, size), "benchmark-windows")
    lengths = sorted((r["length"] for r in windows.select("length").distinct().collect()), reverse=True) or [size]
    key = fresh(docs, "text_key")
    spans = fresh(docs, "hit_spans")
    # Equal texts have equal spans, so the spans are found once per text and carried by its digest.
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    read = keyed.select(F.col(key).alias("row"), F.lit(0).alias("id"), words(F.col(text_col)).alias("w"))
    span = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("end"))
    found = (
        _spans(windows, read, lengths)
        .where(F.col("group").isNotNull())
        .groupBy(F.col("row").alias(key))
        .agg(F.collect_set(span).alias(spans))
    )
    found = materialise(found, "hit-texts")
    wide = F.broadcast(found) if fits_broadcast(found) else found
    return keyed, wide, key, spans


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    ``mode="documents"`` leaves out each document with a hit word; ``mode="spans"`` cuts the hit
    words, with the separators behind them, out of the text and keeps the document. Rows with null
    or empty text, repeated rows and an empty benchmark pass through unchanged.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    columns = docs.columns
    keyed, found, key, spans = _hit_spans(docs, benchmark, text_col, item_col, item_text_col, size)
    if mode == "documents":
        return keyed.join(found.select(key), key, "left_anti").select(*columns)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0))
    # Separators that stand first are piece 0 without being a word.
    lead = F.when(F.col(text_col).rlike(r"^" + PIECE.split("|")[1]), 1).otherwise(0)

    def hit(place: Column) -> Column:
        word = place - lead
        return F.exists(F.col(spans), lambda s: (word >= s["start"]) & (word < s["end"]))

    kept = F.array_join(F.filter(pieces, lambda piece, place: ~hit(place)), "")
    text = F.when(F.col(spans).isNotNull(), kept).otherwise(F.col(text_col))
    joined = keyed.join(found, key, "left").withColumn(text_col, text)
    return joined.select(*columns)
