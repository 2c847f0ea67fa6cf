"""The operators applied to the given tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_repair,
    collocations,
    decontamination,
    posting_lists,
    quality,
    sentence_pieces,
    sharding,
    simhash,
    structure_audit,
    token_counts,
    token_records,
    toxicity,
    warc,
)
from .common import in_fold, shared_folder, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after private data are replaced by tags."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    edited = token_counts.count_edited(table(spark, sf_dir, "documents"), path, token_counts.private_edits)
    pieces = F.size("counts").cast("long").alias("n_pieces")
    return edited.select(F.col("id").alias("doc_id"), "n_tokens_before", "n_tokens", "n_edits", "n_skipped", "n_encoded", pieces)


def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in its cheapest legal form, as rendered fragments."""
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as records and read back."""
    folder = shared_folder(spark, "token-records")
    token_records.write_records(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    back = token_records.read_records(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), asked=F.col("id") % 20 == 0, neighbours=20)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids and the text that the ids give back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), model)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score per document; a third of the ids is never learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, labels, learn=~in_fold(F.col("id"), 3, 1))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", predicted)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back with its revisits resolved."""
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    back = warc.resolve_revisits(warc.read_archives(spark, folder, payloads=False))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score per document; a quarter of the ids is never learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, labels, learn=~in_fold(F.col("doc_id"), 4, 2))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted)


def op11_structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after a stated damage."""
    return structure_audit.audit_damaged(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal length, equal texts together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS t
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item FROM dw JOIN bw USING (n, t)),
places AS (SELECT r, count(DISTINCT p) AS n_hit
           FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN original IS NULL OR original IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN o USING (h)
"""

OP11 = r"""
WITH RECURSIVE
bits AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
         FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
             lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS INT)]))) % 20 AS kind
  FROM keyed, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE kind <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS ini FROM damaged),
rowsof AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before
  FROM placed),
nxt(s, r) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
put(st, mid, n) AS (VALUES ('n', 'n', 0), ('n', 'u', 1), ('n', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2),
                           ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)),
ways AS MATERIALIZED (
  SELECT st, mid AS after, repeat('I', n) || 'D' AS letters, 5 * n + 2 AS price, 'D' AS kind FROM put
  UNION ALL SELECT st, r, repeat('I', n) || 'K', 5 * n, 'K' FROM put JOIN nxt ON s = mid
  UNION ALL SELECT st, r, repeat('I', n) || 'R', 5 * n + 1, 'R' FROM put JOIN nxt ON s = mid WHERE r IN ('u', 'a')),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM rowsof)
  UNION ALL
  SELECT conv_id, i, st, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT d.conv_id, r.i, w.after AS st,
             d.cost + w.price + CASE WHEN r.fault = 3 AND w.kind <> 'D' THEN 5 ELSE 0 END AS cost, d.audit || w.letters AS audit
      FROM dp d JOIN rowsof r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN ways w ON w.st = d.st
      WHERE w.kind = 'D' OR r.fault IN (0, 3) AND (w.kind = 'R' OR r.ini = w.after)))
  WHERE best = 1),
ends AS (
  SELECT conv_id, cost + 5 * more AS cost, audit || repeat('I', more) AS audit
  FROM (SELECT *, CASE st WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END AS more FROM dp)
  WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM rowsof GROUP BY conv_id)),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (
  SELECT conv_id, p, audit[p] AS letter, len(replace(audit[1:p], 'I', '')) AS i, len(replace(audit[1:p], 'D', '')) AS e
  FROM (SELECT *, unnest(generate_series(1, len(audit))) AS p FROM best)),
spelled AS (
  SELECT l.conv_id, l.p, l.letter, l.e, CASE WHEN l.letter IN ('K', 'R') THEN r.text ELSE '' END AS text, r.role, r.ini
  FROM letters l LEFT JOIN rowsof r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
opened AS (
  SELECT *, max(CASE WHEN e = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM spelled),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                                    chr(10) ORDER BY p)) AS h FROM opened GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rowsof GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.m, a, k, x.f AS l, y.f AS r,
         CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, array_to_string(w[s:s + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS s FROM c WHERE m = 3))
  GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_repair": op2_chat_repair,
    "op3_token_records": op3_token_records,
    "op4_posting_lists": op4_posting_lists,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op5_decontamination": op5_decontamination,
    "op11_structure_audit": op11_structure_audit,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
}
ORACLES = {
    "op9_warc": OP9,
    "op11_structure_audit": OP11,
    "op12_collocations": OP12,
    "op5_decontamination": OP5,
}
