"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from framelake.llm import decontamination, quality, toxicity
from framelake.llm.common import table

from .test_near_copies import plain_kept


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, sf), "t")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert len(stages) == 5
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_classifier_stages(stages, spark, sf):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, sf, "labels").collect()}
    for k, bad in ((0, (0, None)), (1, (None, 1))):
        _, before, after = stages[k]
        gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
        clean = [i for i in labels if labels[i] == (1, 0)]
        assert sum(i in gone for i in clean) <= 0.05 * len(clean)
        wrong = [i for i in labels if labels[i][k] == bad[k] and i in {r["doc_id"] for r in before.select("doc_id").collect()}]
        assert sum(i in gone for i in wrong) >= 0.6 * len(wrong)
    assert quality.FEATURES and toxicity.STEPS


def test_dedup_stage(stages):
    _, before, after = stages[2]
    kept = plain_kept({r["doc_id"]: r["text"] for r in before.collect()})
    assert {r["doc_id"] for r in after.collect()} == kept
    # Near copies of documents 6 and 1 at this scale, more than three fingerprint bits apart.
    assert {145, 177} <= {r["doc_id"] for r in before.collect()} - kept


def test_decontamination_stage(stages, spark, sf):
    _, before, after = stages[3]
    found = decontamination.find_contamination(before, table(spark, sf, "benchmark"))
    clean = {r["doc_id"] for r in found.where("not contaminated").collect()}
    assert {r["doc_id"] for r in after.collect()} == clean


def test_last_stage(stages):
    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]] for r in rows)


def test_run_is_the_stages_in_order(stages, spark, sf):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == {r["doc_id"] for r in stages[-1][2].collect()}


def test_odd_rows_pass_every_stage(spark, sf):
    """Null and empty texts, repeated rows and ids, a long text, clashing names; and an empty table."""
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "one two three", 3), (3, "word " * 60_000, 4), (4, "é", 5)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, score long, h string, root string")
    for name, stage in corpus_pipeline.STAGES:
        for table_ in (docs, docs.limit(0)):
            after = stage(spark, table_, sf)
            found = after.collect()
            assert len(found) <= table_.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns, name
                assert {r["doc_id"] for r in found} <= {r[0] for r in rows}
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert len(kept) == 4 and sum(not r["text"] for r in kept) == 1
