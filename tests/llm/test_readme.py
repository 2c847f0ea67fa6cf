"""Bounds that the README documents."""

from __future__ import annotations

from pathlib import Path

from framelake.llm import toxicity


def test_documented_training_bound():
    text = (Path(__file__).resolve().parents[2] / "README.md").read_text()
    assert f"at most {toxicity.TRAIN_ROWS:,} labelled documents (`TRAIN_ROWS`)" in text
