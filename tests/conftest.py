from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from framelake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[*]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def cache(spark, tmp_path_factory):
    """A small learnable cache: 16 numbers per vector, 48 frames per class and location."""
    from framelake import make_synthetic_cache

    root = str(tmp_path_factory.mktemp("cache") / "emb")
    return make_synthetic_cache(spark, root, dim=16, n_per_class=48, seed=1)
