"""Frames of phone sensors, their embeddings and the heads on top, as Spark jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from .operators.evaluation import evaluate
from .operators.heads import HeadModel, list_heads, make_head
from .operators.leaderboard import leaderboard
from .operators.metrics import EvalResult, evaluate_predictions
from .operators.submission import ValidationReport, validate, write_submission
from .operators.synthetic import make_synthetic_cache
from .session import build_session
from .sources.runs import log_run, read_experiments, read_runs, track
from .sources.vector_cache import EmbeddingSet, embeddings, list_available, save_embedding_set

__version__ = "0.1.0"

# Functions that run in tasks are sent with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "EmbeddingSet",
    "EvalResult",
    "HeadModel",
    "ValidationReport",
    "build_session",
    "embeddings",
    "evaluate",
    "evaluate_predictions",
    "leaderboard",
    "list_available",
    "list_heads",
    "log_run",
    "make_head",
    "make_synthetic_cache",
    "read_experiments",
    "read_runs",
    "save_embedding_set",
    "track",
    "validate",
    "write_submission",
]
