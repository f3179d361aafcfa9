"""Shipped settings and the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence

# The settings the pipeline ships with.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")
EMBED_BATCH = 32
PAIR_BATCH = 32
K_BM25 = 60
K_DENSE = 60
TOPN = 40
K_RRF = 60
K_FINAL = 10
MAX_CONTEXT_CHARS = 12000

# The Okapi constants.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Scores are cut to this many places before anything is ranked by them, so that
# the order in which a shuffle adds up floats cannot change a ranking.
SCORE_DIGITS = 6

# A question-side table is broadcast up to this many rows (checked by counting);
# beyond it every operator switches to a shuffled form.
BROADCAST_ROWS = 200_000
# Question vectors are shipped to the tasks up to this many bytes.
BROADCAST_VECTOR_BYTES = 256 * 1024 * 1024


def positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be > 0, got {value}")
    return value


def check_chunking(size: int, overlap: int, separators: Sequence[str]) -> None:
    positive("chunk_size", size)
    if overlap < 0:
        raise ValueError(f"chunk_overlap must be >= 0, got {overlap}")
    if overlap >= size:
        raise ValueError(f"chunk_overlap ({overlap}) must be smaller than chunk_size ({size})")
    if not separators:
        raise ValueError("separators must not be empty")


def check_metric(metric: str) -> str:
    if metric not in ("ip", "cosine"):
        raise ValueError(f"metric must be 'ip' or 'cosine', got {metric!r}")
    return metric
