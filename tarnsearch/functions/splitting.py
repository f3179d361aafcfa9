"""Cut one text into overlapping pieces at the coarsest separator that fits."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of the text, each but the first opening with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    pieces = [separator + part for part in rest]
    return [head, *pieces] if head else pieces


def _merge(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Join neighbours up to ``size``; each result repeats up to ``overlap`` of the last."""
    merged = []
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        if total + len(piece) > size and window:
            merged.append("".join(window))
            while window and (total > overlap or (total + len(piece) > size and total > 0)):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    if window:
        merged.append("".join(window))
    return [text for text in (m.strip() for m in merged) if text]


def split_text(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    level = next(
        (i for i, sep in enumerate(separators) if not sep or sep in text), len(separators) - 1
    )
    finer = separators[level + 1 :]
    result: list[str] = []
    short: list[str] = []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        result += _merge(short, size, overlap)
        short = []
        # With no finer separator left the piece goes out whole.
        result += split_text(piece, size, overlap, finer) if finer else [piece]
    return result + _merge(short, size, overlap)
