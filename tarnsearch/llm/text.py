"""Words of texts: as Spark expressions, and as arrays of hashes inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"

# Words between white space, and words of letters and digits (after lower-casing A-Z).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is the quicker way where there is nothing else."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def whole(text: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """All columns in one, ``_row``, so that no name of ours meets one of theirs."""
    return df.select(F.struct("*").alias("_row"))


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("_row.*", *more)


def document_key(column: str = "doc_id") -> Column:
    """The id as a key: rows without one are one document, smaller than any other."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-(2**63)))


def _table(separators: bytes, lower: bool) -> np.ndarray:
    """Per byte a number, 0 for what separates words."""
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


SPACED = _table(SPACES.encode(), lower=True)
SPACED_CASED = _table(SPACES.encode(), lower=False)
PLAIN = _table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 2 * len(_powers[0])), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where words start and end, and a 64-bit hash of each (lower-cased) word."""
    if not data:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    values = table[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = values != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_up_to(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Block:
    """Some neighbouring texts of a batch and their words; ``words`` of text i are at bounds[i]:bounds[i + 1]."""

    texts: list[bytes]
    bounds: np.ndarray
    starts: np.ndarray  # in bytes, from the start of the word's own text
    ends: np.ndarray
    words: np.ndarray

    def shingles(self, size: int, short: bool = True) -> Iterator[np.ndarray]:
        """Per text the hashes of its shingles, in order."""
        rolled = shingles(self.words, size, False)
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            yield rolled[a : b - size + 1] if b - a >= size else shingles(self.words[a:b], size, short)


BLOCK_BYTES = 1 << 20


def one_by_one(column: pa.Array) -> Iterator[bytes | None]:
    """The values of an Arrow column, none of them held longer than it is looked at."""
    return (value.as_py() for value in column)


def blocks(texts: Iterable[bytes | None], table: np.ndarray) -> Iterator[Block]:
    """The texts of a batch in blocks of about a megabyte (a longer text alone), so that
    arrays are long enough to be quick and short enough to be cheap. Null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= BLOCK_BYTES:
            yield _block(held, table)
            held, size = [], 0
    if held:
        yield _block(held, table)


def _block(texts: list[bytes], table: np.ndarray) -> Block:
    starts, ends, words = word_hashes(b"\n".join(texts), table)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, first)
    shift = np.repeat(first[:-1], np.diff(bounds))
    return Block(texts, bounds, starts - shift, ends - shift, words)


def shingles(words: np.ndarray, size: int, short: bool = True) -> np.ndarray:
    """Hash of the ``size`` words starting at each place. Fewer words are one shingle, if ``short``."""
    if len(words) < size:
        if not short or not len(words):
            return np.empty(0, np.uint64)
        size = len(words)
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words[i : i + n]
    return mix(total)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes
