"""Benchmark decontamination: test items found inside documents of any length.

Containment search in the manner of size-partitioned MinHash: documents fall into partitions by
their number of distinct shingles, (2^(p-1), 2^p]. Partition p signs with 2^p one-permutation
bins, as many as its largest document has shingles, so that a contained item keeps most of
its minima whatever surrounds it. A document is compared with the signatures that the items have
under its own partition's bins; one equal minimum makes a candidate. A contained shingle is its
document's minimum with chance 0.63 at least; an item of which s shingles are contained is
missed with chance 0.37^s. Items with fewer than ``EXACT_BELOW`` shingles are looked up by all of
their shingles instead. Candidates are verified by their exact shingles.

The items are a stated set of queries: they are shipped to the tasks in blocks of bounded
bytes, one scan of the documents per block. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import PLAIN, blocks, distinct, one_by_one, packed, unpacked

EXACT_BELOW = 20
# Text of the items shipped at once. Signatures and sets take some ten times as much.
ITEM_BYTES = 4 << 20

MATCHES = "array<struct<item_id: bigint, n_shingles: int, n_shared: int>>"
_ARROW_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_shared", pa.int32())]))


@dataclass(frozen=True)
class Containment:
    shingle: int = 5
    percent: int = 80


def _words(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN_BYTES).split()


# Byte to lower-cased byte, or to a blank between words.
_PLAIN_BYTES = bytes(int(v) - 1 if v else 32 for v in PLAIN)


def exact_shingles(data: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = _words(data)
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else set()


def _partition(n: int) -> int:
    return max(0, int(n - 1).bit_length()) if n else 0


def _minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The least hash of each of 2^bits bins; hashes are distinct and sorted, bins are their first bits."""
    if not bits:
        return hashes[:1]
    at = hashes >> np.uint64(64 - bits)
    return hashes[np.concatenate(([True], at[1:] != at[:-1]))] if len(hashes) else hashes


class Items:
    """A block of items, ready for lookups. Made once per task."""

    def __init__(self, rows: list[tuple[int, bytes]], how: Containment):
        self.how = how
        self.ids = [i for i, _ in rows]
        self.sets = [exact_shingles(t, how.shingle) for _, t in rows]
        self.hashes = [
            distinct(s) for block in blocks((t for _, t in rows), PLAIN) for s in block.shingles(how.shingle, False)
        ]
        self._signed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def signed(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted minima of all items under a partition's bins, and the item each is of."""
        if bits not in self._signed:
            kept = [h if len(h) < EXACT_BELOW else _minima(h, bits) for h in self.hashes]
            values = np.concatenate([*kept, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
            order = np.argsort(values, kind="stable")
            self._signed[bits] = values[order], owner[order]
        return self._signed[bits]

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items that share a minimum with a document, or, short ones, a shingle."""
        bits = _partition(len(hashes))
        values, owner = self.signed(bits)
        if not len(values) or not len(hashes):
            return np.empty(0, np.int64)
        where = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
        hit = hashes[where] == values
        if not hit.any():
            return np.empty(0, np.int64)
        # Long items count only where the document's own minimum is met.
        least = np.isin(values[hit], _minima(hashes, bits))
        short = np.array([len(self.hashes[o]) < EXACT_BELOW for o in owner[hit]])
        return np.unique(owner[hit][least | short])

    def matches(self, text: bytes, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        found = self.candidates(distinct(hashes))
        if not len(found):
            return []
        own = exact_shingles(text, self.how.shingle)
        out = []
        for i in found:
            shared = len(self.sets[i] & own)
            if 100 * shared >= self.how.percent * len(self.sets[i]):
                out.append((self.ids[i], len(self.sets[i]), shared))
        return sorted(out)


def _matcher(shipped, how: Containment):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shipped.value, how)
        names = ("item_id", "n_shingles", "n_shared")
        for batch in texts:
            yield pa.array(
                [
                    [dict(zip(names, m)) for m in items.matches(text, hashes)]
                    for block in blocks(one_by_one(batch), PLAIN)
                    for text, hashes in zip(block.texts, block.shingles(how.shingle, False))
                ],
                _ARROW_MATCHES,
            )

    return F.arrow_udf(run, MATCHES)


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items with words, in blocks of about ``limit`` bytes; only one block is held at a time."""
    items = items.where("item_id is not null and length(text) > 0").select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted({(r.item_id, bytes(r.text)) for r in own.collect()})


def with_matches(
    docs: DataFrame, items: DataFrame, how: Containment | None = None, text: str = "text", limit: int = ITEM_BYTES
) -> DataFrame:
    """``_row`` and ``_matches``: the items of which a document holds at least ``percent`` of the
    distinct shingles, with both counts.

    Words are runs of letters and digits, A-Z lower-cased. Items with fewer words than a shingle
    match nothing, so do null ones; a repeated item_id may match once per text. Null and empty
    documents hold nothing.
    """
    how = how or Containment()
    rows = packed(docs)
    found = []
    for block in _item_blocks(items, limit):
        shipped = docs.sparkSession.sparkContext.broadcast(block)
        found.append(_matcher(shipped, how)(F.col(f"_row.{text}").cast("binary")))
    matches = F.flatten(F.array(*found)) if len(found) > 1 else found[0] if found else F.array().cast(MATCHES)
    return rows.withColumn("_matches", matches)


def contaminated(docs: DataFrame, items: DataFrame, how: Containment | None = None, text: str = "text") -> DataFrame:
    """Pairs doc_id, item_id, n_shingles, n_shared, containment; one per row of docs and item.

    Null and empty texts hold nothing. Rows that repeat a document each give its pairs. An empty
    table of documents gives no rows, and so does one of items.
    """
    return (
        with_matches(docs, items, how, text)
        .select(F.col("_row.doc_id").cast("bigint").alias("doc_id"), F.explode("_matches").alias("m"))
        .select(
            "doc_id",
            "m.item_id",
            F.col("m.n_shingles").cast("bigint").alias("n_shingles"),
            F.col("m.n_shared").cast("bigint").alias("n_shared"),
            (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, how: Containment | None = None, text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns as they were, whatever their names.

    Null and empty texts stay, repeated rows stay or go together, without items all stay.
    """
    return unpacked(with_matches(docs, items, how, text).where(F.size("_matches") == 0))
