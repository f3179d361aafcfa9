"""Stupid-backoff scores of documents under the n-gram model of all other documents.

Counts cover the whole corpus; a document's own words are taken off again when it is scored, so that
a text is not explained by itself. Done as tables of n-grams partitioned by hash:

1. Texts are numbered in blocks of about ``block_words`` words: the block's words by hash, its texts as
   their numbers. Written once, in buckets; a block is one row, and it is not moved again.
2. The distinct n-grams of each block, with their counts, go to the parts of the hash range, as one row of
   arrays per block and part. This is the only shuffle that n-grams of the whole corpus take.
3. In their part they are exploded to rows (block, hash, count), and the count table of the part is joined
   to them by a window over the hash: the sum without a second shuffle. What other blocks have too goes
   back to its block; an n-gram that no other block has needs no answer.
4. A block with its answers scores its texts, and the scores are summed per document.

Counting starts inside the blocks: an n-gram, however frequent, is at most one row per block, so no key has more
rows than the corpus has blocks. Groups of the window spill; no task holds more than a block and its answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.llm.text import SPACED, blocks, mix, one_by_one
from tarnsearch.plans.work import materialize_in_buckets

PART_WORDS = 1 << 24
LEAST_PART_BITS = 11
_NEXT = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Backoff:
    """N-grams of up to ``order`` words, ``discount`` per step back; an unseen word counts as ``unseen`` of one
    occurrence. ``block_words`` is the size of a block, for memory only: it changes no score."""

    order: int = 2
    discount: float = 0.4
    unseen: float = 0.5
    block_words: int = 1 << 20

    def __post_init__(self):
        if self.order < 1 or self.block_words < 1:
            raise ValueError("order and block_words must be at least 1")


def _lists(*columns: list[np.ndarray]) -> list[pa.Array]:
    """Columns of arrays, from the arrays of each row."""
    out = []
    for rows in columns:
        bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rows))))
    return out


BLOCKS = "block bigint, ids array<bigint>, bounds array<int>, numbers binary, words array<bigint>"


def _encode(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            words, numbers, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            # Frequent words have small numbers, which are squeezed well.
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[by_count] = np.arange(len(words), dtype=np.int32)
            squeezed = pa.compress(rank[numbers].tobytes(), codec="zstd", asbytes=True)
            bounds, words = _lists([np.cumsum([0, *lengths]).astype(np.int32)], [words[by_count].view(np.int64)])
            columns = [pa.array([first + made]), pa.array([ids], pa.list_(pa.int64())), bounds, pa.array([squeezed]), words]
            made += 1
            ids.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "bounds", "numbers", "words"])

        for batch in batches:
            names = iter(batch.column("id").to_pylist())
            for block in blocks(one_by_one(batch.column("text")), SPACED):
                held.append(block.words)
                ids += [i for _, i in zip(block.texts, names)]
                lengths += np.diff(block.bounds).tolist()
                if sum(map(len, held)) >= block_words:
                    yield flush()
        if ids:
            yield flush()

    return run


@dataclass
class NGrams:
    """The distinct n-grams of a block, those of one word first: their hashes and counts, and, per order, the
    number of the one that ends at each word of the block (-1 where its text has too few words before)."""

    hashes: np.ndarray
    counts: np.ndarray
    ending: list[np.ndarray]

    def by_hash(self) -> np.ndarray:
        return np.argsort(self.hashes, kind="stable")


def _ngrams(bounds: np.ndarray, numbers: np.ndarray, words: np.ndarray, order: int) -> NGrams:
    place = np.arange(len(numbers), dtype=np.int32) - np.repeat(bounds[:-1], np.diff(bounds))
    hashes, counts = [words], [np.bincount(numbers, minlength=len(words)).astype(np.int32)]
    # ``last`` is numbered within its own order, ``ending`` over all orders.
    last, ending, made = numbers, [numbers], len(words)
    for k in range(2, order + 1):
        at = np.flatnonzero(place >= k - 1)
        codes = last[at - 1].astype(np.int64) * max(1, len(words)) + numbers[at]
        distinct, which = np.unique(codes, return_inverse=True)
        del codes
        before, word = np.divmod(distinct, max(1, len(words)))
        hashes.append(mix(hashes[-1][before] * _NEXT + words[word]))
        counts.append(np.bincount(which, minlength=len(distinct)).astype(np.int32))
        last = np.full(len(numbers), -1, np.int32)
        last[at] = which
        del at, which
        ending.append(np.where(last < 0, np.int32(-1), last + np.int32(made)))
        made += len(distinct)
    return NGrams(np.concatenate(hashes), np.concatenate(counts), ending)


def _column(batch: pa.RecordBatch, name: str, row: int, kind=None) -> np.ndarray:
    values = batch.column(name)[row].values
    found = np.empty(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False)
    return found if kind is None else found.view(kind)


def _block_ngrams(batch: pa.RecordBatch, row: int, order: int) -> tuple[np.ndarray, NGrams]:
    bounds = _column(batch, "bounds", row)
    squeezed = batch.column("numbers")[row].as_buffer()
    numbers = np.frombuffer(pa.decompress(squeezed, 4 * int(bounds[-1]), codec="zstd"), np.int32)
    return bounds, _ngrams(bounds, numbers, _column(batch, "words", row, np.uint64), order)


PIECES = "part int, block bigint, first int, hashes array<bigint>, counts array<int>"


def _pieces(order: int, bits: int):
    """The n-grams of each block in the order of their hashes, cut at the bounds of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in enumerate(batch.column("block").to_pylist()):
                _, grams = _block_ngrams(batch, row, order)
                if not len(grams.hashes):
                    continue
                sort = grams.by_hash()
                hashes, counts = grams.hashes[sort], grams.counts[sort]
                parts = (hashes >> np.uint64(64 - bits)).astype(np.int32)
                cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
                first = np.concatenate(([0], cuts)).astype(np.int32)
                bounds = np.append(first, len(hashes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts[first]),
                        pa.array(np.full(len(first), block, np.int64)),
                        pa.array(first),
                        pa.ListArray.from_arrays(bounds, pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(bounds, pa.array(counts)),
                    ],
                    names=["part", "block", "first", "hashes", "counts"],
                )

    return run


def _part_bits(total: int) -> int:
    """Of a hash, the bits that name its part."""
    return max(LEAST_PART_BITS, (total // PART_WORDS).bit_length())


# From here on a count goes beside the short ones, as a long.
LARGE = (1 << 15) - 1


def found_elsewhere(encoded: DataFrame, order: int, total: int) -> DataFrame:
    """Per block: numbers of its n-grams in the order of their hashes, and how often the other blocks have each;
    only n-grams that some other block has.

    Numbers are ``high * 65,536 + low + 32,768``, in two arrays of short integers: numbers from one part nearly always
    share ``high``, which then is squeezed to nothing on its way. ``others`` are short too; where one is ``LARGE``,
    the next of ``large`` stands for it.
    """
    exploded = (
        encoded.select("block", "bounds", "numbers", "words")
        .mapInArrow(_pieces(order, _part_bits(total)), PIECES)
        .repartition("part")
        .select("part", "block", "first", F.posexplode(F.arrays_zip("hashes", "counts")).alias("at", "gram"))
        .select("part", "block", (F.col("first") + F.col("at")).alias("at"), "gram.hashes", "gram.counts")
    )
    # The hash comes first, so that rows are sorted by whole numbers; the part is what they are dealt by.
    everywhere = F.sum("counts").over(Window.partitionBy("hashes", "part"))
    others, at = F.col("others"), F.col("at")
    return (
        exploded.withColumn("others", everywhere - F.col("counts"))
        .filter("others > 0")
        .select(
            "block",
            F.shiftright(at, 16).cast("smallint").alias("high"),
            (at.bitwiseAND(0xFFFF) - (1 << 15)).cast("smallint").alias("low"),
            F.least(others, F.lit(LARGE)).cast("smallint").alias("others"),
            F.when(others >= LARGE, others).alias("large"),
        )
        .groupBy("block")
        # Nulls are left out of a list; all four meet the rows in the same order.
        .agg(*(F.collect_list(c).alias(c) for c in ("high", "low", "others", "large")))
    )


def _answers(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``found_elsewhere`` says of a block: numbers and counts."""
    high, low, others, large = (_column(batch, name, row).astype(np.int64) for name in ("high", "low", "others", "large"))
    others[others == LARGE] = large
    return (high << 16) + low + (1 << 15), others


SCORES = "doc_id bigint, n_words bigint, log_score double"


def _log_score(ending: list[np.ndarray], counts: np.ndarray, total: int, how: Backoff) -> float:
    """Of one text: numbers of the n-grams ending at its words, and how often the corpus has each."""
    rest = max(1, total - len(ending[0]))
    score = history = None
    for k, grams in enumerate(ending):
        grams = grams[k:]
        if not len(grams):
            break
        own, which, own_counts = np.unique(grams, return_inverse=True, return_counts=True)
        others = (counts[own] - own_counts)[which]
        if k == 0:
            score = np.where(others > 0, others, how.unseen) / rest
        else:
            # Where an n-gram is seen elsewhere, so is what it begins with.
            seen = others / np.maximum(history[:-1], 1)
            score[k:] = np.where(others > 0, seen, how.discount * score[k:])
        history = others
    return float(np.log(score).sum())


def _scored(how: Backoff, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in enumerate(batch.column("ids")):
                bounds, grams = _block_ngrams(batch, row, how.order)
                counts = grams.counts.astype(np.int64)
                at, others = _answers(batch, row)
                if len(at):
                    counts[grams.by_hash()[at]] += others
                del at, others, grams.hashes, grams.counts
                scores = [
                    _log_score([e[a:b] for e in grams.ending], counts, total, how) if b > a else None
                    for a, b in zip(bounds[:-1], bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.as_py(), pa.int64()),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(scores, pa.float64()),
                    ],
                    names=["doc_id", "n_words", "log_score"],
                )

    return run


def backoff_scores(docs: DataFrame, how: Backoff | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_score, mean_log_score.

    Words are between white space, A-Z lower-cased. log_score sums the logarithms over the words. A word
    after its history of ``order - 1`` words (fewer where the text begins) scores by how often the other documents
    have both per history; never found together, ``discount`` times the score after a history shorter by one word;
    without history its share of the other documents' words. Null and empty texts have no words and null scores;
    a null doc_id stays null; repeated rows are documents of their own, each scored by the others; no documents
    give no rows; further columns are not looked at. N-grams are told apart by 64-bit hashes.
    """
    how = how or Backoff()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    # Written, because a block is a fact about one run; a row group each, because they are read as arrays.
    encoded = materialize_in_buckets(texts.mapInArrow(_encode(how.block_words), BLOCKS), "blocks", "block", 1)
    total = encoded.agg(F.sum(F.element_at("bounds", -1).cast("bigint"))).first()[0] or 0
    elsewhere = found_elsewhere(encoded, how.order, total)
    return (
        encoded.join(elsewhere.hint("shuffle_hash"), "block", "left")
        .mapInArrow(_scored(how, total), SCORES)
        .withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
    )
