"""BM25 over blocks of chunks: inverted lists with bounds, skipped where they cannot matter.

A block is some hundred neighbouring chunks and one row: its chunk ids and lengths, its terms, and per term
a sorted list of the chunks that hold it, with the term's occurrences, its largest frequency and the least length
among them. From the last two follows the most that the term can add to a score in this block, whatever the
corpus' mean length is by then. A task reads whole blocks, adds up the bounds of the asked terms, and looks
at the lists only for the questions whose running k-th score the block may still reach.

Blocks are made where the texts are read and scored where they are stored: neither postings nor blocks are
shuffled. Only terms (a row per block and term) and the tasks' own best k are.

A block has a bounded number of postings and is a row group of its own, because a reader of arrays holds a row
group at once, in arrays too large to be moved by the collector: memory does not grow with a task's share of
the corpus. Counting terms reads their numbers per block, not the lists.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarnsearch.functions.text import tokenize
from tarnsearch.functions.topk import RunningTopK, round_half_up
from tarnsearch.operators.bm25 import idf, term_weights
from tarnsearch.operators.merge import merge_best
from tarnsearch.params import BM25_B, BM25_K1, BROADCAST_ROWS, K_BM25, SCORE_DIGITS, positive
from tarnsearch.plans.work import materialize

BLOCK_CHUNKS = 256
BLOCK_POSTINGS = 1 << 17
GROUP_BLOCKS = 1
QUESTIONS_AT_A_TIME = 4096

BLOCKS = (
    "block bigint, chunk_ids array<bigint>, chunk_lens array<int>, terms array<string>, starts array<int>, "
    "places array<int>, tfs array<int>, max_tf array<int>, min_len array<int>, cfs array<bigint>"
)


def _block(number: int, chunks: list[tuple[int, Counter]]) -> pa.RecordBatch:
    chunks = sorted(chunks, key=lambda chunk: chunk[0])
    lens, term, place, tf = [], [], [], []
    for i, (_, counted) in enumerate(chunks):
        lens.append(counted.total())
        term += counted.keys()
        tf += counted.values()
        place += [i] * len(counted)
    words = pa.array(term, pa.string()).dictionary_encode()
    # By term; places stay in order.
    by_term = np.argsort(words.indices.to_numpy(), kind="stable")
    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
    starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    places, tfs = np.array(place, np.int32)[by_term], np.array(tf, np.int32)[by_term]
    lens = np.array(lens, np.int32)
    if len(n):
        max_tf, min_len = np.maximum.reduceat(tfs, starts[:-1]), np.minimum.reduceat(lens[places], starts[:-1])
        cfs = np.add.reduceat(tfs, starts[:-1], dtype=np.int64)
    else:
        max_tf = min_len = np.empty(0, np.int32)
        cfs = np.empty(0, np.int64)
    columns = [np.array([i for i, _ in chunks], np.int64), lens, words.dictionary, starts, places, tfs, max_tf, min_len, cfs]
    names = ["chunk_ids", "chunk_lens", "terms", "starts", "places", "tfs", "max_tf", "min_len", "cfs"]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["block", *names])


def block_postings(
    chunks: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    size: int = BLOCK_CHUNKS,
    max_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """Blocks of ``size`` neighbouring chunks (the last of a task smaller), of fewer once they have
    ``max_postings``. A null text has no terms."""
    positive("size", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, Counter]] = []
        for batch in batches:
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted = Counter(tokenize(text.as_py() or ""))
                held.append((chunk_id, counted))
                n += len(counted)
                if len(held) >= size or n >= max_postings:
                    yield _block(number, held)
                    number, n, held = number + 1, 0, []
        if held:
            yield _block(number, held)

    return chunks.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, BLOCKS)


def stored_blocks(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The blocks, written once, a bounded number to a row group."""
    return materialize(block_postings(chunks, id_col, text_col), "blocks", GROUP_BLOCKS)


def block_terms(blocks: DataFrame) -> DataFrame:
    """Chunks holding a term (``df``) and its occurrences (``cf``): first a row per block and term."""
    listed = F.expr("transform(terms, (t, i) -> struct(t AS term, starts[i + 1] - starts[i] AS df, cfs[i] AS cf))")
    rows = blocks.select(F.explode(listed).alias("t")).select("t.*")
    return rows.groupBy("term").agg(F.sum("df").cast("bigint").alias("df"), F.sum("cf").alias("cf"))


def block_totals(blocks: DataFrame, terms: DataFrame) -> Row:
    """What ``bm25.corpus_totals`` says, from blocks."""
    n = blocks.agg(F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0))).first()[0]
    raw = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    n_tokens = F.coalesce(F.sum("cf"), F.lit(0))
    return terms.agg(
        F.lit(n).cast("bigint").alias("n_chunks"),
        n_tokens.alias("n_tokens"),
        F.try_divide(n_tokens, F.lit(n)).alias("avg_len"),
        F.avg(raw).alias("mean_idf"),
    ).first()


class Questions:
    """Weights of asked terms: the uses of term t are at starts[t]:starts[t + 1]."""

    def __init__(self, table: pa.Table):
        terms = table.column("term").combine_chunks().dictionary_encode()
        self.terms = terms.dictionary
        number = terms.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        self.query_ids, question = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        self.question = question[order]
        self.weight = table.column("weight").to_numpy()[order]
        self.starts = np.searchsorted(number[order], np.arange(len(self.terms) + 1))

    def uses(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all uses of some terms, and which of the terms each is of."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        of = np.repeat(np.arange(len(numbers)), n)
        return np.arange(len(of)) + np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n), of


def impact(tf: np.ndarray, length: np.ndarray, avg_len: float, k1: float = BM25_K1, b: float = BM25_B) -> np.ndarray:
    """What a posting adds per unit of weight: more with a higher frequency, less with a greater length."""
    return tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * length / avg_len))


class BlockScorer:
    """Scores blocks one after the other; counts the questions x blocks that it could leave out."""

    def __init__(self, asked: Questions, avg_len: float, k: int, digits: int):
        self.asked, self.avg_len, self.digits = asked, avg_len, digits
        self.best = RunningTopK(len(asked.query_ids), k)
        self.pairs = self.skipped = self.lists = self.lists_read = 0

    def offer(self, row: dict[str, np.ndarray], terms: pa.Array) -> None:
        asked, n_questions = self.asked, len(self.asked.query_ids)
        at = pc.index_in(terms, value_set=asked.terms)
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        if not len(here):
            return
        numbers = at.take(pa.array(here)).to_numpy()
        use, of = asked.uses(numbers)
        most = impact(row["max_tf"][here].astype(float), row["min_len"][here], self.avg_len)
        # A negative weight adds nothing at best.
        bound = np.bincount(asked.question[use], np.maximum(asked.weight[use] * most[of], 0.0), n_questions)
        wanted = (bound > 0) & (bound + 10.0**-self.digits >= self.best.floor)
        reached = np.bincount(asked.question[use], minlength=n_questions) > 0
        self.pairs += int(reached.sum())
        self.skipped += int((reached & ~wanted).sum())
        needed = np.zeros(len(here), bool)
        needed[of[wanted[asked.question[use]]]] = True
        self.lists, self.lists_read = self.lists + len(here), self.lists_read + int(needed.sum())
        who = np.flatnonzero(wanted)
        for a in range(0, len(who), QUESTIONS_AT_A_TIME):
            some = who[a : a + QUESTIONS_AT_A_TIME]
            column = np.full(n_questions, -1)
            column[some] = np.arange(len(some))
            scores = np.zeros((len(row["chunk_ids"]), len(some)))
            for t in np.flatnonzero(needed):
                lo, hi = row["starts"][here[t]], row["starts"][here[t] + 1]
                uses = slice(asked.starts[numbers[t]], asked.starts[numbers[t] + 1])
                mine = column[asked.question[uses]]
                if (mine >= 0).any():
                    places = row["places"][lo:hi]
                    adds = impact(row["tfs"][lo:hi].astype(float), row["chunk_lens"][places], self.avg_len)
                    scores[np.ix_(places, mine[mine >= 0])] += np.outer(adds, asked.weight[uses][mine >= 0])
            self.best.offer(row["chunk_ids"], np.where(scores > 0, round_half_up(scores, self.digits), -np.inf), some)


_NUMBERS = ("chunk_ids", "chunk_lens", "starts", "places", "tfs", "max_tf", "min_len")


def question_weights(asked: DataFrame, terms: DataFrame, totals: Row, max_rows: int = BROADCAST_ROWS) -> Iterator[Questions]:
    """Weights of asked terms, in slices of at most about ``max_rows`` rows: what a task is shipped at once."""
    spark = asked.sparkSession
    values = idf(terms, totals)
    whole = asked.limit(max_rows + 1).toArrow()
    slices = 1 if whole.num_rows <= max_rows else -(-asked.count() // max_rows)
    for i in range(slices):
        part = whole if slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).toArrow()
        known = F.broadcast(spark.createDataFrame(part))
        yield Questions(term_weights(known, values).toArrow())


def best_chunks(
    blocks: DataFrame,
    asked: DataFrame,
    terms: DataFrame,
    totals: Row,
    k: int = K_BM25,
    digits: int = SCORE_DIGITS,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Best ``k`` chunks per question among those scoring above zero: query_id, chunk_id, score, rank.

    Each slice of questions is one pass over the blocks, where they are stored.
    """
    positive("k_bm25", k)
    spark = blocks.sparkSession
    found = spark.createDataFrame([], "query_id bigint, chunk_id bigint, score double")
    for lookup in question_weights(asked, terms, totals, max_rows):
        shipped = spark.sparkContext.broadcast((lookup, float(totals["avg_len"] or 1.0)))

        def job(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            scorer = BlockScorer(*shipped.value, k, digits)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].values.to_numpy() for c in _NUMBERS}
                    scorer.offer(row, batch.column("terms")[i].values)
            question, row_id, score = scorer.best.finish()
            yield pa.RecordBatch.from_arrays(
                [pa.array(scorer.asked.query_ids[question]), pa.array(row_id), pa.array(score)], names=["query_id", "chunk_id", "score"]
            )

        found = found.union(blocks.drop("block", "cfs").mapInArrow(job, "query_id BIGINT, chunk_id BIGINT, score DOUBLE"))
    return merge_best(found, k)
