"""Okapi BM25 over a table of chunks, for a table of questions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.text import tokenize, words
from tarnsearch.functions.topk import BLOCK_CELLS, RunningTopK, round_half_up
from tarnsearch.functions.vectors import rounded
from tarnsearch.operators.merge import merge_best
from tarnsearch.params import (
    BM25_B,
    BM25_EPSILON,
    BM25_K1,
    BROADCAST_ROWS,
    K_BM25,
    SCORE_DIGITS,
    positive,
)
from tarnsearch.plans.work import fits, materialize

# Shares a frequent term's postings are spread over when the question terms are
# too many to broadcast.
TERM_SALTS = 32
# Postings that a task counting terms holds before it hands them on.
PART_POSTINGS = 1 << 16


def chunk_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Number of tokens per chunk; chunks without any have 0."""
    return chunks.select(
        F.col(id_col).alias("chunk_id"),
        F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("bigint").alias("chunk_len"),
    )


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, length, term, tf)`` of ``(id, text)``, handed on after about ``PART_POSTINGS`` of them."""

    def part(ids: pa.Array, lengths: list[int], sizes: list[int], terms: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                pa.array(np.repeat(np.array(lengths, np.int64), sizes)),
                pa.array(terms, pa.string()),
                pa.array(counts, pa.int64()),
            ],
            names=["id", "length", "term", "tf"],
        )

    for batch in batches:
        start, lengths, sizes, terms, counts = 0, [], [], [], []
        for row, text in enumerate(batch.column(1), 1):
            found = tokenize(text.as_py() or "")
            counted = Counter(found)
            lengths.append(len(found))
            sizes.append(len(counted))
            terms += counted.keys()
            counts += counted.values()
            if len(terms) >= PART_POSTINGS or row == batch.num_rows:
                yield part(batch.column(0)[start:row], lengths, sizes, terms, counts)
                start, lengths, sizes, terms, counts = row, [], [], [], []


def count_terms(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, length, term, tf)`` of a table of texts.

    A text is normalised, cut and counted in one pass where it is read. Counting
    with ``groupBy`` would send several times the volume of the text through a
    shuffle only to bring together words that already are.
    """
    schema = T.StructType(
        [
            T.StructField("id", texts.schema[id_col].dataType),
            T.StructField("length", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("tf", T.LongType()),
        ]
    )
    return texts.select(id_col, text_col).mapInArrow(_term_rows, schema)


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Occurrences per (chunk, term), with the chunk's length beside them."""
    counted = count_terms(chunks, id_col, text_col)
    return counted.withColumnsRenamed({"id": "chunk_id", "length": "chunk_len"})


def term_stats(postings: DataFrame) -> DataFrame:
    """Chunks holding a term (``df``) and its occurrences in all of them (``cf``)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _raw_idf(n_chunks: int) -> Column:
    return F.ln(F.lit(n_chunks) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def corpus_totals(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """One row about the corpus.

    ``n_chunks`` counts chunks without tokens too, ``mean_idf`` is taken over the
    vocabulary before negative values are replaced.
    """
    n_chunks = chunks.count()
    n_tokens = F.coalesce(F.sum("cf"), F.lit(0))
    return terms.agg(
        F.lit(n_chunks).cast("bigint").alias("n_chunks"),
        n_tokens.alias("n_tokens"),
        F.try_divide(n_tokens, F.lit(n_chunks)).alias("avg_len"),
        F.avg(_raw_idf(n_chunks)).alias("mean_idf"),
    )


def idf(terms: DataFrame, totals: Row, epsilon: float = BM25_EPSILON) -> DataFrame:
    """Inverse document frequency; a negative one gives way to a share of the mean."""
    raw = _raw_idf(totals["n_chunks"])
    value = F.when(raw < 0, F.lit(totals["mean_idf"]) * epsilon).otherwise(raw)
    return terms.select("term", "df", value.alias("idf"))


def query_terms(
    questions: DataFrame, id_col: str = "query_id", text_col: str = "query"
) -> DataFrame:
    """Terms of each question with how often it uses them (``qf``)."""
    return count_terms(questions, id_col, text_col).select(
        F.col("id").alias("query_id"), "term", F.col("tf").alias("qf")
    )


def term_weights(asked: DataFrame, idf: DataFrame) -> DataFrame:
    """Weight of a term in a question: its idf, once per use."""
    return asked.join(idf, "term").select(
        "query_id", "term", (F.col("qf") * F.col("idf")).alias("weight")
    )


def _impact(totals: Row, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What a posting contributes per unit of weight."""
    length = F.col("chunk_len") / F.lit(totals["avg_len"])
    return F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length))


def score(
    postings: DataFrame,
    asked: DataFrame,
    terms: DataFrame,
    totals: Row,
    k1: float = BM25_K1,
    b: float = BM25_B,
    epsilon: float = BM25_EPSILON,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Score of every (question, chunk) pair sharing a term.

    ``totals`` is the row of ``corpus_totals``: statistics enter the plan as numbers.
    With few enough question terms they are broadcast: postings of other terms are
    dropped where they are read, the rest is shuffled by chunk before questions
    multiply it, and sums stay within their task. With more, both sides are shuffled
    by term, each term's postings spread over several salts.
    """
    values = idf(terms, totals, epsilon)
    impact = _impact(totals, k1, b)
    if fits(asked, broadcast_rows):
        asked = F.broadcast(asked)
        used = F.broadcast(asked.select("term").distinct())
        matched = (
            postings.join(used, "term", "left_semi")
            .select("chunk_id", "term", impact.alias("impact"))
            .repartition("chunk_id")
            .join(F.broadcast(term_weights(asked, values)), "term")
        )
    else:
        weights = term_weights(asked, values).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
        )
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_SALTS)).cast("int")
        matched = postings.select(
            "chunk_id", "term", impact.alias("impact"), salt.alias("salt")
        ).join(weights, ["term", "salt"])
    return matched.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("impact")).alias("score")
    )


def topk(scores: DataFrame, k: int = K_BM25, digits: int = SCORE_DIGITS) -> DataFrame:
    """Best ``k`` chunks per question among those scoring above zero."""
    positive("k_bm25", k)
    hits = scores.filter("score > 0").withColumn("score", rounded(F.col("score"), digits))
    return _cut(hits, k)


def _cut(hits: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


class _QuestionWeights:
    """Weights by term: which questions use it and how much each use counts."""

    def __init__(self, table: pa.Table):
        terms = table.column("term").combine_chunks().dictionary_encode()
        self.terms = terms.dictionary
        term_no = terms.indices.to_numpy()
        order = np.argsort(term_no, kind="stable")
        self.query_ids, question = np.unique(
            table.column("query_id").to_numpy(), return_inverse=True
        )
        self.question = question[order]
        self.weight = table.column("weight").to_numpy()[order]
        self.start = np.searchsorted(term_no[order], np.arange(len(self.terms) + 1))

    def scores(self, chunk_ids: np.ndarray, term_no: np.ndarray, impact: np.ndarray):
        """(ids, rows x questions) of whole chunks, given all their postings."""
        ids, row = np.unique(chunk_ids, return_inverse=True)
        scores = np.zeros((len(ids), len(self.query_ids)))
        order = np.argsort(term_no, kind="stable")
        term_no, row, impact = term_no[order], row[order], impact[order]
        bounds = np.flatnonzero(np.diff(term_no, prepend=-1))
        for first, last in zip(bounds, [*bounds[1:], len(term_no)]):
            uses = slice(self.start[term_no[first]], self.start[term_no[first] + 1])
            # A term has one posting per chunk, so no cell is named twice.
            cells = np.ix_(row[first:last], self.question[uses])
            scores[cells] += np.outer(impact[first:last], self.weight[uses])
        return ids, scores


def _whole_chunks(
    batches: Iterator[pa.RecordBatch], max_chunks: int, max_postings: int = 4_000_000
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Regroup postings sorted by chunk so that no chunk is split, about so many at a time."""
    held: list[pa.RecordBatch] = []
    n_held = n_rows = 0

    def columns(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        return tuple(table.column(c).to_numpy() for c in ("chunk_id", "term_no", "impact"))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(0).to_numpy()
        held.append(batch)
        n_held += 1 + np.count_nonzero(np.diff(ids))
        n_rows += batch.num_rows
        if n_held < max_chunks and n_rows < max_postings:
            continue
        # The last chunk may go on in the next batch.
        last = int(np.searchsorted(ids, ids[-1]))
        if last == 0:
            continue
        yield columns([*held[:-1], batch.slice(0, last)])
        held, n_held, n_rows = [batch.slice(last)], 1, batch.num_rows - last
    if held:
        yield columns(held)


def best_chunks(
    postings: DataFrame,
    asked: DataFrame,
    terms: DataFrame,
    totals: Row,
    k: int = K_BM25,
    digits: int = SCORE_DIGITS,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``topk(score(..))`` without a row per (question, chunk) pair.

    Frequent words make nearly every pair score. Here the postings of asked terms are
    brought together by chunk, and each task adds up a block of chunks against all
    questions in place and emits its own best ``k`` per question. The question side is
    shipped to the tasks in slices of at most about ``max_rows`` (question, term) rows, each with
    its own pass over the postings.
    """
    positive("k_bm25", k)
    whole = asked.limit(max_rows + 1).toArrow()
    slices = 1 if whole.num_rows <= max_rows else -(-asked.count() // max_rows)
    found = None
    for i in range(slices):
        part = whole if slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).toArrow()
        hits = _slice_hits(postings, part, idf(terms, totals), totals, k, digits)
        found = hits if found is None else found.union(hits)
    return merge_best(found, k)


def _slice_hits(postings: DataFrame, uses: pa.Table, values: DataFrame, totals: Row, k: int, digits: int) -> DataFrame:
    """Every task's best ``k`` for one slice of questions."""
    spark = postings.sparkSession
    known = F.broadcast(spark.createDataFrame(uses))
    lookup = _QuestionWeights(term_weights(known, values).toArrow())
    numbered = pa.table(
        {"term": lookup.terms, "term_no": pa.array(np.arange(len(lookup.terms)), pa.int32())}
    )
    shipped = spark.sparkContext.broadcast(lookup)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shipped.value
        best = RunningTopK(len(lookup.query_ids), k)
        max_chunks = max(1, BLOCK_CELLS // max(1, len(lookup.query_ids)))
        for block in _whole_chunks(batches, max_chunks):
            ids, scores = lookup.scores(*block)
            best.offer(ids, np.where(scores > 0, round_half_up(scores, digits), -np.inf))
        question, row_id, score = best.finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array(lookup.query_ids[question]), pa.array(row_id), pa.array(score)],
            names=["query_id", "chunk_id", "score"],
        )

    return (
        postings.join(F.broadcast(spark.createDataFrame(numbered)), "term")
        .select("chunk_id", "term_no", _impact(totals).alias("impact"))
        .repartition("chunk_id")
        .sortWithinPartitions("chunk_id")
        .mapInArrow(job, "query_id BIGINT, chunk_id BIGINT, score DOUBLE")
    )


def search(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = K_BM25,
    id_col: str = "chunk_id",
    text_col: str = "text",
) -> DataFrame:
    """BM25 top-k straight from texts: blocks are written once, then their terms are counted and they are searched."""
    from tarnsearch.operators import blockmax

    blocks = blockmax.stored_blocks(chunks, id_col, text_col)
    terms = materialize(blockmax.block_terms(blocks), "terms")
    return blockmax.best_chunks(blocks, query_terms(questions), terms, blockmax.block_totals(blocks, terms), k)
