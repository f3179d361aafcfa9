"""Retrieve chunks for a table of questions by words and by vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarnsearch.operators import blockmax, bm25, dense, fusion
from tarnsearch.operators.embedding import Embedder, embed
from tarnsearch.operators.rerank import distinct_terms, overlap_score, rerank_topk
from tarnsearch.params import K_BM25, K_DENSE, K_FINAL, K_RRF, TOPN
from tarnsearch.plans.work import materialize


@dataclass(frozen=True)
class Corpus:
    """The tables retrieval reads. ``chunks`` has chunk_id, source_path and text. Words are looked up in
    ``blocks`` where there are any, else in ``postings``; ``totals`` saves counting the corpus again."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame | None
    terms: DataFrame
    embedder: Embedder
    metric: str = "ip"
    blocks: DataFrame | None = None
    totals: Row | None = None

    def best_by_words(self, questions: DataFrame, k: int) -> DataFrame:
        asked = bm25.query_terms(questions)
        totals = self.totals or bm25.corpus_totals(self.chunks, self.terms).first()
        if self.blocks is not None:
            return blockmax.best_chunks(self.blocks, asked, self.terms, totals, k)
        return bm25.best_chunks(self.postings, asked, self.terms, totals, k)


def index_in_place(chunks: DataFrame, embedder: Embedder, metric: str = "ip") -> Corpus:
    """Tables for one-off retrieval over chunks that no stored index covers."""
    blocks = blockmax.stored_blocks(chunks)
    terms = materialize(blockmax.block_terms(blocks), "terms")
    return Corpus(
        chunks=chunks,
        # Scored once, in the tasks that embed: nothing to store.
        vectors=embed(chunks, embedder),
        postings=None,
        terms=terms,
        embedder=embedder,
        metric=metric,
        blocks=blocks,
        totals=blockmax.block_totals(blocks, terms),
    )


def retrieve(
    corpus: Corpus,
    questions: DataFrame,
    k_bm25: int = K_BM25,
    k_dense: int = K_DENSE,
    topn: int = TOPN,
    k_rrf: int = K_RRF,
) -> DataFrame:
    """Candidates per question ``(query_id, query)``: both searches, fused, with their text."""
    by_words = corpus.best_by_words(questions, k_bm25)
    asked = embed(questions, corpus.embedder, id_col="query_id", text_col="query")
    by_vectors = dense.topk(
        corpus.vectors, asked, k_dense, corpus.metric, dim=corpus.embedder.dim
    )
    fused = fusion.rrf_fuse([by_words, by_vectors], k_rrf, topn)
    return fusion.gather_candidates(fused, corpus.chunks)


def rerank(candidates: DataFrame, questions: DataFrame, k_final: int = K_FINAL) -> DataFrame:
    """Candidates reordered by the stand-in pair score, where they are joined with their question. Each
    task keeps its best ``k_final`` per question before the texts are shuffled to be ranked."""
    asked = questions.select("query_id", "query", distinct_terms(F.col("query")).alias("asked"))
    scored = candidates.join(asked, "query_id").withColumn("score", overlap_score(F.col("asked"), F.col("text")))
    return rerank_topk(scored.drop("asked"), k_final)
