"""Tokens, BM25, fusion and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import EMBEDDER, as_chunks, query, questions
from checks.sql import (
    BM25,
    BM25_TOP,
    CANDIDATES,
    CHUNKS,
    DENSE_TOP,
    FUSED,
    IDF,
    POSTINGS,
    QUESTIONS,
    hashed,
    with_,
    words,
)
from tarnsearch.functions.text import tokens
from tarnsearch.functions.vectors import rounded
from tarnsearch.operators import bm25, dense, embedding, fusion, vector_store
from tarnsearch.plans.hybrid import index_in_place, retrieve
from tarnsearch.plans.work import materialize, work_folder

_BM25 = with_(CHUNKS, QUESTIONS, POSTINGS, IDF, BM25, BM25_TOP)
HYBRID_PARTS = (POSTINGS, IDF, BM25, BM25_TOP, DENSE_TOP, FUSED, CANDIDATES)
HYBRID_COLUMNS = """SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(rrf_score, 9) AS rrf_score,
    source, text FROM candidates"""
HYBRID = with_(CHUNKS, QUESTIONS, *HYBRID_PARTS)


@query(
    "tokenize",
    f"""SELECT doc_id, array_to_string(list_transform({words('text')}, lambda t: lower(t)), ' ') AS tokens
    FROM documents""",
)
def tokenize(spark, folder):
    chunks = as_chunks(spark, folder)
    return chunks.select(
        F.col("chunk_id").alias("doc_id"), F.array_join(tokens(F.col("text")), " ").alias("tokens")
    )


@query("bm25_chunk_stats", with_(CHUNKS, POSTINGS) + "SELECT chunk_id, chunk_len FROM chunk_len")
def bm25_chunk_stats(spark, folder):
    return bm25.chunk_stats(as_chunks(spark, folder))


@query(
    "bm25_postings",
    with_(CHUNKS, POSTINGS)
    + "SELECT chunk_id, chunk_len, term, tf FROM postings JOIN chunk_len USING (chunk_id)",
)
def bm25_postings(spark, folder):
    return bm25.postings(as_chunks(spark, folder))


@query(
    "bm25_totals",
    with_(CHUNKS, POSTINGS, IDF)
    + """SELECT n AS n_chunks, n_tokens, round(avg_len, 6) AS avg_len,
    (SELECT round(avg(raw), 6) FROM raw) AS mean_idf FROM totals""",
)
def bm25_totals(spark, folder):
    chunks = as_chunks(spark, folder)
    totals = bm25.corpus_totals(chunks, bm25.term_stats(bm25.postings(chunks)))
    return totals.withColumns({c: rounded(F.col(c)) for c in ("avg_len", "mean_idf")})


def _statistics(chunks: DataFrame):
    counted = materialize(bm25.postings(chunks), "postings")
    terms = materialize(bm25.term_stats(counted), "terms")
    return counted, terms, bm25.corpus_totals(chunks, terms).first()


@query(
    "bm25_idf",
    with_(CHUNKS, POSTINGS, IDF) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
)
def bm25_idf(spark, folder):
    chunks = as_chunks(spark, folder)
    terms = materialize(bm25.term_stats(bm25.postings(chunks)), "terms")
    totals = bm25.corpus_totals(chunks, terms).first()
    return bm25.idf(terms, totals).withColumn("idf", rounded(F.col("idf")))


@query(
    "bm25_score",
    with_(CHUNKS, QUESTIONS, POSTINGS, IDF, BM25)
    + "SELECT query_id, chunk_id, round(raw_score, 6) AS score FROM scored",
)
def bm25_score(spark, folder):
    counted, terms, totals = _statistics(as_chunks(spark, folder))
    asked = bm25.query_terms(questions(spark, folder))
    return bm25.score(counted, asked, terms, totals).withColumn("score", rounded(F.col("score")))


@query(
    "bm25_topk",
    _BM25 + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM by_words",
)
def bm25_topk(spark, folder):
    return bm25.search(as_chunks(spark, folder), questions(spark, folder))


@query(
    "rank_list",
    _BM25.rstrip()
    + """,
    by_length AS (
      SELECT query_id, chunk_id, round(raw_score / (1 + ln(1 + chunk_len)), 6) AS score
      FROM scored JOIN chunk_len USING (chunk_id))
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM by_length""",
)
def rank_list(spark, folder):
    counted, terms, totals = _statistics(as_chunks(spark, folder))
    scores = bm25.score(counted, bm25.query_terms(questions(spark, folder)), terms, totals)
    lengths = counted.select("chunk_id", "chunk_len").distinct()
    damped = F.col("score") / (1 + F.ln(1 + F.col("chunk_len")))
    hits = scores.join(lengths, "chunk_id").select(
        "query_id", "chunk_id", rounded(damped).alias("score")
    )
    return fusion.rank_list(hits)


_HASHED = (
    with_(CHUNKS, POSTINGS, hashed("vec", "(SELECT chunk_id, term, tf AS n FROM postings)", "chunk_id"))
    + "SELECT chunk_id, bucket, round(CAST(weight AS DOUBLE), 6) AS weight FROM vec"
)


@query("hash_embed", _HASHED)
def hash_embed(spark, folder):
    return _weights(embedding.embed(as_chunks(spark, folder), EMBEDDER))


@query("embed_stored", _HASHED)
def embed_stored(spark, folder):
    """Vectors by way of a store: half of the documents first, then all, so that some are found there."""
    chunks, root = as_chunks(spark, folder), work_folder(spark, "vector-store")
    vector_store.add_missing(chunks.where("chunk_id % 2 = 0"), root, EMBEDDER)
    return _weights(vector_store.embed_stored(chunks, root, EMBEDDER))


def _weights(vectors):
    return (
        vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight"))
        .filter("weight <> 0")
        .withColumn("weight", rounded(F.col("weight").cast("double")))
    )


@query(
    "rrf_fuse",
    HYBRID
    + """SELECT query_id, chunk_id, CAST(rank_1 AS INTEGER) AS rank_1, CAST(rank_2 AS INTEGER) AS rank_2,
    round(rrf_score, 9) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM ranked""",
)
def rrf_fuse(spark, folder):
    chunks, asked = as_chunks(spark, folder), questions(spark, folder)
    by_words = bm25.search(chunks, asked)
    query_vectors = embedding.embed(asked, EMBEDDER, "query_id", "query")
    by_vectors = dense.topk(embedding.embed(chunks, EMBEDDER), query_vectors)
    fused = fusion.rrf_fuse([by_words, by_vectors])
    return fused.withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "gather_candidates",
    _BM25
    + """SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(1.0 / (60 + rank), 9) AS rrf_score,
    source_path AS source, text FROM by_words JOIN chunks USING (chunk_id) WHERE rank <= 40""",
)
def gather_candidates(spark, folder):
    chunks, asked = as_chunks(spark, folder), questions(spark, folder)
    fused = fusion.rrf_fuse([bm25.search(chunks, asked)])
    found = fusion.gather_candidates(fused, chunks)
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


def hybrid(spark, folder):
    asked = questions(spark, folder)
    return retrieve(index_in_place(as_chunks(spark, folder), EMBEDDER), asked)


@query("hybrid_retrieve", HYBRID + HYBRID_COLUMNS)
def hybrid_retrieve(spark, folder):
    return hybrid(spark, folder).withColumn("rrf_score", F.round("rrf_score", 9))
