"""Reranking, packing, prompts, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EMBEDDER, as_chunks, query, questions
from checks.retrieval import HYBRID, hybrid
from checks.sql import PIECES, RERANKED
from tarnsearch.operators.prompting import (
    assemble_answers,
    build_prompt,
    generate,
    pack_context,
    sources_report,
)
from tarnsearch.operators.rerank import score_pairs
from tarnsearch.plans.answer import ask
from tarnsearch.plans.hybrid import index_in_place, rerank

_RANKED = HYBRID.rstrip() + "," + RERANKED.strip() + "\n"
_PACKED = HYBRID.rstrip() + "," + RERANKED.strip() + "," + PIECES.strip() + "\n"
SYSTEM = "Answer from the context."


def _reranked(spark, folder):
    return rerank(hybrid(spark, folder), questions(spark, folder))


@query(
    "rerank_topk",
    _RANKED + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, source, text FROM reranked",
)
def rerank_topk(spark, folder):
    return _reranked(spark, folder).select("query_id", "chunk_id", "score", "rank", "source", "text")


@query(
    "score_pairs",
    HYBRID
    + """SELECT c.query_id, chunk_id, CAST(length(query) + length(text) AS DOUBLE) AS score
    FROM candidates c JOIN questions q ON q.query_id = c.query_id""",
)
def pair_scores(spark, folder):
    """The model job with a function that measures its pairs."""

    def load():
        return lambda pairs: [len(asked) + len(text) for asked, text in pairs]

    pairs = hybrid(spark, folder).join(questions(spark, folder), "query_id")
    return score_pairs(pairs, load).select("query_id", "chunk_id", "score")


@query(
    "pack_context",
    _PACKED
    + "SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, used_chars, piece FROM packed",
)
def pack(spark, folder):
    return pack_context(_reranked(spark, folder)).select(
        "query_id", "chunk_id", "rank", "used_chars", "piece"
    )


_PROMPTS = (
    _PACKED.rstrip()
    + """,
    contexts AS (
      SELECT query_id, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context FROM packed GROUP BY query_id),
    prompts AS (
      SELECT query_id, 'CONTEXT:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION:' || chr(10)
        || query || chr(10) || chr(10) AS user_message
      FROM questions LEFT JOIN contexts USING (query_id))
    """
)


@query("build_prompt", _PROMPTS + f"SELECT query_id, '{SYSTEM}' AS system_message, user_message FROM prompts")
def prompts(spark, folder):
    built = build_prompt(questions(spark, folder), _reranked(spark, folder), SYSTEM)
    return built.select(
        "query_id",
        F.col("messages")[0]["content"].alias("system_message"),
        F.col("messages")[1]["content"].alias("user_message"),
    )


@query(
    "generate_hook",
    _PROMPTS + "SELECT query_id, trim(user_message, chr(10) || ' ') AS answer FROM prompts",
)
def generate_hook(spark, folder):
    """The model job with a function that gives back the user's message."""

    def load():
        return lambda conversations: [messages[-1]["content"] for messages in conversations]

    built = build_prompt(questions(spark, folder), _reranked(spark, folder), SYSTEM)
    return generate(built, load).select("query_id", "answer")


@query(
    "answer_assembly",
    _RANKED.rstrip()
    + """,
    contexts AS (
      SELECT query_id, count(*) AS n_contexts,
             string_agg(source || ' | ' || chunk_id || ' | ' || length(text), chr(10) ORDER BY rank) AS contexts
      FROM reranked GROUP BY query_id)
    SELECT query_id, query, CAST(NULL AS VARCHAR) AS answer, CAST(coalesce(n_contexts, 0) AS INTEGER) AS n_contexts,
    coalesce(contexts, '') AS contexts, '0.1' AS temperature, 'none' AS model_id
    FROM questions LEFT JOIN contexts USING (query_id)""",
)
def answer_assembly(spark, folder):
    answered = assemble_answers(
        questions(spark, folder),
        _reranked(spark, folder),
        gen_config={"temperature": "0.1"},
        model_id="none",
    )
    line = lambda c: F.concat_ws(" | ", c["source"], c["chunk_id"].cast("string"), F.length(c["text"]).cast("string"))
    return answered.select(
        "query_id",
        "query",
        "answer",
        F.size("contexts").alias("n_contexts"),
        F.array_join(F.transform("contexts", line), "\n").alias("contexts"),
        F.col("gen_config")["temperature"].alias("temperature"),
        "model_id",
    )


@query(
    "batch_ask",
    _PROMPTS
    + """SELECT query_id, query, CAST(length(user_message) AS VARCHAR) AS answer,
    CAST((SELECT count(*) FROM reranked r WHERE r.query_id = prompts.query_id) AS INTEGER) AS n_contexts
    FROM prompts JOIN questions USING (query_id)""",
)
def batch_ask(spark, folder):
    """The whole flow, with a model that measures its prompt."""

    def load():
        return lambda conversations: [str(len(messages[-1]["content"])) for messages in conversations]

    corpus = index_in_place(as_chunks(spark, folder), EMBEDDER)
    answered = ask(corpus, questions(spark, folder), load, SYSTEM)
    return answered.select("query_id", "query", "answer", F.size("contexts").alias("n_contexts"))


@query(
    "sources_report",
    _RANKED + "SELECT query_id, CAST(rank AS INTEGER) AS rank, source, chunk_id, score FROM reranked",
)
def report(spark, folder):
    return sources_report(assemble_answers(questions(spark, folder), _reranked(spark, folder)))
