"""Answer a whole table of questions in one flow."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from tarnsearch.operators.prompting import Generate, assemble_answers, build_prompt, generate
from tarnsearch.operators.rerank import ScorePairs, rerank_topk, score_pairs
from tarnsearch.params import (
    K_BM25,
    K_DENSE,
    K_FINAL,
    MAX_CONTEXT_CHARS,
    PAIR_BATCH,
    TOPN,
)
from tarnsearch.plans.hybrid import Corpus, rerank, retrieve
from tarnsearch.plans.work import materialize


def ask(
    corpus: Corpus,
    questions: DataFrame,
    load_model: Callable[[], Generate],
    system_prompt: str,
    load_scorer: Callable[[], ScorePairs] | None = None,
    k_bm25: int = K_BM25,
    k_dense: int = K_DENSE,
    topn: int = TOPN,
    k_final: int = K_FINAL,
    max_chars: int = MAX_CONTEXT_CHARS,
    pair_batch: int = PAIR_BATCH,
    gen_config: Mapping[str, str] | None = None,
    model_id: str | None = None,
) -> DataFrame:
    """Retrieve, rerank, pack, generate: one row per question ``(query_id, query)``.

    Without ``load_scorer`` pairs are scored by the stand-in. At most ``k_final`` chunks per
    question are written in between, since prompts and answers both need them.
    """
    candidates = retrieve(corpus, questions, k_bm25, k_dense, topn)
    if load_scorer is None:
        ranked = rerank(candidates, questions, k_final)
    else:
        pairs = candidates.join(questions.select("query_id", "query"), "query_id")
        ranked = rerank_topk(score_pairs(pairs, load_scorer, pair_batch), k_final)
    ranked = materialize(ranked, "ranked")
    prompts = build_prompt(questions, ranked, system_prompt, max_chars)
    answers = generate(prompts, load_model)
    return assemble_answers(questions, ranked, answers, gen_config, model_id)
