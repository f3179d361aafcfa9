import pytest
from pyspark.sql import functions as F

from tarnsearch.operators.prompting import (
    assemble_answers,
    build_prompt,
    generate,
    pack_context,
    sources_report,
)
from tarnsearch.operators.rerank import distinct_terms, overlap_score, rerank_topk, score_pairs

RANKED = "query_id long, chunk_id long, rank int, source string, text string, score double"


@pytest.fixture
def ranked(frame):
    return frame(
        [
            (0, 1, 1, "s", "a" * 10, 0.9),
            (0, 2, 2, "s", "\u00a0" + "b" * 20 + "\n", 0.8),
            (0, 3, 3, "s", "c" * 5, 0.7),
        ],
        RANKED,
    )


@pytest.fixture
def questions(frame):
    return frame([(0, "what?"), (1, "nothing found")], "query_id long, query string")


@pytest.mark.parametrize("limit, kept", [(86, [1, 2]), (85, [1]), (37, []), (119, [1, 2, 3]), (118, [1, 2])])
def test_packing_stops_at_the_first_that_does_not_fit(ranked, limit, kept):
    assert [r.chunk_id for r in pack_context(ranked, limit).orderBy("rank").collect()] == kept


def test_blank_lines_between_pieces_do_not_count(ranked, questions):
    messages = build_prompt(questions, ranked, "sys", 86).filter("query_id = 0").first().messages
    context = messages[1].content.removeprefix("CONTEXT:\n").removesuffix("\n\nQUESTION:\nwhat?\n\n")
    assert len(context) == 88
    assert context.startswith("### Source: s | chunk_id: 1\naaaaaaaaaa\n\n### Source: s | chunk_id: 2\nb")
    assert messages[0].asDict() == {"role": "system", "content": "sys"}


def test_question_without_context_keeps_its_prompt(ranked, questions):
    row = build_prompt(questions, ranked, "sys").filter("query_id = 1").first()
    assert row.messages[1].content == "CONTEXT:\n\n\nQUESTION:\nnothing found\n\n"


@pytest.mark.parametrize("source", [None, ""])
def test_missing_source(frame, source):
    row = pack_context(frame([(0, 1, 1, source, "x", 0.1)], RANKED)).first()
    assert row.piece == "### Source: unknown_source | chunk_id: 1\nx"


def test_generate_and_assemble(ranked, questions):
    def load():
        return lambda batch: [" " + m[1]["content"].split("QUESTION:")[1] for m in batch]

    answers = generate(build_prompt(questions, ranked, "sys"), load, batch_size=1)
    rows = assemble_answers(questions, ranked, answers, {"top_p": 0.9}, "model").orderBy("query_id").collect()
    assert [r.answer for r in rows] == ["what?", "nothing found"]
    assert [c.chunk_id for c in rows[0].contexts] == [1, 2, 3] and rows[1].contexts == []
    assert rows[0].gen_config == {"top_p": "0.9"} and rows[0].model_id == "model"


def test_sources(frame, questions):
    ranked = frame([(0, 4, 2, None, "x", 0.1), (0, 9, 1, "b", "y", 0.5)], RANKED)
    rows = sources_report(assemble_answers(questions, ranked)).orderBy("rank").collect()
    assert [(r.source, r.chunk_id, r.score) for r in rows] == [("b", 9, 0.5), ("unknown", 4, 0.1)]


PAIRS = "query_id long, chunk_id long, query string, text string"


def test_overlap(frame):
    df = frame([(0, 1, "The cat THE dog", "a dog, the end"), (0, 2, "??", "x")], PAIRS)
    got = df.select(overlap_score(distinct_terms(F.col("query")), F.col("text")).alias("s")).collect()
    assert [r.s for r in got] == [pytest.approx(2 / 3), 0.0]


def test_model_job_and_cut(frame):
    df = frame([(0, i, "q", "x" * (i % 4)) for i in range(8)], PAIRS)

    def load():
        def score(pairs):
            assert len(pairs) <= 3
            return [len(text) for _, text in pairs]

        return score

    rows = rerank_topk(score_pairs(df, load, batch_size=3), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(3, 3.0), (7, 3.0), (2, 2.0)]
