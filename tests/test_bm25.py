import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnsearch.functions.text import tokenize
from tarnsearch.operators import bm25

CHUNKS = [
    (0, "the cat sat on the mat"),
    (1, "the dog"),
    (2, ""),
    (3, "the cat and the dog and the cat"),
    (4, "a bird sang"),
    (5, "the cat sat on the mat"),
    (6, "the end of the day"),
]
QUESTIONS = [(0, "cat cat dog"), (1, "the bird"), (2, "nothing matches zzz"), (3, "")]


def brute_force(chunks, questions):
    """Plain loop over the formulas."""
    tokens = {i: tokenize(t) for i, t in chunks}
    n = len(chunks)
    avg = sum(map(len, tokens.values())) / n
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: eps if v < 0 else v for t, v in raw.items()}
    result = {}
    for q, text in questions:
        for i, ts in tokens.items():
            tf = Counter(ts)
            score = sum(
                idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
                for t in tokenize(text)
                if tf[t]
            )
            if any(tf[t] for t in tokenize(text)):
                result[q, i] = score
    return idf, result


@pytest.fixture
def tables(frame):
    chunks = frame(CHUNKS, "chunk_id long, text string")
    questions = frame(QUESTIONS, "query_id long, query string")
    counted = bm25.postings(chunks)
    terms = bm25.term_stats(counted)
    return chunks, questions, counted, terms, bm25.corpus_totals(chunks, terms).first()


def test_terms_of_a_batch_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(bm25, "PART_POSTINGS", 5)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in CHUNKS] + [7], "text": [t for _, t in CHUNKS] + [None]})
    parts = list(bm25._term_rows(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= 5 + 5
    found = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert found == [(i, len(tokenize(t)), term, n) for i, t in CHUNKS for term, n in Counter(tokenize(t)).items()]


def test_statistics(tables):
    chunks, _, counted, terms, totals = tables
    stats = {r.chunk_id: r.chunk_len for r in bm25.chunk_stats(chunks).collect()}
    assert stats == {i: len(tokenize(t)) for i, t in CHUNKS}
    got = {(r.chunk_id, r.term): (r.tf, r.chunk_len) for r in counted.collect()}
    assert got[3, "cat"] == (2, 8) and got[0, "the"] == (2, 6) and not any(k[0] == 2 for k in got)
    row = totals
    # A chunk without tokens counts.
    assert row.n_chunks == 7 and row.n_tokens == 30 and row.avg_len == pytest.approx(30 / 7)


def test_negative_idf_becomes_a_share_of_the_mean(tables):
    *_, terms, totals = tables
    expected, _ = brute_force(CHUNKS, QUESTIONS)
    got = {r.term: r.idf for r in bm25.idf(terms, totals).collect()}
    assert got == pytest.approx(expected)
    assert math.log(7 - 5 + 0.5) - math.log(5.5) < 0 < got["the"]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_scores(tables, broadcast_rows):
    """Both the broadcast and the salted form."""
    _, questions, counted, terms, totals = tables
    scores = bm25.score(
        counted, bm25.query_terms(questions), terms, totals, broadcast_rows=broadcast_rows
    )
    got = {(r.query_id, r.chunk_id): r.score for r in scores.collect()}
    assert got == pytest.approx(brute_force(CHUNKS, QUESTIONS)[1])


def test_topk_cuts_and_breaks_ties_by_chunk(frame):
    hits = frame(
        [(0, 5, 1.0), (0, 2, 1.0000000001), (0, 9, 3.0), (0, 4, 0.0), (0, 3, -1.0)],
        "query_id long, chunk_id long, score double",
    )
    rows = bm25.topk(hits, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in rows] == [(9, 1), (2, 2)]
    assert [r.chunk_id for r in bm25.topk(hits, 9).orderBy("rank").collect()] == [9, 2, 5]
    with pytest.raises(ValueError):
        bm25.topk(hits, 0)


@pytest.mark.parametrize("max_rows", [1000, 3])
def test_both_ways_to_the_best(tables, max_rows):
    _, questions, counted, terms, totals = tables
    asked = bm25.query_terms(questions)
    by_rows = bm25.topk(bm25.score(counted, asked, terms, totals), 3)
    in_place = bm25.best_chunks(counted, asked, terms, totals, 3, max_rows=max_rows)
    assert sorted(in_place.select(by_rows.columns).collect()) == sorted(by_rows.collect())


def test_chunks_are_never_split():
    ids = np.repeat(np.arange(50), np.arange(50) % 7 + 1)
    source = pa.table({"chunk_id": ids, "term_no": np.arange(len(ids)), "impact": ids * 0.5})
    for rows, max_chunks in [(1, 1), (3, 2), (10, 100), (1000, 5)]:
        blocks = list(bm25._whole_chunks(iter(source.to_batches(rows)), max_chunks))
        assert np.concatenate([b[1] for b in blocks]).tolist() == list(range(len(ids)))
        seen = [set(b[0]) for b in blocks]
        assert sum(map(len, seen)) == len(set().union(*seen)) == 50


def test_search_with_a_hot_term(frame):
    """A third of all postings belong to one term."""
    chunks = [(i, "hot " * 5 + f"w{i} w{i % 7}") for i in range(300)]
    questions = [(i, f"hot w{i}") for i in range(20)]
    got = bm25.search(
        frame(chunks, "chunk_id long, text string"),
        frame(questions, "query_id long, query string"),
        k=5,
    ).collect()
    _, scores = brute_force(chunks, questions)
    for q in range(20):
        best = sorted((-round(s, 6), i) for (qq, i), s in scores.items() if qq == q and s > 0)[:5]
        mine = sorted((-r.score, r.chunk_id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in best]
        assert [v for v, _ in mine] == pytest.approx([v for v, _ in best])


def test_empty_corpus(frame):
    chunks = frame([], "chunk_id long, text string")
    questions = frame(QUESTIONS, "query_id long, query string")
    assert bm25.search(chunks, questions).count() == 0
