import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tarnsearch.operators import blockmax, bm25

CHUNK = "chunk_id long, text string"
ASKED = "query_id long, query string"


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    chunks = [(i * 5 % 997, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 200])))) for i in range(n)]
    return chunks + [(2000, None), (2001, "Ünï ünï w0")]


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("size, max_rows", [(1, 1000), (16, 3), (256, 1000)])
def test_equals_the_search_by_rows(frame, size, max_rows):
    chunks = frame(corpus(1, 300), CHUNK).repartition(3)
    questions = frame([(i * 7, f"w{i} w{i * 3 % 50} w0 w0 zzz") for i in range(12)] + [(500, ""), (501, "ünï")], ASKED)
    asked = bm25.query_terms(questions)
    counted = bm25.postings(chunks)
    terms = bm25.term_stats(counted)
    totals = bm25.corpus_totals(chunks, terms).first()
    blocks = blockmax.block_postings(chunks, size=size)
    assert sorted(blockmax.block_terms(blocks).collect()) == sorted(terms.collect())
    mine = blockmax.block_totals(blocks, terms)
    assert (mine.n_chunks, mine.n_tokens) == (totals.n_chunks, totals.n_tokens)
    assert mine.mean_idf == pytest.approx(totals.mean_idf)
    expected = rows(bm25.topk(bm25.score(counted, asked, terms, totals), 5))
    assert rows(blockmax.best_chunks(blocks, asked, terms, totals, 5, max_rows=max_rows)) == expected
    assert rows(bm25.best_chunks(counted, asked, terms, totals, 5, max_rows=max_rows)) == expected


def test_memory_of_a_reader_is_bounded(frame):
    """A block ends at so many postings, and a row group holds so many blocks: a reader has its arrays at once."""
    chunks = frame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(9000)], CHUNK).coalesce(1)
    (written,) = blockmax.stored_blocks(chunks).inputFiles()
    groups = pq.ParquetFile(written.removeprefix("file://")).metadata
    assert groups.num_rows == 36 and max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 8
    chunks = chunks.where("chunk_id < 600")
    small = blockmax.block_postings(chunks, max_postings=200).collect()
    assert {len(b.places) for b in small} == {200} and {len(b.chunk_ids) for b in small} == {10}
    questions = frame([(i, f"w{i}x1 w{i + 1}x2") for i in range(10)], ASKED)
    counted = bm25.postings(chunks)
    terms = bm25.term_stats(counted)
    totals = bm25.corpus_totals(chunks, terms).first()
    expected = rows(bm25.topk(bm25.score(counted, bm25.query_terms(questions), terms, totals), 5))
    assert rows(bm25.search(chunks, questions, 5)) == expected


def test_a_reader_holds_one_block(frame):
    chunks = frame([(i, f"w{i} w{i} both") for i in range(1000)], CHUNK).coalesce(1)
    (written,) = blockmax.stored_blocks(chunks).inputFiles()
    groups = pq.ParquetFile(written.removeprefix("file://")).metadata
    assert [groups.row_group(i).num_rows for i in range(groups.num_row_groups)] == [1, 1, 1, 1]


def test_terms_are_counted_without_their_lists(frame):
    chunks = frame([(i, "a a b" if i % 2 else None) for i in range(600)] + [(700, "c c c")], CHUNK).coalesce(1)
    terms = blockmax.block_terms(blockmax.stored_blocks(chunks))
    assert sorted(tuple(r) for r in terms.collect()) == [("a", 300, 600), ("b", 300, 300), ("c", 1, 3)]
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "cfs" in plan and "tfs" not in plan and "places" not in plan


def test_lists_that_cannot_matter_are_not_read(frame):
    """Few long chunks hold the rare word often; blocks without it are skipped once k hits are held."""
    chunks = [(i, "rare rare rare common") for i in range(20)] + [(i, "common " + f"x{i} " * 30) for i in range(20, 2000)]
    frame_ = frame(chunks, CHUNK).coalesce(1)
    blocks = blockmax.block_postings(frame_, size=20).cache()
    terms = blockmax.block_terms(blocks)
    totals = blockmax.block_totals(blocks, terms)
    asked = bm25.query_terms(frame([(0, "rare common"), (1, "common")], ASKED))
    (lookup,) = blockmax.question_weights(asked, terms, totals)
    scorer = blockmax.BlockScorer(lookup, totals.avg_len, 5, 6)
    for r in blocks.orderBy("block").toArrow().to_batches():
        for i in range(r.num_rows):
            scorer.offer({c: r.column(c)[i].values.to_numpy() for c in blockmax._NUMBERS}, r.column("terms")[i].values)
    assert scorer.pairs == 200 and scorer.skipped == 198 and scorer.lists_read == 2 < scorer.lists == 101
    question, chunk, _ = scorer.best.finish()
    assert chunk[question == 0].tolist() == [0, 1, 2, 3, 4]
    blocks.unpersist()


def test_no_postings_are_shuffled(frame):
    chunks = frame(corpus(2, 50), CHUNK)
    plan = bm25.search(chunks, frame([(0, "w0 w1")], ASKED), 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "tfs" in below


def test_bounds_hold():
    rng = np.random.default_rng(0)
    tf, length = rng.integers(1, 50, 500), rng.integers(1, 400, 500)
    for avg in (0.5, 30.0, 500.0):
        assert blockmax.impact(tf, length, avg).max() <= blockmax.impact(np.array([tf.max()]), np.array([length.min()]), avg)[0]


def test_empty(frame):
    none, questions = frame([], CHUNK), frame([(0, "a")], ASKED)
    assert bm25.search(none, questions).count() == 0
    assert bm25.search(frame([(1, None), (2, "")], CHUNK), questions).count() == 0
    assert bm25.search(frame([(1, "a b"), (2, "c"), (3, "d")], CHUNK), questions.limit(0)).count() == 0
