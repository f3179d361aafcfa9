import shutil

import pytest

from checks.freshness import _stream
from tarnsearch.operators import bm25
from tarnsearch.operators.dense import checked_rows
from tarnsearch.operators.embedding import hash_embedder
from tarnsearch.plans.answer import ask
from tarnsearch.plans.hybrid import index_in_place, rerank, retrieve
from tarnsearch.plans.index import build_index, make_settings, open_index, refresh_index
from tarnsearch.plans.work import work_folder
from tarnsearch.streaming.ingest import ingest
from tarnsearch.streaming.retrieve import answer_stream

EMBEDDER = hash_embedder(32)
DOC = "doc_id long, source_path string, text string"
BEFORE = [(i, f"d/{i}", f"alpha w{i} w{i % 5} " * (i % 9)) for i in range(40)]
AFTER = (
    [d for d in BEFORE if d[0] not in (3, 4, 5, 6)]
    + [(5, "d/5", "changed wholly"), (6, "d/6", "")]
    + [(100, "d/100", "brand new alpha text")]
)


@pytest.fixture
def settings():
    return make_settings(EMBEDDER, chunk_size=30, chunk_overlap=5)


def content(index):
    """Everything an index holds, chunk numbers aside."""
    key = {r.chunk_id: (r.doc_id, r.chunk_pos) for r in index.chunks.collect()}
    return {
        "chunks": sorted((r.doc_id, r.chunk_pos, r.source_path, r.text) for r in index.chunks.collect()),
        "vectors": sorted((key[r.chunk_id], r.embedding) for r in index.vectors.collect()),
        "postings": sorted((key[r.chunk_id], r.term, r.tf, r.chunk_len) for r in index.postings.collect()),
        "terms": sorted((r.term, r.df, r.cf) for r in index.terms.collect()),
        "manifest": sorted((r.path, r.size, r.sha256) for r in index.manifest.collect()),
        "stats": sorted((key[r.chunk_id], r.chunk_len) for r in index.chunk_stats.collect()),
    }


def test_refresh_equals_rebuild(spark, frame, settings):
    root = work_folder(spark, "test-index")
    first = build_index(frame(BEFORE, DOC), root, EMBEDDER, settings)
    before = content(first)
    second = refresh_index(first, frame(AFTER, DOC), EMBEDDER)
    rebuilt = build_index(frame(AFTER, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    assert content(second) == content(rebuilt)
    # Ids stay unique, the older version readable, an unchanged corpus adds nothing.
    ids = [r.chunk_id for r in second.chunks.collect()]
    assert len(ids) == len(set(ids))
    assert content(open_index(spark, root, 1)) == before
    third = refresh_index(open_index(spark, root), frame(AFTER, DOC), EMBEDDER)
    assert third.version == 3 and content(third) == content(second)
    # A rebuild under the same root starts from nothing.
    fourth = build_index(frame(BEFORE, DOC), root, EMBEDDER, settings)
    assert content(open_index(spark, root)) == before and fourth.version == 4


def test_refresh_can_leave_missing_documents(spark, frame, settings):
    root = work_folder(spark, "test-index")
    first = build_index(frame(BEFORE, DOC), root, EMBEDDER, settings)
    second = refresh_index(first, frame(AFTER[-3:], DOC), EMBEDDER, remove_missing=False)
    kept = [d for d in BEFORE if d[0] not in (5, 6)] + AFTER[-3:]
    rebuilt = build_index(frame(kept, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    assert content(second) == content(rebuilt)


def test_settings_must_agree(spark, frame, settings):
    index = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    with pytest.raises(ValueError):
        refresh_index(index, frame(AFTER, DOC), EMBEDDER, make_settings(EMBEDDER, 31, 5))
    with pytest.raises(ValueError):
        refresh_index(index, frame(AFTER, DOC), hash_embedder(16))
    with pytest.raises(ValueError):
        index.corpus(hash_embedder(64))


def test_bad_vectors_end_the_build(spark, frame):
    vectors = frame([(1, [0.0, 1.0, 0.0, 0.0]), (2, [0.0])], "chunk_id long, embedding array<float>")
    assert checked_rows(vectors.filter("chunk_id = 1"), 4).count() == 1
    with pytest.raises(Exception, match="vector of chunk 2: wrong dimension"):
        checked_rows(vectors, 4).collect()


def test_nothing_published(spark):
    assert open_index(spark, work_folder(spark, "none")) is None


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.rrf_score) for r in df.collect())


QUESTIONS = [(0, "alpha w3"), (1, "brand new"), (2, "???")]


def test_retrieval_from_stored_and_loose_tables(spark, frame, settings):
    index = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    questions = frame(QUESTIONS, "query_id long, query string")
    stored = retrieve(index.corpus(EMBEDDER), questions, 8, 8, 6)
    loose = retrieve(index_in_place(index.chunks.drop("doc_id"), EMBEDDER), questions, 8, 8, 6)
    assert hits(stored) == hits(loose)
    assert {r.query_id for r in stored.collect()} == {0, 1, 2}
    top = rerank(stored, questions, 2).collect()
    assert max(r.rank for r in top) == 2


def test_no_questions_and_no_documents(spark, frame, settings):
    nothing = frame([], DOC)
    questions = frame(QUESTIONS, "query_id long, query string")
    index = build_index(nothing, work_folder(spark, "test-index"), EMBEDDER, settings)
    assert retrieve(index.corpus(EMBEDDER), questions).count() == 0
    index = refresh_index(index, frame(BEFORE, DOC), EMBEDDER)
    assert retrieve(index.corpus(EMBEDDER), questions.limit(0)).count() == 0
    rebuilt = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    assert content(index) == content(rebuilt)
    assert content(refresh_index(index, nothing, EMBEDDER)) == {
        name: [] for name in ("chunks", "vectors", "postings", "terms", "manifest", "stats")
    }


def test_ask_with_models(spark, frame, settings):
    index = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    questions = frame(QUESTIONS, "query_id long, query string")

    def load_model():
        return lambda batch: [m[1]["content"].split("QUESTION:\n")[1].upper() for m in batch]

    def load_scorer():
        return lambda pairs: [-len(text) for _, text in pairs]

    rows = ask(
        index.corpus(EMBEDDER), questions, load_model, "sys", load_scorer, k_final=3, model_id="m"
    ).collect()
    assert {(r.query_id, r.answer) for r in rows} == {(q, text.upper()) for q, text in QUESTIONS}
    for row in rows:
        assert [c.rank for c in row.contexts] == [1, 2, 3]
        scores = [c.score for c in row.contexts]
        assert scores == sorted(scores, reverse=True) == [-len(c.text) for c in row.contexts]


def test_streams_equal_batch(spark, frame, settings):
    root, source = work_folder(spark, "test-index"), work_folder(spark, "incoming")
    checkpoint = work_folder(spark, "checkpoint")

    def run():
        arriving = spark.readStream.schema(DOC).parquet(source)
        query = ingest(arriving, root, EMBEDDER, checkpoint, "docs", settings)
        query.awaitTermination()
        assert query.exception() is None

    frame(BEFORE, DOC).coalesce(1).write.parquet(source)
    run()
    frame(AFTER[-3:], DOC).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    kept = [d for d in BEFORE if d[0] not in (5, 6)] + AFTER[-3:]
    batch = build_index(frame(kept, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    streamed = open_index(spark, root)
    assert streamed.version == 2 and content(streamed) == content(batch)

    asked = work_folder(spark, "asked")
    questions = frame(QUESTIONS, "query_id long, query string")
    questions.write.parquet(asked)
    output = work_folder(spark, "answered")
    stream = spark.readStream.schema(questions.schema).parquet(asked)
    answer_stream(stream, root, EMBEDDER, output, work_folder(spark, "checkpoint")).awaitTermination()
    assert hits(spark.read.parquet(output)) == hits(retrieve(streamed.corpus(EMBEDDER), questions))


def test_stream_of_a_table_in_one_file_or_many(spark, frame):
    folder = work_folder(spark, "tables")
    frame(BEFORE, DOC).repartition(3).write.parquet(f"{folder}/many.parquet")
    frame(BEFORE, DOC).coalesce(1).write.parquet(f"{folder}/part")
    (part,) = spark.read.parquet(f"{folder}/part").inputFiles()
    shutil.copy(part.removeprefix("file://"), f"{folder}/one.parquet")
    for name in ("one", "many"):
        out = work_folder(spark, "streamed")
        stream = _stream(spark, folder, name).writeStream.option("checkpointLocation", work_folder(spark, "checkpoint"))
        stream.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == BEFORE


def test_a_batch_delivered_twice_is_taken_once(spark, frame, settings):
    root = work_folder(spark, "test-index")
    docs = work_folder(spark, "incoming")
    frame(BEFORE, DOC).write.parquet(docs)
    for _ in range(2):
        stream = spark.readStream.schema(DOC).parquet(docs)
        # A fresh checkpoint numbers its batches from 0 again.
        ingest(stream, root, EMBEDDER, work_folder(spark, "checkpoint"), "docs", settings).awaitTermination()
    assert open_index(spark, root).version == 1


def test_a_fresh_checkpoint_loses_no_document(spark, frame, settings):
    root = work_folder(spark, "test-index")
    for rows in (BEFORE[:1], BEFORE[1:]):
        docs = work_folder(spark, "incoming")
        frame(rows, DOC).write.parquet(docs)
        stream = spark.readStream.schema(DOC).parquet(docs)
        ingest(stream, root, EMBEDDER, work_folder(spark, "checkpoint"), "docs", settings).awaitTermination()
    assert {r.path for r in open_index(spark, root).manifest.collect()} == {str(r[0]) for r in BEFORE}


def test_a_moved_document_is_refreshed(spark, frame, settings):
    first = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    moved = [BEFORE[0], (1, "elsewhere/1", BEFORE[1][2]), *BEFORE[2:]]
    second = refresh_index(first, frame(moved, DOC), EMBEDDER)
    assert "elsewhere/1" in {r.source_path for r in second.chunks.collect()}
    assert BEFORE[1][1] not in {r.source_path for r in second.chunks.collect()}


def test_repeated_ids_are_refused(spark, frame, settings):
    with pytest.raises(ValueError, match="doc_id"):
        build_index(frame(BEFORE + BEFORE[:1], DOC), work_folder(spark, "test-index"), EMBEDDER, settings)


def test_statistics_follow_the_live_chunks(spark, frame, settings):
    first = build_index(frame(BEFORE, DOC), work_folder(spark, "test-index"), EMBEDDER, settings)
    second = refresh_index(first, frame(AFTER, DOC), EMBEDDER)
    totals = bm25.corpus_totals(second.chunks, second.terms).first()
    assert totals.n_chunks == second.chunks.count()
    assert totals.n_tokens == sum(r.chunk_len for r in second.chunk_stats.collect())
