import pytest

from tarnsearch.operators.fusion import candidate_filter, gather_candidates, may_be_wanted, rank_list, rrf_fuse

HITS = "query_id long, chunk_id long, score double"


@pytest.fixture
def lists(frame):
    a = rank_list(frame([(0, 1, 9.0), (0, 2, 8.0), (0, 3, 7.0)], HITS))
    b = rank_list(frame([(0, 3, 0.9), (0, 4, 0.8), (0, 1, 0.7)], HITS))
    return a, b


def order(df):
    return [r.chunk_id for r in df.orderBy("query_id", "rank").collect()]


def test_rank_list(frame):
    ranked = rank_list(frame([(0, 5, 1.0), (0, 3, 1.0), (1, 9, 0.1)], HITS))
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in ranked.collect()) == [
        (0, 1, 3),
        (0, 2, 5),
        (1, 1, 9),
    ]


def test_first_seen_breaks_ties(lists):
    fused = rrf_fuse(lists)
    assert order(fused) == [1, 3, 2, 4]
    assert order(rrf_fuse(lists, topn=3)) == [1, 3, 2]
    assert order(rrf_fuse(lists[::-1])) == [3, 1, 4, 2]
    scores = {r.chunk_id: r.rrf_score for r in fused.collect()}
    assert scores[1] == pytest.approx(1 / 61 + 1 / 63)
    assert scores[4] == pytest.approx(1 / 62)


def test_one_list_empty_gives_the_other(lists, frame):
    empty = rank_list(frame([], HITS))
    assert order(rrf_fuse([lists[0], empty])) == [1, 2, 3]
    assert order(rrf_fuse([empty, lists[1]])) == [3, 4, 1]


def test_three_lists(lists):
    assert order(rrf_fuse([*lists, lists[1]]))[0] == 3


def test_checks(lists):
    with pytest.raises(ValueError):
        rrf_fuse(lists, topn=0)
    with pytest.raises(ValueError):
        rrf_fuse([])


def test_gather(lists, frame):
    chunks = frame(
        [(i, f"s{i}", f"text {i}") for i in range(10)], "chunk_id long, source_path string, text string"
    )
    rows = gather_candidates(rrf_fuse(lists, topn=2), chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.source, r.text) for r in rows] == [(1, "s1", "text 1"), (3, "s3", "text 3")]


@pytest.mark.parametrize("words", [1, 7, 1 << 18])
def test_gather_is_one_form_at_every_filter_size(frame, words):
    chunks = frame([(i, f"s{i}", f"text {i}") for i in range(500)], "chunk_id long, source_path string, text string")
    fused = frame([(q, (q * 37 + r * 11) % 600, r, 1.0 / r) for q in range(40) for r in range(1, 9)],
                  "query_id long, chunk_id long, rank int, rrf_score double")
    expected = sorted((r.query_id, r.chunk_id, r.rank, f"text {r.chunk_id}") for r in fused.collect() if r.chunk_id < 500)
    got = gather_candidates(fused, chunks, words=words)
    assert sorted((r.query_id, r.chunk_id, r.rank, r.text) for r in got.collect()) == expected


def test_filter_lets_all_wanted_and_few_others_through(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "chunk_id")
    wanted = rows.filter("chunk_id % 100 = 7")
    table = candidate_filter(wanted, "chunk_id", 1 << 8)
    assert table.count() <= 1 << 8
    through = may_be_wanted(rows, table, "chunk_id", 1 << 8)
    assert through.columns == ["chunk_id"]
    assert through.filter("chunk_id % 100 = 7").count() == 1000 and through.count() < 4000
    assert may_be_wanted(rows, candidate_filter(wanted.limit(0), "chunk_id"), "chunk_id").count() == 0


def test_filter_moves_no_chunk(spark):
    rows = spark.range(1000).selectExpr("id AS chunk_id", "cast(id AS string) AS text")
    table = candidate_filter(rows.filter("chunk_id < 9"), "chunk_id")
    plan = may_be_wanted(rows, table, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line)
