import numpy as np
import pytest

from tarnsearch.operators import dense, inverted
from tarnsearch.plans.work import work_folder

VECTORS = "chunk_id long, embedding array<float>"
ASKED = "query_id long, embedding array<float>"


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def clustered(seed, families, each, dim, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, dim))
    stored = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(families * each, dim))
    return stored.astype("f4"), centres.astype("f4")


@pytest.fixture
def tables(frame):
    def make(stored, asked):
        return (
            frame([(i, v.tolist()) for i, v in enumerate(stored)], VECTORS),
            frame([(i * 3, v.tolist()) for i, v in enumerate(asked)], ASKED),
        )

    return make


@pytest.fixture(scope="module")
def built(spark):
    stored, asked = clustered(1, 20, 60, 12)
    stored[:400] = stored[0]  # a third of all vectors are one
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], VECTORS)
    questions = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(asked)], ASKED)
    index = {m: inverted.build_inverted_file(vectors, work_folder(spark, "ivf"), cells=25, metric=m) for m in ("ip", "cosine")}
    return vectors, questions, index


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_all_cells_are_the_exact_search(built, metric):
    vectors, questions, index = built
    exact = rows(dense.topk(vectors, questions, 7, metric))
    assert rows(inverted.topk(index[metric], questions, 7, probes=99)) == exact
    for probes, max_bytes in ((1, 1 << 20), (3, 8 * 12 * 4)):
        assert rows(inverted.exact_topk(index[metric], questions, 7, probes, max_bytes=max_bytes)) == exact


def test_bounds_leave_cells_unread(built):
    """Cells that cannot hold a better vector are not read, and the search is exact all the same."""
    _, questions, index = built
    read, total = inverted.cells_read(index["cosine"], questions, 7, probes=2)
    assert read < total / 2


def test_only_probed_folders_are_read(built):
    _, questions, index = built
    found = inverted.topk(index["ip"], questions.limit(1), 5, probes=2)
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [cell" in scan and scan.count(",") < 60
    files = found._jdf.queryExecution().toRdd()  # runs
    assert files is not None
    cells = set(found.join(index["ip"].vectors, "chunk_id").select("cell").distinct().toArrow().column("cell").to_pylist())
    assert len(cells) <= 2


def test_calibrated_recall(built):
    vectors, questions, index = built
    probes = inverted.calibrate(index["cosine"], questions, 10, 0.9)
    exact = {r[:1] + r[2:3] for r in rows(dense.topk(vectors, questions, 10, "cosine"))}
    found = {r[:1] + r[2:3] for r in rows(inverted.topk(index["cosine"], questions, 10, probes))}
    assert len(exact & found) >= 0.9 * len(exact) and probes < 25
    if probes > 1:
        fewer = {r[:1] + r[2:3] for r in rows(inverted.topk(index["cosine"], questions, 10, probes - 1))}
        assert len(exact & fewer) < 0.9 * len(exact)


def test_stored_index_opens_as_it_was(spark, built):
    vectors, questions, index = built
    again = inverted.open_inverted_file(spark, index["cosine"].path)
    assert again.metric == "cosine" and (again.centres == index["cosine"].centres).all()
    assert sorted(r.chunk_id for r in again.vectors.collect()) == list(range(1200))
    assert rows(inverted.topk(again, questions, 4)) == rows(inverted.topk(index["cosine"], questions, 4))
    centres = inverted.train_centres(vectors.repartition(5), 25, metric="cosine")
    assert (centres == again.centres).all()  # whatever the layout of the table


def test_hot_cells_are_spread_over_files(spark, built, monkeypatch):
    monkeypatch.setattr(inverted, "ROWS_PER_FILE", 50)
    vectors, questions, index = built
    many = inverted.build_inverted_file(vectors, work_folder(spark, "ivf"), cells=25)
    per_file = many.vectors.groupBy("cell", "_metadata.file_name").count().collect()
    assert max(r["count"] for r in per_file) <= 50 and sum(r["count"] for r in per_file) == 1200
    assert rows(inverted.topk(many, questions, 7, probes=99)) == rows(dense.topk(vectors, questions, 7))


def test_few_or_no_vectors(spark, tables):
    stored, asked = clustered(2, 1, 3, 4)
    vectors, questions = tables(stored, asked)
    index = inverted.build_inverted_file(vectors, work_folder(spark, "ivf"), cells=10)
    assert len(index.centres) == 3 and len(rows(inverted.exact_topk(index, questions, 60))) == 3
    assert rows(inverted.topk(index, questions.limit(0), 5)) == []
    empty = inverted.build_inverted_file(vectors.limit(0), work_folder(spark, "ivf"))
    assert rows(inverted.topk(empty, questions, 5)) == [] and rows(inverted.exact_topk(empty, questions, 5)) == []
    assert inverted.calibrate(index, questions.limit(0)) == 1
