import pyarrow.parquet as pq
import pytest

from tarnsearch.plans import work


class Session:
    """Just what naming a folder asks of a session."""

    def __init__(self, named=None, checkpoint=None, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": named}
        self.sparkContext = self
        self.master = master
        self.getCheckpointDir = lambda: checkpoint


def test_the_named_folder_comes_first():
    assert work.work_folder(Session("/shared/", "/other"), "x").startswith("/shared/tarnsearch/x-")
    assert work.work_folder(Session(None, "/other"), "x").startswith("/other/tarnsearch/x-")


def test_own_folder_only_on_one_machine():
    first, second = (work.work_folder(Session(), "x") for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        work.work_folder(Session(master="spark://host:7077"), "x")


def test_fits(frame):
    rows = frame([(i,) for i in range(5)], "i int")
    assert work.fits(rows, 5) and not work.fits(rows, 4)


def test_materialize(frame):
    rows = frame([(1, ["a"]), (2, None)], "i int, a array<string>")
    assert sorted(work.materialize(rows, "test").collect()) == sorted(rows.collect())


def test_buckets_with_a_bounded_row_group(frame):
    rows = frame([(1, [i]) for i in range(5)], "b int, a array<int>").coalesce(1)
    written = work.materialize_in_buckets(rows, "test", "b", 2)
    assert sorted(written.collect()) == sorted(rows.collect())
    (file,) = written.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert [groups.row_group(i).num_rows for i in range(groups.num_row_groups)] == [2, 2, 1]
