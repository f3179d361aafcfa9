import json

import pytest

from tarnsearch.plans.work import work_folder
from tarnsearch.sources import files
from tarnsearch.sources.tables import read_chunks, read_table, write_chunks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes("żółć\r\nline\rend".encode())
    (tmp_path / "deep" / "B.TXT").write_bytes("zażółć".encode("cp1250"))
    (tmp_path / "deep" / "c.Md").write_text("# Head\n\n*x*")
    (tmp_path / "deep" / "er" / "d.html").write_text("<p>hi &amp; bye</p>")
    (tmp_path / "e.pdf").write_bytes(b"%PDF \xff")
    (tmp_path / "f.exe").write_bytes(b"no")
    (tmp_path / "empty.txt").write_bytes(b"")
    return str(tmp_path)


def by_name(rows, value):
    return {r.source_path.rsplit("/", 1)[1]: value(r) for r in rows}


def test_listing(spark, folder):
    got = by_name(files.list_files(spark, folder).collect(), lambda r: r.suffix)
    assert got == {
        "a.txt": ".txt",
        "B.TXT": ".txt",
        "c.Md": ".md",
        "d.html": ".html",
        "e.pdf": ".pdf",
    }
    assert files.list_files(spark, folder, None).count() == 6


def test_missing_root(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_files(spark, folder + "/none").count()


def test_texts(spark, folder):
    got = by_name(files.load_documents(spark, folder).collect(), lambda r: r.text)
    assert got == {
        "a.txt": "żółć\nline\nend",
        "B.TXT": "zażółć",
        "c.Md": "Head\n\nx",
        "d.html": "hi & bye",
    }


def test_quarantine(spark, folder):
    scanned = files.scan_files(spark, folder, charsets=("ascii",))
    got = by_name(files.quarantined(scanned).collect(), lambda r: r.error)
    assert got == {"e.pdf": "unsupported format", "B.TXT": "cannot be decoded"}
    assert files.readable(scanned).count() == 3


def test_table_rows_are_checked(frame):
    df = frame([(1, "fine"), (2, None), (3, "bro\ufffdken")], "id long, text string")
    got = {r.id: r.error for r in files.check_documents(df).collect()}
    assert got == {1: None, 2: "cannot be read", 3: "cannot be decoded"}


def test_chunk_lines(spark, frame):
    path = work_folder(spark, "lines")
    chunks = frame([(0, "s/ż.txt", 'tab\t"q"\nż')], "chunk_id long, source_path string, text string")
    write_chunks(chunks, path)
    line = json.loads(spark.read.text(path).first()[0])
    assert line == {
        "page_content": 'tab\t"q"\nż',
        "metadata": {"chunk_id": 0, "source_path": "s/ż.txt"},
    }
    assert read_chunks(spark, path, ["source_path"]).select(chunks.columns).collect() == chunks.collect()


def test_small_tables_use_all_cores(spark, frame):
    path = work_folder(spark, "one-file")
    frame([(i, [float(i)]) for i in range(1000)], "id long, v array<double>").coalesce(1).write.parquet(path)
    table = read_table(spark, path, "id")
    assert table.count() == 1000
    assert table.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
