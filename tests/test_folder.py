import hashlib
import os
import time

import pytest

from tarnsearch.operators.manifest import diff_files, file_manifest
from tarnsearch.plans.work import work_folder
from tarnsearch.sources.files import quarantined, readable
from tarnsearch.sources.folder import load_files, read_folder, stream_folder


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"d{i}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"d{i}" / "deep" / "er" / f"n{i}.txt").write_text(f"text {i}")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "a.MD").write_text("# Head\r\n\r\n*x*")
    (tmp_path / "b.html").write_text("<p>caf&eacute; &mdash; it&#8217;s &#x27;x&#x27; &amp;lt; &nosuch; AT&T</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.bin").write_bytes(bytes(range(256)) * 9000)
    (tmp_path / "latin.txt").write_bytes("zażółć".encode("cp1250"))
    # Opens, but gives an error when it is read.
    os.symlink("/proc/self/mem", tmp_path / "broken.txt")
    return tmp_path


def test_every_file_is_a_row(spark, folder):
    got = {r.path: r for r in read_folder(spark, str(folder)).collect()}
    expected = {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names}
    assert set(got) == expected and len(expected) == 13
    assert got["empty.txt"].size == 0 and got["empty.txt"].sha256 == hashlib.sha256(b"").hexdigest()
    assert got["d.bin"].sha256 == hashlib.sha256((folder / "d.bin").read_bytes()).hexdigest() and got["d.bin"].content is None
    assert got["broken.txt"].error == "cannot be read" and got["broken.txt"].sha256 is None
    assert [r.error for r in got.values()].count(None) == 12


@pytest.mark.parametrize("folders", [1, 3, 1000])
def test_listing_in_tasks_misses_nothing(spark, folder, folders):
    read_folder(spark, str(folder))  # registers the format
    reader = spark.read.format("tarnsearch_folder").option("path", "file://" + str(folder)).option("folders", folders)
    assert sorted(r.path for r in reader.load().collect()) == sorted(r.path for r in read_folder(spark, str(folder)).collect())
    assert reader.option("suffixes", ".txt").load().count() == 9


def test_missing_root(spark, folder):
    with pytest.raises(Exception, match="none"):
        read_folder(spark, str(folder / "none")).count()


def test_load_files(spark, folder):
    scanned = load_files(spark, str(folder))
    texts = {r.source_path: r.text for r in readable(scanned).collect()}
    assert texts == {f"d{i}/deep/er/n{i}.txt": f"text {i}" for i in range(6)} | {
        "empty.txt": "",
        "a.MD": "Head\n\nx",
        "b.html": "café — it’s 'x' &lt; &nosuch; AT&T",
        "latin.txt": "zażółć",
    }
    errors = {r.source_path: r.error for r in quarantined(scanned).collect()}
    assert errors == {"c.pdf": "unsupported format", "broken.txt": "cannot be read"}
    none = load_files(spark, str(folder), charsets=())
    assert {r.source_path for r in quarantined(none).where("error = 'cannot be decoded'").collect()} == {"latin.txt"}


def test_manifest_sees_a_file_become_empty(spark, tmp_path):
    (tmp_path / "x.txt").write_text("full")
    before = spark.createDataFrame(file_manifest(spark, str(tmp_path)).collect())
    (tmp_path / "x.txt").write_bytes(b"")
    assert [(r.path, r.status) for r in diff_files(before, file_manifest(spark, str(tmp_path))).collect()] == [("x.txt", "changed")]


def test_stream_of_new_and_changed_files(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", work_folder(spark, "folder-stream"), work_folder(spark, "folder-checkpoint")
    (root / "sub").mkdir(parents=True)

    def run():
        writer = stream_folder(spark, str(root), settle=0).select("path", "content").writeStream.format("parquet")
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.path, bytes(r.content)) for r in spark.read.parquet(out).collect())

    (root / "a.txt").write_text("1")
    (root / "sub" / "b.txt").write_text("2")
    time.sleep(0.05)
    first = [("a.txt", b"1"), ("sub/b.txt", b"2")]
    assert run() == first
    assert run() == first  # nothing twice
    (root / "sub" / "b.txt").write_text("new")
    (root / "c.txt").write_bytes(b"")
    time.sleep(0.05)
    assert run() == sorted([*first, ("c.txt", b""), ("sub/b.txt", b"new")])
