import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tarnsearch.operators import manifest as m
from tarnsearch.plans.work import work_folder
from tarnsearch.sources.tables import read_manifest, write_manifest

ENTRY = "path string, size long, sha256 string"


@pytest.fixture
def snapshots(frame):
    saved = frame([("a", 1, "h1"), ("b", 1, "h2"), ("c", 1, "h3")], ENTRY)
    current = frame([("b", 1, "h2"), ("c", 1, "h9"), ("d", 1, "h4")], ENTRY)
    return saved, current


def paths(df):
    return sorted(r.path for r in df.collect())


def test_sets(snapshots):
    assert paths(m.added(*snapshots)) == ["d"]
    assert paths(m.removed(*snapshots)) == ["a"]
    assert paths(m.changed(*snapshots)) == ["c"]


def test_reasons(snapshots):
    got = {r.reason for r in m.reasons(m.diff_files(*snapshots)).collect()}
    assert got == {"new source file: d", "removed source file: a", "changed source file: c"}


def test_every_path_has_its_reason(frame):
    current = frame([(f"p{i:04}", 1, "h") for i in range(2500)], ENTRY)
    rows = m.reasons(m.diff_files(frame([], ENTRY), current)).collect()
    assert {r.path for r in rows} == {f"p{i:04}" for i in range(2500)}
    assert {r.n_files for r in rows} == {2500} and len(rows) == 2500


def test_files_and_absent_snapshot(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.TXT").write_bytes(b"hello")
    (tmp_path / "x.bin").write_bytes(b"\xff\x00")
    now = m.file_manifest(spark, str(tmp_path))
    got = {r.path: (r.size, r.sha256) for r in now.collect()}
    assert got == {
        "sub/a b.TXT": (5, hashlib.sha256(b"hello").hexdigest()),
        "x.bin": (2, hashlib.sha256(b"\xff\x00").hexdigest()),
    }
    folder = work_folder(spark, "manifest-test")
    saved = read_manifest(spark, folder)
    assert saved.count() == 0
    assert paths(m.added(saved, now)) == sorted(got)
    write_manifest(now, folder)
    assert m.diff_files(read_manifest(spark, folder), now, compare_mtime=True).count() == 0


def test_touched_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same")
    folder = work_folder(spark, "manifest-test")
    write_manifest(m.file_manifest(spark, str(tmp_path)), folder)
    os.utime(tmp_path / "a.txt", (1, 1))
    saved, now = read_manifest(spark, folder), m.file_manifest(spark, str(tmp_path))
    assert m.changed(saved, now).count() == 0
    assert paths(m.changed(saved, now, compare_mtime=True)) == ["a.txt"]


def test_content(frame):
    row = m.content_manifest(frame([(1, "żó")], "id long, text string"), F.col("id").cast("string")).first()
    assert (row.size, row.sha256) == (4, hashlib.sha256("żó".encode()).hexdigest())
