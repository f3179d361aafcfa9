import random

import pytest

from tarnsearch.operators import manifest, manifest_tree
from tarnsearch.plans.work import work_folder

ENTRY = "path string, size long, sha256 string"


def entries(n):
    return {f"p/{i}": (f"p/{i}", i % 7, f"h{i}") for i in range(n)}


@pytest.mark.parametrize("buckets", [1, 16, 100, 256])
def test_same_as_the_full_join(spark, frame, buckets):
    rng = random.Random(buckets)
    saved = entries(400)
    current = dict(saved)
    for path in rng.sample(sorted(saved), 6):
        del current[path]
    for path in rng.sample(sorted(current), 5):
        current[path] = (path, 1000, "other")
    current |= {f"new/{i}": (f"new/{i}", None, None) for i in range(4)}
    before, now = frame(list(saved.values()), ENTRY), frame(list(current.values()), ENTRY)
    path = work_folder(spark, "tree")
    manifest_tree.write_tree(before, path, buckets)
    stored = manifest_tree.open_tree(spark, path)
    got = sorted(manifest_tree.diff(stored, now).collect())
    assert got == sorted(manifest.diff_files(before, now).collect()) and len(got) == 15
    assert manifest_tree.diff(stored, before.repartition(3)).count() == 0


def test_only_differing_folders_are_read(spark, frame):
    saved = entries(300)
    path = work_folder(spark, "tree")
    manifest_tree.write_tree(frame(list(saved.values()), ENTRY), path, 64)
    stored = manifest_tree.open_tree(spark, path)
    current = dict(saved) | {"p/7": ("p/7", 1, "other")}
    now = frame(list(current.values()), ENTRY)
    assert len(manifest_tree.differing_buckets(stored.tree, manifest_tree.digest_tree(now, 64), 64)) == 1
    found = manifest_tree.diff(stored, now)
    assert [tuple(r) for r in found.collect()] == [("p/7", "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1][:60]


def test_empty_manifests(spark, frame):
    none, some = frame([], ENTRY), frame([("a", 1, "h")], ENTRY)
    path = work_folder(spark, "tree")
    manifest_tree.write_tree(none, path, 16)
    stored = manifest_tree.open_tree(spark, path)
    assert [tuple(r) for r in manifest_tree.diff(stored, some).collect()] == [("a", "new")]
    assert manifest_tree.diff(stored, none).count() == 0
