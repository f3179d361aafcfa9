import zlib
from collections import Counter, defaultdict

import pytest

from tarnsearch.llm.mixing import mix, mixed_documents, numbered, source_targets
from tarnsearch.llm.sharding import sharded
from tests.llm.conftest import ODD, prose, row


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target = fixed | {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1, "c": 500, None: 7}, {"a": 1}, {f"s{i:02}": 1 + i * i for i in range(25)}, {"a": 0, "b": 4}]
)
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    found = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_numbered_in_code_point_order(spark):
    names = ["b", "a", "Z", "é", "\U0001f600", "\uffff", None, ""]
    out = numbered(spark.createDataFrame([(n,) for n in names], "source string"), "source").collect()
    assert [r.source for r in sorted(out, key=lambda r: r._rank)] == ["", "Z", "a", "b", "é", "\uffff", "\U0001f600", None]


def corpus():
    return [row(i, prose(i, 5 + i * 37 % 90), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(1500)]


def test_taken_words_meet_targets(docs):
    out = mix(docs(corpus())).collect()
    taken, targets, largest = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert len(out) == 1500 and all(abs(taken[s] - t) <= largest[s] for s, t in targets.items())
    again = mix(docs(corpus()).repartition(5, "n_chars")).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    other = mix(docs(corpus()), seed=1).collect()
    assert {(r.doc_id, r.taken) for r in out} != {(r.doc_id, r.taken) for r in other}


def test_repeated_rows_meet_targets(docs):
    """Equal rows share their copies out, whether they have an id or not."""
    rows = [row(1, prose(0, 40), "en", "a")] * 1000 + [row(10 + i, prose(i, 5 + i), "en", "a") for i in range(100)]
    rows += [row(None, prose(3, 7), "en", None)] * 300 + [row(2000 + i, prose(i, 50), "en", "b") for i in range(200)]
    frame = docs(rows)
    taken, targets = Counter(), {}
    for r in mix(frame).collect():
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 104 for s, t in targets.items())
    words = Counter()
    for r in mixed_documents(frame).collect():
        words[r.source] += len(r.text.split())
    assert words == taken


def test_expectations_are_kept(docs):
    """Over many sources alike, documents are taken in proportion to their source's share."""
    rows = [row(100 * s + i, prose(i, 10 + i % 5), "en", f"s{s:03}") for s in range(300) for i in range(12)]
    taken, wanted = Counter(), Counter()
    for r in mix(docs(rows)).collect():
        taken[r.doc_id % 100] += r.copies
        wanted[r.doc_id % 100] += r.target / r.source_size
    assert all(abs(taken[i] - wanted[i]) < 4 * 300**0.5 * 0.5 for i in range(12))


def test_mixed_documents_follow_the_mix(docs, odd, empty):
    frame = docs(corpus() + ODD)
    copies = Counter()
    for r in mix(frame).collect():
        copies[r.doc_id] += r.copies
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mixed_documents(odd).columns == odd.columns and mix(odd).count() == len(ODD)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_shards(docs):
    rows = corpus() + ODD + [row(3000, "the same " * 20)] * 800
    out = sharded(docs(rows), 10).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r._shard] += r._size
        slots[r._shard].append(r._slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = sum(sizes.values()) / 10
    biggest = max(len((r[1] or "").encode()) for r in rows) + 16
    assert set(sizes) == set(range(10)) or biggest > even
    texts = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r._row.doc_id, r._size, r._crc) for r in out), key=str) == texts
    plain = sharded(docs(rows[:1500] + rows[-800:]), 10).groupBy("_shard").sum("_size").collect()
    total = sum(r[1] for r in plain)
    assert max(abs(r[1] * 10 / total - 1) for r in plain) < 0.02


def test_odd_shards(odd, empty):
    out = sharded(odd, 4, carry=True)
    assert out.select("_row.*").columns == odd.columns and out.count() == len(ODD)
    assert sharded(empty, 40).count() == 0 and sharded(odd, 1).where("_shard <> 0").count() == 0
