import random
import re
from itertools import combinations

import numpy as np
import pytest

from tarnsearch.llm import neardup
from tarnsearch.llm.graph import components
from tarnsearch.llm.neardup import NearDup, keep_one_of_each, near_duplicates, shingle_set, signatures
from tarnsearch.llm.text import PLAIN, SPACED, blocks, distinct, word_hashes
from tests.llm.conftest import ODD, prose, row


def brute(rows, how):
    sets = {}
    for r in rows:
        key = -(2**63) if r[0] is None else r[0]
        sets.setdefault(key, []).append(shingle_set((r[1] or "").encode(), how.shingle))
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= how.percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("how", [NearDup(), NearDup(3, 85)])
def test_equals_brute_force(docs, how):
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(family, rng.choice([2, 4, 30, 120])).split()
        for copy in range(rng.choice([1, 3, 12])):
            words = [w if rng.random() > 0.02 * (copy % 4) else "changed" for w in base]
            rows.append(row(len(rows) * 7 % 101, " ".join(words)))
    found = near_duplicates(docs(rows), how).collect()
    expected = brute(rows, how)
    assert {(r.doc_id, r.component_id) for r in found} == set(expected.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_odd_rows(odd):
    found = near_duplicates(odd, NearDup(3, 85)).collect()
    expected = brute(ODD, NearDup(3, 85))
    assert len(found) == len(ODD)
    for r in found:
        key = -(2**63) if r.doc_id is None else r.doc_id
        own = -(2**63) if r.component_id is None else r.component_id
        assert own == expected[key] and r.kept == (own == key)
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.collect()].count(6) == 2 and 7 not in {r.doc_id for r in kept.collect()}


def test_empty(empty):
    assert near_duplicates(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_words_and_signatures():
    text = "Ab c\u00c9 \x00x\n#tag, a-b  END".encode()
    for table, pattern in ((SPACED, rb"[^\x20\x09-\x0D]+"), (PLAIN, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        starts, ends, hashes = word_hashes(text, table)
        words = [text[a:b] for a, b in zip(starts, ends)]
        assert words == re.findall(pattern, text)
        alone = [word_hashes(w.lower(), table)[2][0] for w in words]
        assert alone == hashes.tolist()
    (block,) = blocks([text, None, text], SPACED)
    one, none, same = block.shingles(2)
    assert one.tolist() == same.tolist() and not len(none)
    a, b = distinct(one), distinct(np.concatenate([one, one]))
    assert (signatures([a, none, b], 64)[0] == signatures([b], 64)[0]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    rows = signatures([distinct(np.concatenate([common, x])) for x in (a, b)], 512)
    assert abs((rows[0] == rows[1]).mean() - 0.8) < 0.08


def test_texts_lie_in_buckets_and_are_not_shuffled_for_pairs(docs, monkeypatch, capsys):
    in_buckets, tables = neardup.materialize_in_buckets, {}
    monkeypatch.setattr(neardup, "materialize_in_buckets", lambda frame, label, key: tables.setdefault(label, in_buckets(frame, label, key)))
    words = prose(3, 200)
    found = near_duplicates(docs([row(1, words), row(2, words + " more"), row(2, "other"), row(3, prose(4, 200))])).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 3)}
    pairs = tables["texts"].sparkSession.range(100_000).selectExpr("id AS a", "id + 1 AS b")
    capsys.readouterr()
    pairs.hint("merge").join(tables["texts"].withColumnRenamed("id", "a"), "a").explain("simple")
    assert capsys.readouterr().out.count("Exchange") == 1
