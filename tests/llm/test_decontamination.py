import random

import pytest

from tarnsearch.llm.decontam import contaminated, exact_shingles, keep_clean, with_matches
from tests.llm.conftest import prose, row

ITEMS = "item_id bigint, text string"


def brute(rows, items):
    out = set()
    for doc in rows:
        own = exact_shingles((doc[1] or "").encode(), 5)
        for item, text in items:
            need = exact_shingles((text or "").encode(), 5)
            if need and item is not None and 100 * len(need & own) >= 80 * len(need):
                out.add((doc[0], item, len(need), len(need & own)))
    return out


@pytest.fixture
def case(spark, docs):
    rng = random.Random(3)
    items = [(i, prose(1000 + i, rng.choice([3, 5, 9, 24, 60, 300]))) for i in range(40)] + [(None, "x"), (99, None), (98, "")]
    rows = []
    for i in range(60):
        text = prose(i, rng.choice([0, 10, 300, 5000])).split()
        if i % 2:
            part = items[i % 40][1].split()
            part = part[: max(1, int(len(part) * rng.choice([0.7, 0.85, 1])))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in part]
        rows.append(row(i, " ".join(text)))
    rows += [row(None, None), row(70, items[2][1]), row(70, items[2][1])]
    return rows, items, docs(rows), spark.createDataFrame(items, ITEMS)


def test_equals_brute_force(case):
    rows, items, frame, wanted = case
    found = contaminated(frame, wanted).collect()
    assert {tuple(r)[:4] for r in found} == brute(rows, items)
    dirty = {d for d, *_ in brute(rows, items)}
    kept = keep_clean(frame, wanted)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - dirty and kept.columns == frame.columns


def test_blocks_of_items_change_nothing(case):
    rows, items, frame, wanted = case
    found = with_matches(frame, wanted, limit=3000).selectExpr("_row.doc_id", "explode(_matches) m").collect()
    assert {(r.doc_id, *r.m) for r in found} == brute(rows, items)


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], ITEMS)
    item = spark.createDataFrame([(1, prose(1, 60))], ITEMS)
    assert keep_clean(odd, none).count() == odd.count()
    assert sorted(r.doc_id for r in contaminated(odd, item).collect()) == [6, 6, 7]
    assert contaminated(empty, item).count() == 0
