from math import comb

import pytest
from pyspark.sql import functions as F

from tarnsearch.llm.quality import Risk, binomial_tail, keep_good, quality_verdicts, repeated_words
from tests.llm.conftest import ODD, prose, row

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.2), (49, 50, 0.9), (5, 5, 0.5)])
def test_binomial_tail(k, n, p):
    exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert binomial_tail(k, n, p) == pytest.approx(exact)


def brute_repeats(words, window=8):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + window)})


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "a " * 30, prose(1, 40) + " x " + prose(1, 20), "a b", ""])
def test_repeated_words(text):
    assert repeated_words(text.encode().split()) == brute_repeats(text.split())


def corpus(n=900):
    good = [row(i, prose(i, 60)) for i in range(n)]
    bad = [row(n + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(60)]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad[:30]]
    return good + bad, labels


def test_certified_rules_reject_junk_and_keep_good(spark, docs):
    rows, labels = corpus()
    kept = {r.doc_id for r in keep_good(docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == set(range(900))


def test_nothing_is_certified_on_few_labels(spark, docs):
    rows, labels = corpus()
    few = spark.createDataFrame(labels[:100], LABELS)
    out = quality_verdicts(docs(rows), few)
    assert out.where("rejected_by <> ''").count() == 0


def test_a_cutoff_that_costs_good_documents_is_not_certified(spark, docs):
    rows, labels = corpus()
    rows = [row(i, r[1].replace(" ", " # ") if i % 10 == 0 else r[1]) for i, r in enumerate(rows[:900])]
    out = quality_verdicts(docs(rows), spark.createDataFrame(labels, LABELS), Risk(alpha=0.05))
    assert out.where("not kept").count() == 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (2, None, 0), (6, 1, 0)], LABELS)
    out = quality_verdicts(odd, labels)
    assert out.count() == len(ODD)
    by = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert by[(1, 0)].base_failed and by[(4, 1)].word_chars == 3 and not by[(6, 60)].base_failed
    assert keep_good(odd, labels).columns == odd.columns
    assert quality_verdicts(empty, labels).count() == 0 and keep_good(empty, labels).count() == 0
    assert quality_verdicts(odd, labels.where(F.lit(False))).count() == len(ODD)
