import math
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from tarnsearch.llm import lm, passages
from tarnsearch.llm.lm import Backoff, backoff_scores
from tarnsearch.llm.passages import Passages, aligned, chains, may_match, shared_passages, stretches
from tests.llm.conftest import ODD, prose, row


def test_chains_equal_brute_force():
    seeds = [(0, 50), (10, 0), (20, 10), (30, 60), (30, 20), (40, 70), (400, 30), (410, 41)]
    cost = 0.01

    def worth(chain):
        return len(chain) - cost * sum(c - a + d - b for (a, b), (c, d) in zip(chain, chain[1:]))

    rising = [[s] for s in sorted(seeds)]
    every = list(rising)
    while rising:
        rising = [c + [s] for c in rising for s in sorted(seeds) if s[0] > c[-1][0] and s[1] > c[-1][1]]
        every += rising
    found = chains(seeds, cost)
    assert worth(found[0]) == pytest.approx(max(map(worth, every)))
    assert len({s for c in found for s in c}) == sum(map(len, found))


def test_passages(docs):
    passage = prose(900, 70).split()
    fuzzy = [w if i % 17 else "other" for i, w in enumerate(passage)]
    rows = [
        row(1, prose(1, 300) + " " + " ".join(passage) + " " + prose(2, 100)),
        row(2, prose(3, 50) + "\n" + " ".join(passage).upper() + "; " + prose(4, 5)),
        row(3, prose(5, 80) + " " + " ".join(fuzzy) + " " + prose(6, 400)),
        row(4, prose(7, 500)),
        row(5, prose(8, 100) + " " + " ".join(passage[:35]) + " " + prose(9, 100)),
        *(row(10 + i, prose(20, 90)) for i in range(20)),
    ]
    found = shared_passages(docs(rows)).collect()
    assert {(r.doc_id, r.match_id) for r in found} == {(2, 1), (3, 1)} | {(10 + i, 10) for i in range(1, 20)}
    texts = {r[0]: r[1].encode() for r in rows}
    for r in found:
        if r.doc_id == 2:
            span = texts[2][r.start : r.end].decode().lower().split()
            assert set(passage) <= set(span) and len(span) < 75
        assert r.identity >= 0.8 and r.n_words >= 50


def test_odd_passages(odd, empty):
    assert {(r.doc_id, r.match_id) for r in shared_passages(odd).collect()} == {(7, 6)}
    assert shared_passages(empty).count() == 0
    assert shared_passages(odd, Passages(min_words=61)).count() == 0


def test_stretches_equal_brute_force():
    dice = random.Random(4)
    for _ in range(300):
        runs, a, b = [], 0, 0
        for _ in range(dice.randint(1, 9)):
            runs.append((a, b, dice.randint(1, 9)))
            a, b = (x + runs[-1][2] + dice.choice([0, 1, 1, 2, 6]) for x in (a, b))
        longest = 0
        for i in range(len(runs)):
            words = equal = 0
            for j in range(i, len(runs)):
                if j > i:
                    words += max(runs[j][s] - runs[j - 1][s] - runs[j - 1][2] for s in (0, 1))
                words, equal = words + runs[j][2], equal + runs[j][2]
                if 100 * equal >= 80 * words:
                    longest = max(longest, words)
        found = stretches(runs, 12, 80)
        assert bool(found) == (longest >= 12)
        if found:
            first = found[0]
            gaps = sum(max(y[s] - x[s] - x[2] for s in (0, 1)) for x, y in zip(first, first[1:]))
            assert gaps + sum(n for *_, n in first) == longest
            kept = sorted(r for f in found for r in f)
            assert len(kept) == len(set(kept))


def has_stretch(equal, words=50, percent=80):
    """Whether some stretch of that many places or more is equal enough."""
    sums = [0, *accumulate(equal)]
    return any(
        100 * (sums[j] - sums[i]) >= percent * (j - i) for i in range(len(equal)) for j in range(i + words, len(equal) + 1)
    )


@pytest.mark.parametrize("replaced", [0.1, 0.15, 0.2])
def test_recall_of_fuzzy_passages(docs, replaced):
    """Passages of 80 words, some replaced at random, of which 50 words are equal to 80 percent."""
    dice = random.Random(int(100 * replaced))
    rows, truth = [], set()
    for n in range(120):
        passage = prose(5000 + n, 80).split()
        equal = [dice.random() >= replaced for _ in passage]
        other = [w if e else f"x{dice.random()}".replace(".", "") for w, e in zip(passage, equal)]
        rows.append(row(2 * n, " ".join([prose(1000 + n, 60), *passage, prose(2000 + n, 60)])))
        rows.append(row(2 * n + 1, " ".join([prose(3000 + n, 60), *other, prose(4000 + n, 60)])))
        if has_stretch(equal):
            truth.add((2 * n + 1, 2 * n))
    found = {(r.doc_id, r.match_id) for r in shared_passages(docs(rows)).collect()}
    assert len(truth) > 60 and len(found & truth) >= 0.9 * len(truth), (len(found & truth), len(truth))


def test_no_passage_is_left_to_chance(docs):
    """Passages of 50 words with every fifth replaced share no run longer than four words but the last of five."""
    rows = []
    for n in range(60):
        passage = prose(7000 + n, 50).split()
        other = [f"x{n}y{i}" if i % 5 == 4 and i < 49 else w for i, w in enumerate(passage)]
        rows.append(row(2 * n, " ".join([prose(1000 + n, 60), *passage, prose(2000 + n, 60)])))
        rows.append(row(2 * n + 1, " ".join([prose(3000 + n, 60), *other, prose(4000 + n, 60)])))
    found = {(r.doc_id, r.match_id) for r in shared_passages(docs(rows)).collect()}
    assert found >= {(2 * n + 1, 2 * n) for n in range(60)}


def brute_lm(rows, order=2):
    """Each word's score by its longest history that other documents have before it, from plain counts."""
    texts = [(r[1] or "").encode().lower().split() for r in rows]

    def count(words):
        return Counter(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))

    every = sum(map(count, texts), Counter())
    total = sum(map(len, texts))
    out = []
    for r, t in zip(rows, texts):
        rest = every.copy()
        rest.subtract(count(t))
        score = 0.0
        for i in range(len(t)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                gram = tuple(t[i - k + 1 : i + 1])
                if k == 1:
                    share = (rest[gram] or 0.5) / max(1, total - len(t))
                elif rest[gram]:
                    share = rest[gram] / rest[gram[:-1]]
                else:
                    continue
                score += math.log(share * 0.4 ** (longest - k))
                break
        out.append((r[0], len(t), round(score, 4) if t else None))
    return sorted(out, key=str)


def scores(frame, how=None):
    found = backoff_scores(frame, how).collect()
    return sorted(((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 4)) for r in found), key=str)


def test_scores_equal_brute_force(docs, odd, empty):
    rows = ODD + [row(20 + i, prose(i % 9, 30 + i)) for i in range(60)]
    for frame in (docs(rows), docs(rows).repartition(7)):
        assert scores(frame) == brute_lm(rows)
    assert backoff_scores(odd).count() == len(ODD) and backoff_scores(empty).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_scores_of_other_orders(docs, order):
    rows = ODD + [row(20 + i, prose(i % 7, 25 + i)) for i in range(40)]
    assert scores(docs(rows).repartition(3), Backoff(order=order, block_words=90)) == brute_lm(rows, order)


def test_a_word_in_every_one_of_many_blocks(docs):
    """A third of all words are one word; blocks hold a text each. Block size changes no score."""
    rows = [row(i, " ".join(f"the {w} {w}{i % 3}" for w in prose(i % 20, 12).split())) for i in range(300)]
    small, large = Backoff(block_words=1), Backoff()
    assert scores(docs(rows).repartition(4), small) == scores(docs(rows), large) == brute_lm(rows)


def test_scores_check_their_settings():
    with pytest.raises(ValueError):
        Backoff(order=0)


def test_seeds_are_made_and_shuffled_once(docs, monkeypatch, capsys):
    written = []

    def keep(frame, label):
        written.append(frame)
        return materialize(frame, label)

    materialize = passages.materialize
    monkeypatch.setattr(passages, "materialize", keep)
    text = prose(7, 80)
    found = shared_passages(docs([row(3, text), row(1, "x " + text), row(2, text + " y"), row(2, text), row(None, text)]))
    assert {(r.doc_id, r.match_id, r.n_words) for r in found.collect()} == {(2, 1, 80), (3, 1, 80)}
    capsys.readouterr()
    written[0].explain("simple")
    # One that makes seeds, one that chains them.
    assert capsys.readouterr().out.count("MapInArrow") == 2


def test_answers_are_short_and_lose_no_count(spark, docs):
    answers = lm.found_elsewhere(spark.createDataFrame([], lm.BLOCKS), 2, 0)
    assert [t for _, t in answers.drop("block", "large").dtypes] == 3 * ["array<smallint>"]
    rows = docs([row(1, "a " * 40_000 + "b"), row(2, "b a b"), row(3, "a b a a " * 9000), row(4, prose(5, 90_000))])
    blocks, one = rows.repartition(4, "doc_id"), rows.coalesce(1)
    scores = [{r.doc_id: (r.n_words, r.log_score) for r in backoff_scores(frame).collect()} for frame in (blocks, one)]
    for doc_id, (n_words, score) in scores[0].items():
        assert scores[1][doc_id] == (n_words, pytest.approx(score))


def test_seeds_cross_the_network_packed(docs, monkeypatch):
    """A row per part each time a task hands on its seeds, not one per seed."""
    monkeypatch.setattr(passages, "HELD_SEEDS", 5000)
    rows = docs([row(i, " ".join(f"w{i}x{j}" for j in range(700))) for i in range(40)]).coalesce(1)
    texts = rows.selectExpr("doc_id as id", "cast(text as binary) as text")
    bits = passages._part_bits(rows.sparkSession)
    found = texts.mapInArrow(passages._seeds(Passages(), bits), passages._packing(3)).collect()
    assert 256 <= len(found) <= 8 * 256 and sum(r.n for r in found) == 40 * 697


def test_packed_columns_come_back():
    dice = np.random.default_rng(1)
    parts = np.sort(dice.integers(0, 9, 500)).astype(np.uint32)
    columns = [dice.integers(-(2**63), 2**63 - 1, 500), dice.integers(0, 9, 500)]
    packed = passages._packed(parts, *columns)
    assert packed.num_rows == len(set(parts.tolist())) and packed.column("n").to_pylist() == np.unique(parts, return_counts=True)[1].tolist()
    batches = [packed.slice(0, 4), packed.slice(4)]
    tables = list(passages._by_part(iter([packed.slice(0, 3), packed.slice(2, 1), packed.slice(3)])))
    assert [t.num_rows for t in tables] == [1, 1, 2] + [1] * (packed.num_rows - 3)
    back = passages._unpacked(passages.pa.Table.from_batches(batches))
    assert all((a == b).all() for a, b in zip(back, columns))
    none = np.empty(0, np.int64)
    assert passages._packed(none, none, none).num_rows == 0


def test_one_chain_is_what_chains_finds():
    dice = random.Random(8)
    whole = 0
    for _ in range(400):
        n, step = dice.randint(2, 9), dice.choice([3, 40, 300])
        a = [sum(dice.randint(1, step) for _ in range(i + 1)) for i in range(n)]
        a = sorted(set(a))
        b = sorted(dice.sample(range(step * 10), len(a))) if dice.random() < 0.8 else dice.sample(range(step * 10), len(a))
        seeds = list(zip(a, b))
        one = passages._one_chain(np.array([0]), np.array(a), np.array(b), 0.002)[0]
        if one and len(a) > 1:
            whole += 1
            assert chains(seeds, 0.002) == [seeds]
    assert whole > 100


def test_no_match_is_lost_before_it_is_aligned():
    dice = random.Random(6)
    matches = 0
    for _ in range(600):
        words = dice.choice([30, 3000])
        a = [dice.randrange(words) for _ in range(90)]
        b = [x if dice.random() < dice.choice([0.7, 0.9]) else dice.randrange(words) for x in a]
        if dice.random() < 0.5:
            b = b[dice.randint(0, 9) :]
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        places = [(i, j) for i in range(40, 45) for j in range(len(b)) if a[i] == b[j]][:1]
        found = bool(places and stretches(aligned(a, b, places, 200), 50, 80))
        matches += found
        assert may_match(a, b, 50, 80) or not found
    assert matches > 100
    assert not may_match(np.arange(90, dtype=np.uint64), np.arange(85, 200, dtype=np.uint64), 50, 80)
    assert not may_match(np.empty(0, np.uint64), np.empty(0, np.uint64), 50, 80)


def test_a_passage_whose_seeds_have_other_first_documents(docs):
    """Two documents share a passage of which every four words are in an earlier document of their own."""
    passage = prose(31, 60).split()
    earlier = [row(i, f"a{i} b{i} " + " ".join(passage[i : i + 4]) + f" c{i} d{i}") for i in range(57)]
    rows = earlier + [row(100 + i, " ".join([prose(40 + i, 70), *passage, prose(50 + i, 70)])) for i in range(2)]
    found = shared_passages(docs(rows)).collect()
    assert {(r.doc_id, r.match_id) for r in found} == {(101, 100)} and found[0].n_words >= 60


def test_a_passage_of_frequent_seeds_with_other_first_documents(docs):
    """As before, with every four words in more documents than all meet."""
    passage = prose(61, 60).split()
    earlier = [
        row(100 * k + i, f"a{i}k{k} b{i} " + " ".join(passage[i : i + 4]) + f" c{i} d{i}k{k}") for k in range(12) for i in range(57)
    ]
    rows = earlier + [row(9000 + i, " ".join([prose(70 + i, 70), *passage, prose(80 + i, 70)])) for i in range(2)]
    assert {(r.doc_id, r.match_id) for r in shared_passages(docs(rows)).collect()} == {(9001, 9000)}


def test_a_passage_is_found_at_each_of_its_places(docs):
    passage = prose(91, 60)
    twice = " ".join([passage, prose(92, 400), passage, prose(93, 300)])
    found = shared_passages(docs([row(1, prose(94, 80) + " " + passage), row(2, twice)])).collect()
    second = len(passage) + len(prose(92, 400)) + 2
    assert {(r.doc_id, r.match_id) for r in found} == {(2, 1)}
    for start in (0, second):
        assert any(r.start <= start and r.end >= start + len(passage) and r.n_words >= 60 for r in found)


def test_a_passage_whose_words_stand_apart_before_it(docs):
    """The earlier text has its pieces first, far from each other; the passage is whole at the end only."""
    passage = prose(95, 60).split()
    pieces = [w for i in range(0, 60, 6) for w in (*passage[max(0, i - 3) : i + 9], prose(200 + i, 260))]
    rows = [row(1, " ".join([*pieces, *passage])), row(2, " ".join([prose(96, 90), *passage, prose(97, 90)]))]
    found = [r for r in shared_passages(docs(rows)).collect() if r.n_words >= 60]
    assert {(r.doc_id, r.match_id) for r in found} == {(2, 1)} and all(r.match_end == len(rows[0][1]) for r in found)


def test_one_word_over_and_over(docs):
    found = shared_passages(docs([row(1, "x " * 300), row(2, "y " * 90), row(3, "a b x" + " x" * 500)])).collect()
    assert {(r.doc_id, r.match_id) for r in found} == {(3, 1)} and max(r.n_words for r in found) >= 300


def test_crowded_places_equal_brute_force():
    dice = random.Random(12)
    for _ in range(50):
        places = sorted({(dice.randrange(3), dice.randrange(900)) for _ in range(dice.randint(1, 120))})
        rarity = [dice.randrange(30) for _ in places]
        ids, at = (np.array(c) for c in zip(*places))
        brute = [
            sum(i != j and d == e and abs(p - q) <= 100 and rarity[j] >= rarity[i] for j, (e, q) in enumerate(places)) >= passages.CROWD
            for i, (d, p) in enumerate(places)
        ]
        assert passages._crowded(ids, at, np.array(rarity), 100).tolist() == brute
