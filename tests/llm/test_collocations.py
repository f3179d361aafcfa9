import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnsearch.llm import collocations as module
from tarnsearch.llm.collocations import Collocations, Index, collocations, encode, extensions
from tests.llm.conftest import ODD, row


def brute(rows, how):
    counts = {}
    for _, text, lang, _, _ in rows:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, how.words + 1):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= how.least}
        around = {}
        for g, c in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    part = g[i : i + m]
                    around[part] = max(around.get(part, 0), c)
        rows_of = []
        for g, a in candidates.items():
            if g in around and 100 * around[g] >= how.inside * a:
                continue
            score, _, l, r = min(
                (1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
            )
            rows_of.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_of)[: how.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def text(rng, n):
    words = [rng.choice(["a", "b", "c", "New", "york", "ünï", "d-e", "x\x00y"]) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for w in words)


@pytest.mark.parametrize("how", [Collocations(), Collocations(words=4, least=2, inside=70, top=25), Collocations(words=2, least=3)])
@pytest.mark.parametrize("size", [20, 1 << 20])
def test_equals_brute_force(spark, docs, how, size, monkeypatch):
    monkeypatch.setattr(module, "SHARD_WORDS", size)
    rng = random.Random(how.words)
    rows = [row(i, text(rng, rng.choice([0, 1, 5, 60])), rng.choice(["en", "en", "en", "de", None, "a\tb"])) for i in range(120)]
    found = sorted(tuple(r) for r in collocations(docs(rows), how).collect())
    assert found == brute(rows, how) and found


def test_odd_rows(odd, empty):
    how = Collocations(least=2)
    assert sorted(tuple(r) for r in collocations(odd, how).collect()) == brute(ODD, how)
    assert collocations(empty).count() == 0


def test_intervals_keep_step():
    """Left and right extensions of the same phrase agree in both intervals and with a plain count."""
    rng = np.random.default_rng(3)
    seq = np.where(rng.random(3000) < 0.1, 0, rng.integers(1, 12, 3000)).astype(np.int32)
    seq[[0, -1]] = 0
    index = Index(seq, 4)
    runs = Counter(tuple(seq[i : i + k].tolist()) for k in (1, 2, 3, 4) for i in range(len(seq) - k + 1))
    for k in (1, 2, 3):
        known = np.array([g for g in runs if len(g) == k and 0 not in g])
        phrases = index.find(known)
        assert [runs[tuple(g)] for g in known.tolist()] == phrases.n.tolist()
        right, left = {}, {}
        owner, word, longer = index.right(phrases)
        for o, w, at, back, n in zip(owner, word, longer.at, longer.back, longer.n):
            right[(*known[o].tolist(), int(w))] = (at, back, n)
        owner, word, longer = index.left(phrases)
        for o, w, at, back, n in zip(owner, word, longer.at, longer.back, longer.n):
            left[(int(w), *known[o].tolist())] = (at, back, n)
        assert left == right and {g: v[2] for g, v in left.items()} == {g: c for g, c in runs.items() if len(g) == k + 1 and 0 not in g}


def test_only_frequent_ends_are_extended():
    seq = np.array([0, 1, 2, 3, 0, 1, 2, 0, 2, 3, 0], np.int32)
    owner, word, n = extensions(seq, np.array([[1, 2], [2, 3]]))
    assert (owner.tolist(), word.tolist(), n.tolist()) == ([0], [3], [1])
    assert extensions(seq, np.array([[1, 2]]))[2].tolist() == []


def test_words_of_a_shard():
    seq, words = encode([b"Ab c.c", b"", b"  ", "É\tab".encode()], ["x", "y", "y", "y"])
    names = words.to_pylist()
    assert [names[i - 1] if i else "" for i in seq] == ["", "x\tab", "x\tc", "", "x\tc", "", "y\tÉ", "y\tab", ""]
    seq, words = encode([b"", b". ,"], ["x", "y"])
    assert seq.tolist() == [0] and len(words) == 0
