import hashlib
import re
from collections import defaultdict

from tarnsearch.llm.licenses import TEMPLATES, LicenseScan, scan_licenses
from tarnsearch.llm.lines import drop_common_lines
from tests.llm.conftest import ODD, prose, row

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    holders = defaultdict(set)
    keyed = []
    for doc, text, *_ in rows:
        lines = [(line, line.strip(" \t\n\x0b\x0c\r").translate(A_Z)) for line in (text or "").split("\n")]
        keyed.append((doc, lines))
        for _, key in lines:
            if len(key) >= 20:
                holders[key].add(-1 if doc is None else doc)
    out = []
    for doc, lines in keyed:
        kept = [line for line, key in lines if len(holders[key]) < 3 or max(holders[key]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_common_lines(docs, odd, empty):
    rows = ODD + [
        row(20 + i, f"{prose(i, 8)}\n  A LINE that everyone has É\t\n{prose(i, 3)}\nshort\n" * (1 + i % 2)) for i in range(30)
    ] + [row(None, "a line that everyone has É"), row(20, "a line that everyone has É")]
    found = [
        (r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest())
        for r in drop_common_lines(docs(rows)).collect()
    ]
    assert sorted(found, key=str) == brute_lines(rows)
    assert drop_common_lines(odd).count() == len(ODD) and drop_common_lines(empty).count() == 0


def test_license_templates_meet_blocks(docs):
    body = TEMPLATES[3][1].split()
    inside = " ".join(body[: int(len(body) * 0.95)])
    rows = [
        row(1, prose(1, 200) + " " + inside.upper() + " " + prose(2, 200)),
        row(2, prose(3, 300)),
        row(3, "MIT-License\nthe mit license, mit license"),
        row(4, " ".join(w for word in body for w in (word, prose(len(word), 60)))),
    ]
    found = {r.doc_id: r for r in scan_licenses(docs(rows)).collect()}
    assert (found[1].labels, found[1].base_labels, found[1].n_base) == ("mit", "", 0) and found[1].score >= 0.8
    assert (found[2].labels, found[2].score, found[2].first_word) == ("", 0.0, None)
    assert (found[3].n_base, found[3].first_word, found[3].last_word, found[3].base_labels) == (3, 0, 5, "mit")
    assert found[4].labels == ""  # its words, but in no one block


def test_license_filters_lose_nothing(docs):
    how = LicenseScan(phrases=(), templates=(("x", prose(5, 12)), ("y", prose(6, 9))), window=32)
    rows = [row(i, prose(100 + i, 20) + " " + " ".join((prose(5 + i % 2, 12)).split()[i % 5 :]) + " " + prose(i, 50)) for i in range(40)]
    found = {r.doc_id: r.labels for r in scan_licenses(docs(rows), how).collect()}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(A_Z))
        met = {
            label
            for label, body in how.templates
            for s in range(0, max(len(words) - 17, 0) + 1, 16)
            if 100 * len(set(body.split()) & set(words[s : s + 32])) >= 80 * len(set(body.split()))
        }
        assert found[doc] == ",".join(sorted(met))


def test_long_templates(docs):
    """Whole licenses longer than the window are met; half of one is not."""
    short, long = prose(70, 200), " ".join(f"t{i}" for i in range(1500))
    how = LicenseScan(phrases=(), templates=(("short", short), ("long", long)))
    cut = " ".join(w for i, w in enumerate(long.split()) if i % 10)
    rows = [
        row(1, prose(1, 333) + " " + short + " " + prose(2, 100)),
        row(2, " ".join(f"o{i}" for i in range(2222)) + "\n" + long.upper() + " " + "x " * 900),
        row(3, "y " * 700 + cut),
        row(4, " ".join(long.split()[:750])),
        row(5, long.replace(" ", " " + "z " * 9)),
        row(6, TEMPLATES[-2][1]),
    ]
    found = {r.doc_id: r for r in scan_licenses(docs(rows), how).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "short", 2: "long", 3: "long", 4: "", 5: "", 6: ""}
    assert (found[1].score, found[2].score, found[3].score) == (1.0, 1.0, 0.9)
    whole = scan_licenses(docs(rows[5:])).first()
    assert "mit" in whole.labels.split(",") and whole.score == 1.0


def test_odd_rows(odd, empty):
    found = scan_licenses(odd)
    assert found.count() == len(ODD) and found.where("n_base > 0").count() == 0
    assert {r.n_words for r in found.where("doc_id in (1, 2, 3)").collect()} == {0}
    assert scan_licenses(empty).count() == 0


def test_long_text_that_loses_lines(docs):
    """Time grows with the lines, not with their square."""
    import time

    shared = [f"a line that three documents hold {i}" for i in range(50_000)]
    text = "\n".join(x for i, line in enumerate(shared) for x in (line, f"own {i}"))
    rows = [row(1, text), row(2, "\n".join(shared)), row(3, "\n".join(shared))]
    start = time.perf_counter()
    out = {r.doc_id: r for r in drop_common_lines(docs(rows)).collect()}
    assert time.perf_counter() - start < 30
    assert (out[1].n_lines, out[1].n_dropped) == (100_000, 50_000)
    assert out[1].text == "\n".join(f"own {i}" for i in range(50_000)) and out[3].text == rows[2][1] and out[2].text == ""
