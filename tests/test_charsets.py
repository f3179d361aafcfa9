import random

import pytest
from pyspark.sql import functions as F

from tarnsearch.functions.charsets import MIN_CONFIDENCE, detect
from tarnsearch.sources.files import CHARSETS, as_texts

TEXTS = {
    "pl": "Zażółć gęślą jaźń. Święty Łukasz źle śpi, a ćma ląduje na łące. Ósma rano w Łodzi.",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy. Řeka je široká, šťastný člověk.",
    "hu": "Árvíztűrő tükörfúrógép. Az őszi eső jó.",
    "fr": "Voilà où l'été a été très agréable, à côté de la forêt. Ça va, Noël ? Être ou ne pas être.",
    "es": "El niño pequeño comió una manzana más en el jardín. ¿Qué tal, señor? ¡Año nuevo!",
    "de": "Größere Mädchen hören schöne Lieder über Äpfel und Öl.",
}


@pytest.mark.parametrize(
    "lang, charset",
    [("pl", "cp1250"), ("pl", "iso-8859-2"), ("cs", "cp1250"), ("cs", "iso-8859-2"), ("hu", "cp1250"), ("fr", "iso-8859-1"), ("es", "iso-8859-1"), ("de", "iso-8859-1")],
)
def test_texts_come_back(lang, charset):
    data = TEXTS[lang].encode(charset)
    found, sure = detect(data, CHARSETS)
    assert data.decode(found) == TEXTS[lang] and sure > 0.9


def test_random_bytes_are_no_text():
    rng = random.Random(1)
    for n in (40, 500, 5000):
        data = bytes(rng.randrange(1, 256) for _ in range(n))
        assert detect(data, CHARSETS)[1] < MIN_CONFIDENCE
    assert detect(b"text\0\xff", CHARSETS) == (None, 0.0)
    assert detect(b"\xff", ()) == (None, 0.0)
    assert detect("ż".encode("cp1250"), ("ascii",)) == (None, 0.0)


def test_long_texts_are_told_by_their_ends_and_middle():
    assert detect((TEXTS["pl"] * 10_000).encode("iso-8859-2"), CHARSETS)[0] == "iso-8859-2"


def test_columns_of_scanned_files(spark):
    rng = random.Random(2)
    rows = [
        ("a.txt", TEXTS["pl"].encode("iso-8859-2")),
        ("b.txt", "zwykły".encode()),
        ("c.txt", bytes(rng.randrange(1, 256) for _ in range(300))),
        ("d.txt", b""),
        ("e.txt", None),
    ]
    found = spark.createDataFrame(rows, "path string, content binary").select(
        "path", F.lit(0).alias("size"), F.lit(None).cast("timestamp").alias("modified"), "content", F.lit(None).cast("string").alias("error")
    )
    got = {r.source_path: r for r in as_texts(found).collect()}
    assert (got["a.txt"].text, got["a.txt"].charset, got["a.txt"].error) == (TEXTS["pl"], "iso-8859-2", None)
    assert (got["b.txt"].text, got["b.txt"].charset, got["b.txt"].confidence) == ("zwykły", "utf-8", 1.0)
    assert got["c.txt"].text is None and got["c.txt"].error == "cannot be decoded" and got["c.txt"].confidence < MIN_CONFIDENCE
    assert got["d.txt"].text == "" and got["e.txt"].error == "cannot be decoded"
