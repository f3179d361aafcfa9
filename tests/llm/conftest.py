import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


# Nulls, empty and very long texts, ties, repeated rows.
ODD = [
    row(None, None, None, None),
    row(None, "a b c"),
    row(1, None),
    row(2, ""),
    row(3, " \t\n\x0b\x0c\r "),
    row(4, "one"),
    row(5, "one"),
    row(6, prose(1, 60)),
    row(6, prose(1, 60)),
    row(7, prose(1, 60).upper(), None),
    row(8, prose(2, 40_000), "de", None),
    row(9, "É\u00a0x \u2028 ÀB\x00c\n\n" + prose(3, 30), "fr"),
]


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """The odd rows, with further columns under names that operators might use."""
    from pyspark.sql import functions as F

    frame = docs(ODD)
    for name in ("id", "key", "size", "label", "words", "digest", "_row", "kept", "shard_", "target", "n", "host", "path"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture
def empty(docs):
    return docs([])
