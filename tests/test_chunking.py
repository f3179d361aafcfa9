import glob
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsearch.functions.splitting import split_text
from tarnsearch.operators import chunking
from tarnsearch.operators.chunking import number_chunks, pieces, split_documents
from tarnsearch.params import SEPARATORS
from tarnsearch.sources.files import load_documents

# Folder with the four sample texts of known chunk counts.
SAMPLE_CORPUS = os.environ.get("TARNSEARCH_SAMPLE_CORPUS", "")


def test_characters():
    assert split_text("abcdefghijklmnop", 10, 4, ("",)) == ["abcdefghij", "ghijklmnop"]


def test_texts_of_a_batch_are_split_in_parts(frame):
    texts = [None, "", *(f"aaa bbb {i}" for i in range(998))]
    parts = list(chunking._splitter(8, 0, SEPARATORS)(iter([pa.array(texts)])))
    assert max(map(len, parts)) <= 256
    expected = [None if t is None else split_text(t, 8, 0, SEPARATORS) for t in texts]
    assert [row for part in parts for row in part.to_pylist()] == expected
    df = frame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.p for r in df.select("doc_id", pieces("text", 8, 0).alias("p")).orderBy("doc_id").collect()] == expected


def test_paragraphs_stay_whole():
    text = "aaa bbb\n\nccc ddd\n\neee"
    assert split_text(text, 12, 0, SEPARATORS) == ["aaa bbb", "ccc ddd", "eee"]
    assert split_text(text, 30, 0, SEPARATORS) == [text]


def test_overlap_repeats_whole_pieces():
    assert split_text("aa bb cc dd", 6, 3, (" ",)) == ["aa bb", "bb cc", "cc dd"]


def test_long_run_falls_to_characters():
    run = "x" * 25
    assert split_text(f"ab {run} cd", 10, 2, SEPARATORS) == ["ab", "x" * 9, "x" * 10, "x" * 10, "cd"]


def test_without_finer_separator_a_long_piece_goes_out_whole():
    assert split_text("a " + "y" * 12, 5, 0, (" ",)) == ["a", " " + "y" * 12]


def test_blank_text_gives_nothing():
    assert split_text(" \n\n ", 10, 2, SEPARATORS) == []
    assert split_text("", 10, 2, SEPARATORS) == []


@settings(max_examples=200, deadline=None)
@given(
    st.text(alphabet="ab \n", max_size=120),
    st.integers(2, 30),
    st.integers(0, 29),
)
def test_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    result = split_text(text, size, overlap, SEPARATORS)
    assert all(0 < len(piece) <= size and piece == piece.strip() for piece in result)
    # Every character that is not white space is in some piece, in order.
    squeezed = "".join(text.split())
    rest = "".join("".join(result).split())
    position = 0
    for char in rest:
        if position < len(squeezed) and char == squeezed[position]:
            position += 1
    assert position == len(squeezed)


TEXTS = ["", "  ", "short", "a b " * 100, "x" * 333, " lead and trail ", "żółć " * 60]


@pytest.mark.parametrize("size, overlap", [(100, 20), (50, 0), (30, 29)])
def test_closed_form_equals_the_loop(frame, size, overlap):
    df = frame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", pieces(F.col("t"), size, overlap, ("",)).alias("p")).collect()
    assert [r.p for r in sorted(got)] == [split_text(t, size, overlap, ("",)) for t in TEXTS]


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, -1), (10, 10)])
def test_bad_settings(frame, size, overlap):
    with pytest.raises(ValueError):
        split_documents(frame([(1, "x")], "doc_id long, text string"), size, overlap)


def test_chunks_inherit_columns(frame):
    df = frame([(7, "en", "aaaa bbbb cccc"), (8, "de", " ")], "doc_id long, lang string, text string")
    rows = split_documents(df, 10, 0).orderBy("chunk_pos").collect()
    assert [(r.doc_id, r.lang, r.chunk_pos, r.text) for r in rows] == [
        (7, "en", 0, "aaaa bbbb"),
        (7, "en", 1, "cccc"),
    ]


def test_chunk_ids_run_over_all_documents(frame):
    docs = [(i, f"s{i % 3}", "word " * (i * 7 % 50)) for i in range(200)]
    df = frame(docs, "doc_id long, source string, text string").repartition(5)
    rows = number_chunks(df, ["source", "doc_id"], 40, 8, first_id=10).orderBy("chunk_id").collect()
    expected = [
        (source, doc_id, pos, piece)
        for doc_id, source, text in sorted(docs, key=lambda d: (d[1], d[0]))
        for pos, piece in enumerate(split_text(text, 40, 8, SEPARATORS))
    ]
    assert [(r.source, r.doc_id, r.chunk_pos, r.text) for r in rows] == expected
    assert [r.chunk_id for r in rows] == list(range(10, 10 + len(expected)))


def test_numbering_moves_no_text(spark, frame):
    docs = [(i, f"s{i % 3}", "word " * (i % 9)) for i in range(200)]
    numbered = number_chunks(frame(docs, "doc_id long, source string, text string").repartition(5), ["doc_id"], 40, 8)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    texts, narrow = plan.split("FileScan", 1)[0], plan.split("FileScan", 1)[1]
    # From the scan of the texts to the chunks nothing is exchanged; the other scans read no text.
    assert "Exchange" not in texts and "Exchange" in narrow and "ShuffledHashJoin" in texts
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert [("text#" in scan.split("Batched")[0]) for scan in scans] == [True] + [False] * (len(scans) - 1)
    # An array goes with a block, not with every chunk.
    assert "Generate posexplode" in plan and "_firsts" not in plan.split("Generate posexplode")[1].splitlines()[0]
    assert not any(t.name.startswith("tarnsearch_") for t in spark.catalog.listTables())


def test_numbering_nothing(frame):
    assert number_chunks(frame([], "doc_id long, text string"), ["doc_id"]).count() == 0
    assert number_chunks(frame([(1, None), (2, " ")], "doc_id long, text string"), ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SAMPLE_CORPUS), reason="sample corpus not there")
def test_sample_corpus(spark):
    """Known chunk counts of four text files, in name order."""
    assert len(glob.glob(f"{SAMPLE_CORPUS}/*.txt")) == 4
    chunks = number_chunks(load_documents(spark, SAMPLE_CORPUS), ["source_path"])
    per_file = chunks.groupBy("source_path").agg(
        F.count("*").alias("n"),
        F.min("chunk_id").alias("first"),
        F.max("chunk_id").alias("last"),
        F.max(F.length("text")).alias("longest"),
    )
    got = [(r.n, r.first, r.last, r.longest) for r in per_file.orderBy("source_path").collect()]
    assert got == [(21, 0, 20, 998), (39, 21, 59, 991), (47, 60, 106, 999), (23, 107, 129, 996)]
