"""Read folders of text, Markdown and HTML files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.functions.charsets import MIN_CONFIDENCE, detect
from tarnsearch.functions.text import html_to_text, markdown_to_text, unix_newlines

# Suffixes a corpus may hold. The last two are listed and
# quarantined: no reader for them is part of Spark.
TEXT = (".txt",)
MARKDOWN = (".md",)
HTML = (".html", ".htm")
UNSUPPORTED = (".pdf", ".docx")
SUFFIXES = TEXT + MARKDOWN + HTML + UNSUPPORTED

# What files that are not UTF-8 may be written in; of equally plausible ones the first is taken.
CHARSETS = ("cp1250", "iso-8859-2", "iso-8859-1")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _any_case_glob(suffixes: Sequence[str]) -> str:
    """``.md`` becomes ``*.[mM][dD]``: the glob filter itself is case-sensitive."""
    letters = (
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
        for suffix in suffixes
    )
    return "*{" + ",".join(letters) + "}"


def _binary_files(spark: SparkSession, root: str, suffixes: Sequence[str] | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", _any_case_glob(suffixes))
    return reader.load(root)


def list_files(
    spark: SparkSession, root: str, suffixes: Sequence[str] | None = SUFFIXES
) -> DataFrame:
    """Files below ``root`` with one of the suffixes, any case (``None``: every file).

    No file is opened. A missing root raises. Spark's file sources pass over files of
    no bytes at all; they would give no chunk.
    """
    return _binary_files(spark, root, suffixes).select(
        F.col("path").alias("source_path"),
        suffix_of(F.col("path")).alias("suffix"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def _decoder(charsets: Sequence[str], min_confidence: float):
    def decode(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            rows = []
            for data in batch:
                charset, sure = (None, None) if data is None else detect(data, charsets)
                text = data.decode(charset) if charset is not None and sure >= min_confidence else None
                rows.append((text, charset, sure))
            yield pd.DataFrame(rows, columns=["text", "charset", "confidence"])

    return F.pandas_udf(decode, "text string, charset string, confidence double")


def decoded(content: Column, charsets: Sequence[str] = CHARSETS, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """``(text, charset, confidence)`` of a byte column. UTF-8 is taken as it is, in the JVM; other bytes are read in the
    most plausible of ``charsets``, and have no text where that is less plausible than ``min_confidence``."""
    as_utf8 = content.cast("string")
    is_utf8 = F.is_valid_utf8(as_utf8)
    other = _decoder(charsets, min_confidence)(F.when(~is_utf8, content))
    plain = F.struct(as_utf8.alias("text"), F.lit("utf-8").alias("charset"), F.lit(1.0).alias("confidence"))
    return F.when(content.isNull(), F.lit(None)).when(is_utf8, plain).otherwise(other)


def decode_bytes(content: Column, charsets: Sequence[str] = CHARSETS) -> Column:
    """Text of a byte column; only what is not UTF-8 is decoded in Python."""
    return decoded(content, charsets)["text"]


def as_texts(found: DataFrame, charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Rows ``(path, size, modified, content, error)`` with the plain text of the content, or a reason in ``error``;
    ``charset`` and ``confidence`` say how it was read."""
    files = found.withColumn("suffix", suffix_of(F.col("path")))
    suffix = F.col("suffix")
    supported = ~F.coalesce(suffix.isin(*UNSUPPORTED), F.lit(False))
    read = files.withColumn("read", decoded(F.when(supported, F.col("content")), charsets))
    return read.withColumn("raw", unix_newlines(F.col("read.text"))).select(
        F.col("path").alias("source_path"),
        "suffix",
        "size",
        "modified",
        F.when(suffix.isin(*MARKDOWN), markdown_to_text(F.col("raw")))
        .when(suffix.isin(*HTML), html_to_text(F.col("raw")))
        .otherwise(F.col("raw"))
        .alias("text"),
        "read.charset",
        "read.confidence",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~supported, "unsupported format")
        .when(F.col("raw").isNull(), "cannot be decoded")
        .alias("error"),
    )


def scan_files(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = SUFFIXES,
    charsets: Sequence[str] = CHARSETS,
) -> DataFrame:
    """One row per file with its plain text, or the reason there is none in ``error``.

    Read by Spark's own reader, which reaches every store Spark does, but passes over empty files and ends the
    job at one that cannot be read; ``sources.folder.load_files`` keeps both as rows.
    """
    files = _binary_files(spark, root, suffixes)
    found = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return as_texts(found.withColumn("error", F.lit(None).cast("string")), charsets)


def load_documents(spark: SparkSession, root: str, **options) -> DataFrame:
    """Readable files as documents; the path is the document's identity."""
    return readable(scan_files(spark, root, **options)).select(
        F.col("source_path").alias("doc_id"), "source_path", "text"
    )


def readable(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error IS NULL").drop("error")


def quarantined(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error IS NOT NULL").drop("text")


def check_documents(
    documents: DataFrame, text_col: str = "text", suffix_col: str | None = None
) -> DataFrame:
    """The same split for a table: an ``error`` column naming what is wrong with a row."""
    text = F.col(text_col)
    error = F.when(text.isNull(), "cannot be read").when(
        ~F.is_valid_utf8(text) | text.contains("\ufffd"), "cannot be decoded"
    )
    if suffix_col is not None:
        readable_suffix = F.col(suffix_col).isin(*TEXT, *MARKDOWN, *HTML)
        error = F.when(~readable_suffix, "unsupported format").otherwise(error)
    return documents.withColumn("error", error)


def tag_source(documents: DataFrame, source: Column) -> DataFrame:
    return documents.withColumn("source_path", source)
