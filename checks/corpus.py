"""Scans, chunking, sinks and the stored index."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import functions as F

from checks.registry import EMBEDDER, documents, query, table
from checks.sql import PATH, POSTINGS, fixed_chunks, recursive_chunks, strip, with_
from tarnsearch.functions.text import MARKDOWN_STEPS, html_to_text, markdown_to_text
from tarnsearch.operators.chunking import number_chunks, split_documents
from tarnsearch.operators.manifest import content_manifest, file_manifest
from tarnsearch.plans.index import build_index, make_settings, open_index
from tarnsearch.plans.work import work_folder
from tarnsearch.sources.files import (
    check_documents,
    list_files,
    load_documents,
    suffix_of,
    tag_source,
)
from tarnsearch.sources.folder import load_files
from tarnsearch.sources.tables import (
    read_chunks,
    read_manifest,
    write_chunks,
    write_manifest,
)

FIXED = {"size": 1000, "overlap": 200, "separators": ("",)}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str, steps) -> str:
    for pattern, replacement in steps:
        rewritten = replacement.replace("$", "\\")
        column = f"regexp_replace({column}, {_quote(pattern)}, {_quote(rewritten)}, 'g')"
    return column


# The entities that the pages hold.
_PAGE_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·"}


def _html_sql(column: str) -> str:
    text = f"regexp_replace({column}, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style"):
        text = f"regexp_replace({text}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gsi')"
    text = f"regexp_replace({text}, '<[^>]+>', chr(10), 'g')"
    for entity, char in _PAGE_ENTITIES.items():
        text = f"replace({text}, {_quote(entity)}, {_quote(char)})"
    text = f"regexp_replace(replace({text}, '&amp;', '&'), '[\\x09\\x0C\\x0D ]+', ' ', 'g')"
    return strip(f"regexp_replace({text}, ' ?\\x0A[\\x0A ]*', chr(10), 'g')")


@query("html_to_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html(spark, folder):
    return table(spark, folder, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


_AS_MARKDOWN = (
    "'## ' || role || chr(10) || chr(10) || '> **' || conv_id || '** [turn](#t) `' || turn || '`' "
    "|| chr(10) || chr(10) || '- ' || text"
)


@query(
    "load_markdown",
    f"""SELECT conv_id, turn, {strip(_replaced(f'({_AS_MARKDOWN})', MARKDOWN_STEPS))} AS text
    FROM conversations""",
)
def markdown(spark, folder):
    """Conversations set as Markdown, read back as plain text."""
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", markdown_to_text(F.expr(_AS_MARKDOWN)).alias("text"))


def _files_by_source(spark, folder) -> str:
    """The documents as text files, several files per source."""
    root = work_folder(spark, "files")
    docs = table(spark, folder, "documents").select("text", "source")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(root)
    return root


def _source():
    return F.regexp_extract("source_path", r"source=([^/]+)/", 1).alias("source")


@query(
    "file_listing",
    """SELECT source, '.txt' AS suffix, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
    FROM documents GROUP BY source""",
)
def file_listing(spark, folder):
    files = list_files(spark, _files_by_source(spark, folder))
    return files.groupBy(_source(), "suffix").agg(F.sum("size").alias("size"))


@query(
    "load_text",
    """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines
    FROM documents GROUP BY source""",
)
def load_text(spark, folder):
    loaded = load_documents(spark, _files_by_source(spark, folder))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return loaded.groupBy(_source()).agg(
        F.sum(F.length("text")).alias("n_chars"), F.sum(lines).alias("n_lines")
    )


@query("tag_source", f"SELECT doc_id, {PATH} AS source_path, lang FROM documents")
def tag(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return tag_source(docs, path).select("doc_id", "source_path", "lang")


@query(
    "quarantine_docs",
    r"""WITH named AS (
      SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)) AS suffix
      FROM pages)
    SELECT page_id, suffix, 'unsupported format' AS error FROM named WHERE suffix <> '.html'""",
)
def quarantine(spark, folder):
    """Pages whose address does not end like a readable file."""
    pages = table(spark, folder, "pages")
    named = pages.withColumn("suffix", suffix_of(F.regexp_replace("url", r"[?#].*$", "")))
    checked = check_documents(named, text_col="html", suffix_col="suffix")
    return checked.filter("error IS NOT NULL").select("page_id", "suffix", "error")


@query(
    "chunk_documents",
    "WITH RECURSIVE "
    + recursive_chunks(1000, 200).strip()
    + """ SELECT doc_id, source_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, s) - 1 AS INTEGER) AS chunk_pos,
    text FROM cut WHERE text <> ''""",
)
def chunk_documents(spark, folder):
    return split_documents(documents(spark, folder))


@query(
    "chunk_chars",
    with_(fixed_chunks(1000, 200)) + "SELECT doc_id, source_path, chunk_pos, text FROM fixed",
)
def chunk_chars(spark, folder):
    return split_documents(documents(spark, folder), **FIXED)


@query(
    "chunk_ids",
    with_(fixed_chunks(300, 50)) + "SELECT chunk_id, doc_id, source_path, chunk_pos, text FROM fixed",
)
def chunk_ids(spark, folder):
    return number_chunks(
        documents(spark, folder), ["source_path", "doc_id"], size=300, overlap=50, separators=("",)
    )


@query(
    "chunks_roundtrip",
    with_(fixed_chunks(1000, 200))
    + "SELECT chunk_id, source_path, text FROM fixed",
)
def chunks_roundtrip(spark, folder):
    path = work_folder(spark, "chunk-lines")
    write_chunks(number_chunks(documents(spark, folder), ["source_path", "doc_id"], **FIXED), path)
    return read_chunks(spark, path, ["source_path"])


MANIFEST_SQL = f"""SELECT {PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256
    FROM documents"""


@query("manifest_roundtrip", MANIFEST_SQL)
def manifest_roundtrip(spark, folder):
    path = work_folder(spark, "manifest")
    write_manifest(content_manifest(documents(spark, folder), F.col("source_path")), path)
    return read_manifest(spark, path).drop("modified")


def fixed_index(spark, docs, label: str = "index"):
    settings = make_settings(EMBEDDER, 1000, 200, ("",))
    return build_index(docs, work_folder(spark, label), EMBEDDER, settings)


INDEX_SIZES = f"""
chunks AS (SELECT chunk_id, source_path, text FROM fixed),
{POSTINGS.strip()}
SELECT 'chunks' AS name, count(*) AS n FROM chunks
UNION ALL SELECT 'vectors', count(*) FROM chunks
UNION ALL SELECT 'postings', count(*) FROM postings
UNION ALL SELECT 'terms', count(*) FROM terms
UNION ALL SELECT 'tokens', CAST(sum(chunk_len) AS BIGINT) FROM chunk_len
UNION ALL SELECT 'manifest', count(*) FROM documents"""


def index_sizes(index):
    """Rows of every table of an index, and all its tokens."""
    named = {
        "chunks": index.chunks,
        "vectors": index.vectors,
        "postings": index.postings,
        "terms": index.terms,
        "manifest": index.manifest,
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in named.items()]
    counts.append(index.chunk_stats.agg(F.sum("chunk_len").alias("n")).select(F.lit("tokens").alias("name"), "n"))
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


@query("build_index", with_(fixed_chunks(1000, 200), INDEX_SIZES))
def build(spark, folder):
    index = fixed_index(spark, documents(spark, folder))
    return index_sizes(open_index(spark, index.root))



def _folder_of_files(spark, folder) -> str:
    """Every document as a file of its own. Of fifty, one is empty and one has bytes that are not UTF-8."""
    root = work_folder(spark, "folder")
    place = root.removeprefix("file://")

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{place}/{row['source_path']}"
                content = {0: b"", 1: b"\xff\xfe" + row["text"].encode()}.get(row["doc_id"] % 50, row["text"].encode())
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")], ["doc_id"])

    documents(spark, folder).mapInArrow(write, "doc_id bigint").agg(F.count("*")).collect()
    return root


_FILES = f"""
files AS (
  SELECT {PATH} AS path, doc_id % 50 AS kind, text FROM documents)"""


@query(
    "file_manifest",
    with_(_FILES)
    + """SELECT path, CASE kind WHEN 0 THEN 0 WHEN 1 THEN strlen(text) + 2 ELSE strlen(text) END AS size,
    CASE kind WHEN 0 THEN sha256('') WHEN 1 THEN sha256('\\xFF\\xFE'::BLOB || encode(text)) ELSE sha256(text) END AS sha256
    FROM files""",
)
def file_manifest_of_folder(spark, folder):
    return file_manifest(spark, _folder_of_files(spark, folder)).select("path", "size", "sha256")


@query(
    "load_files",
    with_(_FILES)
    + """SELECT path AS source_path, '.txt' AS suffix, CASE kind WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS text,
    CASE WHEN kind = 1 THEN 'cannot be decoded' END AS error FROM files""",
)
def load_folder(spark, folder):
    """A row per file: empty ones are empty texts, and those that are no text have their reason."""
    return load_files(spark, _folder_of_files(spark, folder), charsets=()).select("source_path", "suffix", "text", "error")
