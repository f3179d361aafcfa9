"""Manifests, incremental refresh and streams.

The saved snapshot is the documents table. In the current one the documents labelled
toxic are gone, those labelled of good quality have another ending, and every page has
come as a new document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.corpus import INDEX_SIZES, MANIFEST_SQL, fixed_index, index_sizes
from checks.registry import EMBEDDER, documents, query, table
from checks.retrieval import HYBRID_COLUMNS, HYBRID_PARTS
from checks.sql import IDF, PATH, POSTINGS, QUESTIONS, fixed_chunks, with_
from tarnsearch.functions.vectors import rounded
from tarnsearch.operators import bm25, manifest, manifest_tree
from tarnsearch.plans.index import make_settings, open_index, refresh_index
from tarnsearch.plans.work import work_folder
from tarnsearch.streaming.ingest import ingest
from tarnsearch.streaming.retrieve import answer_stream

CURRENT = """
current_docs AS (
  SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN d.text || ' Updated.' ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0
  UNION ALL SELECT -1 - page_id, 'pages', html FROM pages)"""
SNAPSHOTS = f"""
saved AS ({MANIFEST_SQL}),
{CURRENT.strip()},
now AS (SELECT {PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM current_docs)"""


def current_documents(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    labels = table(spark, folder, "labels")
    text = F.when(F.col("quality") == 1, F.concat("text", F.lit(" Updated."))).otherwise(F.col("text"))
    kept = docs.join(labels, "doc_id", "left").filter("coalesce(toxic, 0) = 0")
    pages = table(spark, folder, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.lit("pages").alias("source"), F.col("html").alias("text")
    )
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    everything = kept.select("doc_id", "source", text.alias("text")).unionByName(pages)
    return everything.select("doc_id", path.alias("source_path"), "text")


def _snapshots(spark, folder) -> tuple[DataFrame, DataFrame]:
    path = F.col("source_path")
    return (
        manifest.content_manifest(documents(spark, folder), path),
        manifest.content_manifest(current_documents(spark, folder), path),
    )


@query("content_manifest", MANIFEST_SQL)
def content_manifest(spark, folder):
    return _snapshots(spark, folder)[0]


@query("manifest_added", with_(SNAPSHOTS) + "SELECT * FROM now WHERE path NOT IN (SELECT path FROM saved)")
def added(spark, folder):
    return manifest.added(*_snapshots(spark, folder))


@query("manifest_removed", with_(SNAPSHOTS) + "SELECT * FROM saved WHERE path NOT IN (SELECT path FROM now)")
def removed(spark, folder):
    return manifest.removed(*_snapshots(spark, folder))


@query(
    "manifest_changed",
    with_(SNAPSHOTS) + "SELECT now.* FROM now JOIN saved USING (path) WHERE now.sha256 <> saved.sha256",
)
def changed(spark, folder):
    return manifest.changed(*_snapshots(spark, folder))


DIFF = """
diff AS (
  SELECT coalesce(s.path, n.path) AS path,
         CASE WHEN s.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS status
  FROM saved s FULL JOIN now n ON s.path = n.path WHERE s.sha256 IS DISTINCT FROM n.sha256)"""


@query("manifest_diff_files", with_(SNAPSHOTS, DIFF) + "SELECT path, status FROM diff")
def diff_files(spark, folder):
    return manifest.diff_files(*_snapshots(spark, folder))


@query("manifest_tree_diff", with_(SNAPSHOTS, DIFF) + "SELECT path, status FROM diff")
def tree_diff(spark, folder):
    """The same by way of the stored manifest's tree of digests."""
    saved, now = _snapshots(spark, folder)
    path = work_folder(spark, "manifest-tree")
    manifest_tree.write_tree(saved, path, buckets=256)
    return manifest_tree.diff(manifest_tree.open_tree(spark, path), now)


@query(
    "manifest_reasons",
    with_(SNAPSHOTS, DIFF)
    + """SELECT status, path, count(*) OVER (PARTITION BY status) AS n_files,
    status || ' source file: ' || path AS reason FROM diff""",
)
def reasons(spark, folder):
    return manifest.reasons(manifest.diff_files(*_snapshots(spark, folder)))


@query(
    "incremental_refresh",
    with_(
        CURRENT,
        fixed_chunks(1000, 200, "current_docs"),
        "chunks AS (SELECT chunk_id, source_path, text FROM fixed)",
        POSTINGS,
        IDF,
    )
    + "SELECT term, df, round(idf, 6) AS idf FROM idf",
)
def incremental_refresh(spark, folder):
    """Term statistics after a refresh; they must be those of an index built anew."""
    index = fixed_index(spark, documents(spark, folder), "refreshed")
    index = refresh_index(index, current_documents(spark, folder), EMBEDDER)
    totals = bm25.corpus_totals(index.chunks, index.terms).first()
    return bm25.idf(index.terms, totals).withColumn("idf", rounded(F.col("idf")))


def _stream(spark, folder, name):
    """A table as a stream of its files. A stream reads folders: one of the table's own, or, where the table is a
    single file, the one around it."""
    path = f"{folder}/{name}.parquet"
    stored = spark.read.parquet(path)
    files = spark.readStream.schema(stored.schema)
    if all(file.endswith(f"/{name}.parquet") for file in stored.inputFiles()):
        return files.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return files.parquet(path)


@query("stream_ingest", with_(fixed_chunks(1000, 200), INDEX_SIZES))
def stream_ingest(spark, folder):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = _stream(spark, folder, "documents").select("doc_id", path.alias("source_path"), "text")
    root = work_folder(spark, "streamed")
    running = ingest(
        docs,
        root,
        EMBEDDER,
        work_folder(spark, "ingest-checkpoint"),
        "documents",
        make_settings(EMBEDDER, 1000, 200, ("",)),
    )
    running.awaitTermination()
    return index_sizes(open_index(spark, root))


@query(
    "stream_retrieve",
    with_(
        fixed_chunks(1000, 200),
        "chunks AS (SELECT chunk_id, source_path, text FROM fixed)",
        QUESTIONS,
        *HYBRID_PARTS,
    )
    + HYBRID_COLUMNS,
)
def stream_retrieve(spark, folder):
    index = fixed_index(spark, documents(spark, folder), "asked")
    asked = _stream(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    output = work_folder(spark, "streamed-answers")
    answer_stream(
        asked, index.root, EMBEDDER, output, work_folder(spark, "answer-checkpoint")
    ).awaitTermination()
    answered = spark.read.parquet(output).drop("batch")
    return answered.withColumn("rrf_score", F.round("rrf_score", 9))
