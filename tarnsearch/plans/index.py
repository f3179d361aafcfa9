"""A stored index: build it, open it, bring it up to date.

Below one root every table is written per version, and a row in ``versions`` makes a
version visible after all its tables are there. A refresh writes only what changed:
new chunks with their vectors and postings, and the ids of chunks that are gone.
Readers of an older version are not disturbed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.operators import bm25, dense, manifest
from tarnsearch.operators.chunking import number_chunks
from tarnsearch.operators.embedding import Embedder, embed
from tarnsearch.params import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    SEPARATORS,
    check_chunking,
    check_metric,
)
from tarnsearch.plans.hybrid import Corpus
from tarnsearch.plans.work import materialize

VERSIONS = (
    "version INT, base INT, created_at TIMESTAMP, next_chunk_id BIGINT, "
    "stream STRING, batch BIGINT, chunk_size INT, chunk_overlap INT, "
    "separators ARRAY<STRING>, embedding STRING, dim INT, normalize BOOLEAN, metric STRING"
)


@dataclass(frozen=True)
class Settings:
    """What an index was built with; every later version must agree."""

    chunk_size: int
    chunk_overlap: int
    separators: Sequence[str]
    embedding: str
    dim: int
    normalize: bool
    metric: str


def make_settings(
    embedder: Embedder,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    metric: str = "ip",
) -> Settings:
    check_chunking(chunk_size, chunk_overlap, separators)
    return Settings(
        chunk_size,
        chunk_overlap,
        tuple(separators),
        embedder.name,
        embedder.dim,
        embedder.normalize,
        check_metric(metric),
    )


@dataclass(frozen=True)
class Index:
    """One version of a stored index."""

    spark: SparkSession
    root: str
    version: int
    base: int
    next_chunk_id: int
    settings: Settings

    def _upto(self, table: str) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.root}/{table}")
        return stored.filter(F.col("version").between(self.base, self.version)).drop("version")

    def _live(self, table: str) -> DataFrame:
        rows = self._upto(table)
        if self.version == self.base:
            return rows
        return rows.join(self._upto("tombstones"), "chunk_id", "left_anti")

    def _whole(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/version={self.version}")

    @property
    def chunks(self) -> DataFrame:
        return self._live("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self._live("vectors")

    @property
    def postings(self) -> DataFrame:
        return self._live("postings")

    @property
    def terms(self) -> DataFrame:
        return self._whole("terms")

    @property
    def manifest(self) -> DataFrame:
        return self._whole("manifest")

    @property
    def chunk_stats(self) -> DataFrame:
        """Tokens per chunk; those without any are in no posting and have 0."""
        counted = self.postings.groupBy("chunk_id").agg(F.first("chunk_len").alias("chunk_len"))
        return (
            self.chunks.select("chunk_id")
            .join(counted, "chunk_id", "left")
            .select("chunk_id", F.coalesce("chunk_len", F.lit(0)).alias("chunk_len"))
        )

    def corpus(self, embedder: Embedder) -> Corpus:
        check_embedder(self.settings, embedder)
        return Corpus(
            self.chunks, self.vectors, self.postings, self.terms, embedder, self.settings.metric
        )


def check_embedder(settings: Settings, embedder: Embedder) -> None:
    have = (settings.embedding, settings.dim, settings.normalize)
    if have != (embedder.name, embedder.dim, embedder.normalize):
        raise ValueError(f"index was built with embedding {have}, asked to use {embedder.name}")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Index | None:
    """The newest version, or the given one; None if nothing was published."""
    known = _versions(spark, root)
    if version is not None:
        known = known.filter(F.col("version") == version)
    row = known.orderBy(F.desc("version")).first()
    if row is None:
        return None
    fields = row.asDict()
    settings = {name: fields[name] for name in Settings.__dataclass_fields__}
    settings["separators"] = tuple(settings["separators"])
    return Index(
        spark, root, row["version"], row["base"], row["next_chunk_id"], Settings(**settings)
    )


def _document_manifest(documents: DataFrame) -> DataFrame:
    """A document changes with its text and with its path: chunks carry both."""
    entries = manifest.content_manifest(
        documents.withColumn("_whole", F.concat_ws("\n", "source_path", "text")),
        F.col("doc_id").cast("string"),
        "_whole",
    )
    return entries


def _check_ids(now: DataFrame) -> None:
    repeated = now.groupBy("path").count().filter("count > 1 OR path IS NULL").head(1)
    if repeated:
        raise ValueError(f"documents need one doc_id each, found again or null: {repeated[0]['path']}")


def _write(df: DataFrame, root: str, table: str, version: int) -> DataFrame:
    # Overwriting makes a retry after a crash start from nothing.
    path = f"{root}/{table}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_chunks(
    documents: DataFrame, root: str, version: int, settings: Settings, embedder: Embedder, first_id: int
) -> tuple[DataFrame, int]:
    """Chunks, vectors and postings of some documents; the postings and the next free id."""
    numbered = number_chunks(
        documents.select("doc_id", "source_path", "text"),
        ["source_path", "doc_id"],
        settings.chunk_size,
        settings.chunk_overlap,
        settings.separators,
        first_id=first_id,
    )
    chunks = _write(numbered, root, "chunks", version)
    # Ids are dense by construction; rows are checked in the pass that embeds them.
    _write(dense.checked_rows(embed(chunks, embedder), embedder.dim), root, "vectors", version)
    counted = _write(bm25.postings(chunks), root, "postings", version)
    last = chunks.agg(F.max("chunk_id")).first()[0]
    return counted, first_id if last is None else last + 1


def _publish(
    spark: SparkSession,
    root: str,
    version: int,
    base: int,
    next_chunk_id: int,
    settings: Settings,
    stream: str | None,
    batch: int | None,
) -> Index:
    row = {
        "version": version,
        "base": base,
        "created_at": datetime.now(timezone.utc),
        "next_chunk_id": next_chunk_id,
        "stream": stream,
        "batch": batch,
        **asdict(settings),
        "separators": list(settings.separators),
    }
    spark.createDataFrame([row], VERSIONS).write.mode("append").parquet(f"{root}/versions")
    return Index(spark, root, version, base, next_chunk_id, settings)


def build_index(
    documents: DataFrame,
    root: str,
    embedder: Embedder,
    settings: Settings | None = None,
    stream: str | None = None,
    batch: int | None = None,
) -> Index:
    """Index ``(doc_id, source_path, text)`` from scratch as the next version under ``root``."""
    spark = documents.sparkSession
    settings = settings or make_settings(embedder)
    check_embedder(settings, embedder)
    before = open_index(spark, root)
    version = 1 if before is None else before.version + 1
    now = _write(_document_manifest(documents), root, "manifest", version)
    _check_ids(now)
    counted, next_id = _write_chunks(documents, root, version, settings, embedder, 0)
    _write(spark.createDataFrame([], "chunk_id BIGINT"), root, "tombstones", version)
    _write(bm25.term_stats(counted), root, "terms", version)
    return _publish(spark, root, version, version, next_id, settings, stream, batch)


def refresh_index(
    index: Index,
    documents: DataFrame,
    embedder: Embedder,
    settings: Settings | None = None,
    remove_missing: bool = True,
    stream: str | None = None,
    batch: int | None = None,
) -> Index:
    """The next version, holding ``documents`` as they are now.

    Only documents whose text or path differs are split, embedded and counted. A stream's
    batch that differs in nothing makes no version. Repeated doc_ids raise. With
    ``remove_missing=False`` documents that are not given stay in the index. ``index``
    must be the newest version, and one writer publishes at a time.
    """
    settings = settings or index.settings
    if settings != index.settings:
        raise ValueError(f"index was built with {index.settings}; build it anew for {settings}")
    check_embedder(settings, embedder)
    spark, root, version = index.spark, index.root, index.version + 1

    now = materialize(_document_manifest(documents), "manifest")
    _check_ids(now)
    diff = manifest.diff_files(index.manifest, now)
    if not remove_missing:
        diff = diff.filter("status <> 'removed'")
    diff = materialize(diff, "diff")
    if stream is not None and not diff.head(1):
        return index
    fresh = diff.filter("status <> 'removed'").select("path")
    stale = diff.filter("status <> 'new'").select("path")
    path = F.col("doc_id").cast("string")

    to_index = documents.join(fresh, path == fresh["path"], "left_semi")
    gone = index.chunks.join(stale, path == stale["path"], "left_semi").select("chunk_id")
    gone = _write(gone, root, "tombstones", version)
    lost = bm25.term_stats(index.postings.join(gone, "chunk_id", "left_semi"))
    counted, next_id = _write_chunks(
        to_index, root, version, settings, embedder, index.next_chunk_id
    )
    deltas = index.terms.unionByName(bm25.term_stats(counted)).unionByName(
        lost.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    )
    terms = deltas.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    _write(terms.filter("df > 0"), root, "terms", version)
    if not remove_missing:
        now = now.unionByName(manifest.removed(index.manifest, now))
    _write(now, root, "manifest", version)
    return _publish(spark, root, version, index.base, next_id, settings, stream, batch)
