"""A folder of files as a Spark data source that loses none of them.

Spark's own file sources pass over empty files, and one that cannot be read ends the job. Here every
file is a row: with its content, its SHA-256, or the reason there is neither. Folders are listed inside the
tasks: the driver opens folders only until there are enough of them for a task each. As a stream the
source delivers files by the time of their last change.

Paths are what Arrow's file systems reach: local and mounted folders, HDFS, S3, Google storage.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarnsearch.sources import files

FORMAT = "tarnsearch_folder"
ROWS = "path STRING, size BIGINT, modified TIMESTAMP, sha256 STRING, content BINARY, error STRING"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("size", pa.int64()),
        ("modified", pa.timestamp("us", tz="UTC")),
        ("sha256", pa.string()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
CANNOT_BE_READ = "cannot be read"
READ_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
FOLDERS = 64  # that the driver looks for, level by level, before it leaves the listing to tasks


@dataclass
class Part(InputPartition):
    """A folder, with everything below it or only its own files, changed after ``since`` up to ``until``."""

    folder: str
    deep: bool
    since: int | None = None
    until: int | None = None


def _flag(options: dict[str, str], name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.contents = _flag(options, "contents", False)
        self.digests = _flag(options, "digests", True)
        self.folders = int(options.get("folders", FOLDERS))

    def open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def parts(self, since: int | None = None, until: int | None = None) -> list[Part]:
        """Folders to be listed by a task each; raises where there is no such root."""
        system, base = self.open()
        whole, level = [], [base]
        own: list[str] = []
        while level and len(level) + len(whole) < self.folders:
            deeper = []
            for folder in level:
                try:
                    inside = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory]
                except OSError:
                    if folder == base:
                        raise
                    inside = []
                own.append(folder)
                deeper += inside
            level = deeper
        whole += level
        return [Part(f, False, since, until) for f in own] + [Part(f, True, since, until) for f in whole]

    def listed(self, system: fs.FileSystem, part: Part) -> Iterator[fs.FileInfo | str]:
        """Files of a part in order of their paths; the path alone of a folder that cannot be listed."""
        waiting = [part.folder]
        while waiting:
            folder = waiting.pop()
            try:
                inside = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path)
            except OSError:
                yield folder
                continue
            for info in inside:
                if info.type == fs.FileType.Directory:
                    if part.deep:
                        waiting.append(info.path)
                elif info.path.lower().endswith(self.suffixes or ("",)):
                    changed = info.mtime_ns or 0
                    if (part.since is None or changed > part.since) and (part.until is None or changed <= part.until):
                        yield info

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, base = self.open()
        rows, held = [], 0
        for info in self.listed(system, part):
            if isinstance(info, str):
                rows.append((info[len(base) + 1 :], None, None, None, None, CANNOT_BE_READ))
                continue
            size, digest, content, error = info.size or 0, None, None, None
            if self.contents or self.digests:
                try:
                    size, digest, content = self._content(system, info.path)
                except OSError:
                    error = CANNOT_BE_READ
            changed = None if info.mtime_ns is None else info.mtime_ns // 1000
            rows.append((info.path[len(base) + 1 :], size, changed, digest, content, error))
            held += len(content or b"") + 200
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _content(self, system: fs.FileSystem, path: str) -> tuple[int, str | None, bytes | None]:
        """Size, digest and, if wanted, bytes; else no more than ``READ_BYTES`` are held."""
        digest, parts, size = hashlib.sha256(), [], 0
        with system.open_input_stream(path) as stream:
            while data := stream.read(READ_BYTES):
                size += len(data)
                digest.update(data)
                if self.contents:
                    parts.append(data)
        return size, digest.hexdigest(), b"".join(parts) if self.contents else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.parts()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class FolderStream(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds. Files younger than ``settle`` seconds wait for the next batch,
    so that one with the same time as the last delivered is not overlooked."""

    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)
        self.settle = float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.folder.parts(start["until"], end["until"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class FolderSource(DataSource):
    """``spark.read.format("tarnsearch_folder").option("path", root)``; options: ``suffixes`` (comma-joined, any
    case), ``contents``, ``digests``, ``folders``, and ``settle`` for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


def _options(root: str, suffixes: Sequence[str] | None, contents: bool, digests: bool) -> dict[str, str]:
    return {
        "path": root,
        "suffixes": ",".join(suffixes or ()),
        "contents": str(contents),
        "digests": str(digests),
    }


def read_folder(
    spark: SparkSession, root: str, suffixes: Sequence[str] | None = None, contents: bool = False, digests: bool = True
) -> DataFrame:
    """Every file below ``root``: path relative to it, size, time of change, SHA-256, content, error."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FORMAT).options(**_options(root, suffixes, contents, digests)).load()


def stream_folder(
    spark: SparkSession, root: str, suffixes: Sequence[str] | None = None, contents: bool = True, settle: float = 1.0
) -> DataFrame:
    """The same as a stream: files appear when they are new or have changed."""
    spark.dataSource.register(FolderSource)
    options = _options(root, suffixes, contents, True) | {"settle": str(settle)}
    return spark.readStream.format(FORMAT).options(**options).load()


def load_files(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = files.SUFFIXES,
    charsets: Sequence[str] = files.CHARSETS,
) -> DataFrame:
    """One row per file, like ``files.scan_files``; empty files are empty texts, and what cannot be read is a row
    with its ``error`` instead of the end of the job. ``source_path`` is relative to the root."""
    return files.as_texts(read_folder(spark, root, suffixes, contents=True, digests=False), charsets)
