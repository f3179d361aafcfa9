"""Size checks and tables written between two stages of a job."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tarnsearch.params import BROADCAST_ROWS


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows, counting no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out before costly work on each of them: over all cores, or as many partitions as the session
    has for shuffles, which is what is set by volume.

    The number is given, because small rows would otherwise be gathered into few tasks.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, shuffled), *keys)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tarnsearch-")


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is named and everything runs on this machine, as in tests, is it
    a folder of our own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/tarnsearch/{label}-{uuid.uuid4().hex}"


def _grouped(group_rows: int | None) -> dict[str, int]:
    return {"parquet.block.row.count.limit": group_rows} if group_rows else {}


def materialize(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write the table once and read it back.

    The plan after it starts from files: it survives lost executors without
    redoing the work before it, and every reader takes only the columns it needs.
    A reader of arrays holds a row group at once: ``group_rows`` bounds it where rows are large.
    """
    folder = work_folder(df.sparkSession, label)
    df.write.options(**_grouped(group_rows)).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialize_in_buckets(df: DataFrame, label: str, key: str, group_rows: int | None = None) -> DataFrame:
    """Write the table once, dealt into buckets by ``key``, and read it back: joining it by ``key`` moves only the
    other side.

    Nothing is shuffled to write it. A task writes a file per bucket it has rows of, so this is for
    keys that are one and the same within a task. There are as many buckets as shuffle partitions.
    ``group_rows`` is as in ``materialize``.
    The table's name is dropped at once; the files stay, as those of ``materialize`` do.
    """
    spark = df.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    name = f"tarnsearch_{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).options(path=work_folder(spark, label), **_grouped(group_rows))
    writer.saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
