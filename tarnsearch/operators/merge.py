"""The best of each question from what every task found by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Groups of tasks whose hits are merged before all of a question's are.
MERGE_SALTS = 100


def merge_best(hits: DataFrame, k: int) -> DataFrame:
    """Rows ``(query_id, chunk_id, score)`` cut to the best ``k`` of each question, with ``rank`` from 1.

    Ties go to the smaller id. First the hits of every hundredth task are merged, then those
    hundred: at 10,000 tasks no group is larger than 100 times ``k`` rows in either step.
    """
    order = [F.desc("score"), F.asc("chunk_id")]
    salted = hits.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS)))
    place = F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))
    some = salted.withColumn("place", place).where(F.col("place") <= k).drop("place", "salt")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k)
