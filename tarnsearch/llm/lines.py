"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without white space at its ends, A-Z lower-cased; keys are compared
by their MD5. Documents per key are counted with partial aggregation, so the most frequent
line of a corpus is one row per task. Where a document loses lines is found by joining its keys
with the keys over the threshold; the few hottest of those (at most ``HOT`` of them can hold more than
1/HOT of all lines) are broadcast, the rest is shuffled. Only positions travel; the texts cross
the network once, to meet their positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import SPACES, ascii_lower, document_key, whole
from tarnsearch.plans.work import materialize

HOT = 1000


@dataclass(frozen=True)
class CommonLine:
    min_chars: int = 20
    min_documents: int = 3


def _keyed(how: CommonLine) -> Column:
    """Per line its position and its key, for lines long enough to count."""
    lines = F.split("text", "\n", -1)
    keys = F.transform(
        lines,
        lambda line, i: F.struct(i.alias("pos"), F.trim(line, F.lit(SPACES)).alias("line")),
    )
    return F.filter(keys, lambda k: F.length(k["line"]) >= how.min_chars)


def drop_common_lines(docs: DataFrame, how: CommonLine | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (of the lines kept, joined by line feeds).

    A key of at least ``min_chars`` code points found in at least ``min_documents`` documents
    loses all its lines, except in the largest doc_id that has it. A null or empty text is one
    empty line. Rows that repeat a doc_id count as one document and are each returned; rows
    without one are a document below all others.
    """
    how = how or CommonLine()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), document_key().alias("id"), whole(text).alias("text"))
    # A repeated id may have other texts, so positions belong to an id and a text.
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    lines = materialize(
        docs.select("id", "digest", F.explode(_keyed(how)).alias("k")).select(
            "id", "digest", "k.pos", F.unhex(F.md5(ascii_lower(F.col("k.line")))).alias("key")
        ),
        "lines",
    )
    common = materialize(
        lines.groupBy("key")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"), F.count("*").alias("places"))
        .where(F.col("n") >= how.min_documents),
        "common",
    )
    total = lines.count()
    hot = common.where(F.col("places") * HOT > total).select("key", "keeper")
    rest = common.where(F.col("places") * HOT <= total).select("key", "keeper")
    marked = lines.join(
        F.broadcast(hot.select("key", F.col("keeper").alias("hot_keeper"))), "key", "left"
    )
    gone = (
        marked.where("hot_keeper is not null and hot_keeper <> id")
        .select("id", "digest", "pos")
        .union(
            marked.where("hot_keeper is null").join(rest, "key").where("keeper <> id").select("id", "digest", "pos")
        )
        .groupBy("id", "digest")
        .agg(F.collect_set("pos").alias("gone"))
    )
    split = F.split("text", "\n", -1)
    n_lines = F.size(split)
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    # The lines are bound as the element of an array of one: split again for each of them, long texts would never end.
    kept = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    return docs.join(gone, ["id", "digest"], "left").select(
        "doc_id",
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
