"""Rank lists, fuse them by reciprocal rank, fetch what they point to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.params import K_RRF, TOPN, positive
from tarnsearch.plans.work import materialize

# Fused scores are cut here before they are compared; two different sums of a few
# reciprocals are much further apart than that.
FUSED_DIGITS = 12


def rank_list(hits: DataFrame) -> DataFrame:
    """Rank from 1 within each question: score descending, then chunk."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best_first))


def rrf_fuse(rankings: Sequence[DataFrame], k_rrf: int = K_RRF, topn: int = TOPN) -> DataFrame:
    """Fuse ranked lists ``(query_id, chunk_id, rank)``: sum of ``1 / (k_rrf + rank)``.

    Equal sums keep the order in which the lists, one after the other, first name
    the chunk. ``rank_1``, ``rank_2``, ... tell where each list had it.
    """
    positive("k_rrf", k_rrf)
    positive("topn", topn)
    if not rankings:
        raise ValueError("rankings must not be empty")
    tagged = [
        ranking.select("query_id", "chunk_id", "rank", F.lit(i).alias("list"))
        for i, ranking in enumerate(rankings, start=1)
    ]
    positions = range(1, len(rankings) + 1)
    gain = 1.0 / (F.lit(k_rrf) + F.col("rank"))
    fused = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("query_id", "chunk_id")
        .agg(
            F.round(F.sum(gain), FUSED_DIGITS).alias("rrf_score"),
            *(F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in positions),
        )
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rrf_score"), *(F.asc_nulls_last(f"rank_{i}") for i in positions)
    )
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= topn)


# Words of 64 bits in the filter of candidates: at most so many rows of 16 bytes are shipped, however
# many candidates there are. Up to some 1.5 million of them (10 bits each) one chunk in a hundred passes by mistake.
FILTER_WORDS = 1 << 18
_BITS = 5


def _word_and_bits(key: Column, words: int) -> tuple[Column, Column]:
    """Where a key stands in the filter: its word, and the bits it sets there."""
    hashed = F.xxhash64(key)
    places = [F.shiftright(hashed, 6 * i).bitwiseAND(63).cast("int") for i in range(_BITS)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]
    word = F.pmod(F.shiftright(hashed, 6 * _BITS), F.lit(words)).cast("int")
    return word, reduce(Column.bitwiseOR, bits)


def candidate_filter(keys: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """A Bloom filter as a table ``(_word, _set)`` of at most ``words`` rows, combined before the shuffle."""
    word, bits = _word_and_bits(F.col(key), positive("words", words))
    return keys.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))


def may_be_wanted(rows: DataFrame, filter_table: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and a few that are not."""
    word, bits = _word_and_bits(F.col(key), words)
    held = rows.withColumn("_word", word).withColumn("_bits", bits).join(F.broadcast(filter_table), "_word")
    return held.filter(F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("_word", "_bits", "_set")


def gather_candidates(
    fused: DataFrame, chunks: DataFrame, carry: Sequence[str] = (), words: int = FILTER_WORDS
) -> DataFrame:
    """Text and source of the fused ids, fetched last and only for those.

    The ids go to the chunks as a Bloom filter of bounded size, where these are read; what it lets through, the wanted
    chunks and few others, is joined with the ids. One form at every size: a filter too small for its candidates
    lets more through, and the join is what decides. The fused rows are written once, as they are read twice.
    """
    fused = materialize(fused, "fused")
    wanted = chunks.select("chunk_id", F.col("source_path").alias("source"), "text", *carry)
    near = may_be_wanted(wanted, candidate_filter(fused, "chunk_id", words), "chunk_id", words)
    return near.join(fused, "chunk_id").select(
        "query_id", "chunk_id", "rank", "rrf_score", "source", "text", *carry
    )
