"""Shards of nearly equal bytes by histogram sort. DataFrame operations only.

Rows are ordered by a 64-bit hash of their id and their place in the input, so that neither copies
nor a hot id gather. Splitters between shards are found on counts alone: bytes are summed per bin of
the key's first bits, each splitter moves into the bin where its share of all bytes is met, and
only those few bins are counted again by their next bits, until every splitter is within
tolerance. Then the rows are exchanged once, to blocks within shards, and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.llm.text import packed
from tarnsearch.plans.work import materialize

BITS = 12  # of the key that a round looks at: 4096 bins, and as many per open splitter later
BLOCK_ROWS = 10_000
OVERHEAD = 16  # bytes that a row takes beside its text


def row_bytes(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def order_key(doc_id: str | Column) -> Column:
    """Above 0. The place in the input keeps repeated ids apart; it is the same in every scan of a table."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.monotonically_increasing_id()), 1)


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.002) -> list[int]:
    """Keys at which shards 1, 2, ... begin, from (key, size) rows.

    Each leaves before it its share of all bytes, give or take ``tolerance`` of a shard, or as
    near as whole rows allow. A round brings at most 4096 sums per splitter still open to the driver.
    """
    if shards < 2:
        return []
    total = keyed.agg(F.sum("size")).first()[0] or 0
    wanted = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    # Per splitter: the prefix of its bin, the bits of the prefix, bytes before that bin.
    state = [(0, 0, 0)] * len(wanted)
    found: list[int | None] = [None] * len(wanted)
    bits = 0
    while bits < 63 and None in found:
        step = min(BITS, 63 - bits)
        open_ = sorted({state[i][0] for i, f in enumerate(found) if f is None})
        prefix = F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("bigint")
        rows = keyed.where(prefix.isin(open_)) if bits else keyed
        sums: dict[int, list[tuple[int, int]]] = {}
        for bin_, size in rows.groupBy(F.shiftright("key", 63 - bits - step).alias("bin")).agg(F.sum("size")).collect():
            sums.setdefault(bin_ >> step, []).append((bin_, size))
        for i, target in enumerate(wanted):
            if found[i] is not None:
                continue
            before = state[i][2]
            last = state[i][0] << step
            for bin_, size in sorted(sums.get(state[i][0], [])):
                last = bin_
                if before + size >= target:
                    break
                before += size
            else:
                size = 0
            low, high = target - before, before + size - target
            edge = 63 - bits - step
            if low <= slack or (high > slack and bits + step == 63 and low <= high):
                found[i] = last << edge
            elif high <= slack or bits + step == 63:
                found[i] = (last + 1) << edge
            else:
                state[i] = (last, bits + step, before)
        bits += step
    return [f or 0 for f in found]


def sharded(docs: DataFrame, shards: int, text: str = "text", carry: bool = False) -> DataFrame:
    """Every row with ``_key``, ``_size``, ``_crc``, ``_shard`` from 0 and ``_slot``, gapless from 0 in
    each shard; its own columns in ``_row``, all of them with ``carry``, else the doc_id.

    The docs must be read from a table, or be deterministic: they are scanned for the counts
    and again for the exchange. A null text counts as an empty one. Rows that repeat another are
    placed each for itself; an empty table gives no rows.
    """
    rows = packed(docs) if carry else docs.select(F.struct("doc_id", text).alias("_row"))
    body = F.col(f"_row.{text}")
    keyed = rows.select(
        "_row" if carry else F.struct("_row.doc_id").alias("_row"),
        order_key("_row.doc_id").alias("_key"),
        row_bytes(body).alias("_size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("_crc"),
    )
    counted = materialize(keyed.select(F.col("_key").alias("key"), F.col("_size").alias("size")), "keys")
    cuts = splitters(counted, shards)
    n_rows = counted.count()
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    bits = max(1, (blocks - 1).bit_length())

    def shard(key: str) -> Column:
        passed = [F.when(F.col(key) >= cut, 1).otherwise(0) for cut in cuts]
        return sum(passed, F.lit(0)).cast("int")

    def block(key: str) -> Column:
        return F.shiftright(key, 63 - bits)

    # Few rows: one per shard and block.
    sizes = counted.groupBy(shard("key").alias("_shard"), block("key").alias("_block")).agg(F.count("*").alias("n"))
    before = sizes.select(
        "_shard",
        "_block",
        (F.sum("n").over(Window.partitionBy("_shard").orderBy("_block")) - F.col("n")).alias("_before"),
    )
    place = F.row_number().over(Window.partitionBy("_shard", "_block").orderBy("_key"))
    return (
        keyed.withColumn("_shard", shard("_key"))
        .withColumn("_block", block("_key"))
        .join(before, ["_shard", "_block"])
        .withColumn("_slot", (place + F.col("_before") - 1).cast("bigint"))
        .select("_row", "_key", "_size", "_crc", "_shard", "_slot")
    )
