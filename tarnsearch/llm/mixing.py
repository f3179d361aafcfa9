"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source's target divided by its size is the number of copies f that each of its documents
should get: floor(f) for sure, and one more with probability p = f - floor(f). The
probabilities are rounded in pairs: of two undecided documents one hands mass (size times p) to the
other until one of them is at 0 or 1; the direction is random, with odds that leave every
expectation as it was. The words taken so far therefore never change, but for the last
undecided document of a source.

Pairs are met in a reduction tree: documents fall into nodes of about ``FAN_IN`` by a hash, a node
settles its documents one after the other and passes the one left undecided to the next
level. Levels grow with the logarithm of the documents; a hot source is as many nodes
as its documents need. All randomness is a hash of the seed and the ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import SPACED_WORD, unpacked
from tarnsearch.plans.work import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times its source's size that a target may be
FAN_IN = 64


def word_count(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_rank``, from 0 in code point order, null last, to distinct values, without
    gathering them in one task: ranges are sorted each on its own, and offset by the ranges before."""
    by = F.asc_nulls_last(column)
    ranged = materialize(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row per partition of the shuffle.
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select(
        "_part", (F.sum("n").over(_window().orderBy("_part")) - F.col("n")).alias("_before")
    )
    place = F.row_number().over(_window("_part").orderBy(by))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(before), "_part")
        .withColumn("_rank", F.col("_place") + F.col("_before") - 1)
        .drop("_part", "_place", "_before")
    )


def _window(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, size) rows: source, source_size, target.

    Weights repeat over the sources in code point order, null last. The words of all sources
    are shared by weight; a target stops at ``most`` times its source's size, and what is over is
    shared again by weight among the others until none is above. Only the sums of a
    round come to the driver.
    """
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    table = F.array(*(F.lit(float(w)) for w in weights))
    sources = materialize(
        sources.withColumn("weight", F.element_at(table, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .drop("_rank"),
        "sources",
    )
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    level, capped = total / weight, None
    while True:
        over = F.col("cap") < F.col("weight") * level
        caps, held, n = sources.where(over).agg(F.sum("cap"), F.sum("weight"), F.count("*")).first()
        if n == capped or weight - (held or 0.0) <= 0:
            break
        capped, level = n, (total - (caps or 0.0)) / (weight - (held or 0.0))
    return sources.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


# A distinct row that is undecided: ``p`` is the chance of one more copy, ``known`` what it has for sure.
_UNIT = "struct<h: bigint, h2: bigint, id: bigint, size: bigint, n: bigint, known: bigint, p: double>"


def _settle(seed: int, level: int) -> Column:
    """Fold a node's rows: ``done`` holds the decided ones, ``left`` the one undecided, if any."""
    start = F.struct(
        F.lit(None).cast(_UNIT).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done")
    )

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in ("h", "h2", "id", "size", "n", "known")), p.alias("p"))

    def meet(acc: Column, new: Column) -> Column:
        old = acc["left"]
        a, b = old["size"] * old["p"], new["size"] * new["p"]
        room_a, room_b = old["size"] * (1 - old["p"]), new["size"] * (1 - new["p"])
        to_new, to_old = F.least(a, room_b), F.least(b, room_a)
        give = _uniform(F.lit(seed), F.lit(level), old["h"], new["h"]) * (to_new + to_old) < to_old
        old_p = F.when(give, F.when(a <= room_b, 0.0).otherwise((a - to_new) / old["size"])).otherwise(
            F.when(b >= room_a, 1.0).otherwise((a + to_old) / old["size"])
        )
        new_p = F.when(give, F.when(a >= room_b, 1.0).otherwise((b + to_new) / new["size"])).otherwise(
            F.when(b <= room_a, 0.0).otherwise((b - to_old) / new["size"])
        )
        return F.struct(with_p(old, old_p).alias("old"), with_p(new, new_p).alias("new"))

    def whole(p: Column) -> Column:
        return (p <= 0) | (p >= 1)

    def split(acc: Column, pair: Column) -> Column:
        both = F.array(pair["old"], pair["new"])
        return F.struct(
            F.get(F.filter(both, lambda u: ~whole(u["p"])), F.lit(0)).alias("left"),
            F.concat(acc["done"], F.filter(both, lambda u: whole(u["p"]))).alias("done"),
        )

    def step(acc: Column, new: Column) -> Column:
        # The pair is computed once: bound as the element of an array of one.
        met = F.get(F.transform(F.array(meet(acc, new)), lambda pair: split(acc, pair)), F.lit(0))
        return F.when(acc["left"].isNull(), F.struct(new.alias("left"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate("units", start, step)


def copies(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """From rows (source, id, size and two hashes of all they hold) and their sources' targets: per distinct row
    the number ``n`` of its equals and that of the copies of them all, ``total``.

    Of n equal rows each gets floor(f) copies and floor(n p) of them one more at once; only the rest, less
    than a copy of one row, is left to chance.
    """
    share = F.col("target") / F.col("source_size")
    units = (
        rows.groupBy("source", "h", "h2", "id", "size")
        .agg(F.count("*").alias("n"))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("f", F.when(F.col("source_size") > 0, F.least(share, F.lit(float(MOST)))).otherwise(F.lit(0.0)))
        .withColumn("low", F.floor("f"))
        .withColumn("more", F.when(F.col("size") > 0, F.col("n") * (F.col("f") - F.col("low"))).otherwise(F.lit(0.0)))
        .withColumn("known", F.col("n") * F.col("low") + F.floor("more"))
        .withColumn("p", F.col("more") - F.floor("more"))
    )
    first = materialize(units.select("source", F.struct("h", "h2", "id", "size", "n", "known", "p").alias("unit")), "units")
    decided = [first.where("unit.p <= 0").select("source", "unit.*")]
    open_ = first.where("unit.p > 0")
    level = 0
    largest = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while largest:
        n_nodes = F.greatest(F.lit(1), F.ceil(F.col("n_open") / FAN_IN))
        sized = open_.groupBy("source").agg(F.count("*").alias("n_open")).withColumnRenamed("source", "_source")
        node = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit.h"), F.col("n_open_nodes"))
        nodes = (
            open_.join(
                sized.select("_source", n_nodes.alias("n_open_nodes")), F.col("source").eqNullSafe(F.col("_source"))
            )
            .groupBy("source", node.alias("node"))
            .agg(F.sort_array(F.collect_list("unit")).alias("units"))
        )
        settled = materialize(nodes.select("source", _settle(seed, level).alias("s")), "settled")
        decided.append(settled.select("source", F.explode("s.done").alias("u")).select("source", "u.*"))
        open_ = settled.where("s.left is not null").select("source", F.col("s.left").alias("unit"))
        if largest <= FAN_IN:  # each source was one node: its last row is decided alone
            last = F.when(_uniform(F.lit(seed), "unit.h") < F.col("unit.p"), 1.0).otherwise(0.0)
            decided.append(open_.select("source", *(f"unit.{c}" for c in ("h", "h2", "id", "size", "n", "known")), last.alias("p")))
            break
        level += 1
        largest = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    return reduce(DataFrame.union, decided).select(
        "source", "h", "h2", F.col("id").alias("doc_id"), "size", "n", (F.col("known") + F.col("p").cast("bigint")).alias("total")
    )


def _hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns of a row: equal rows are one for them."""
    whole_row = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    return F.xxhash64(*whole_row), F.xxhash64(F.lit(1), *whole_row)


def _sized(docs: DataFrame, text: str) -> DataFrame:
    h, h2 = _hashes(docs)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        h.alias("h"),
        h2.alias("h2"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 0, text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A null text has no words; a document without words is never copied beyond the whole
    part of its source's share. Null is a source, and an id, of its own. Of rows that are equal in all columns
    some may be taken once more than others. A source's taken words differ from its target by less than
    the words of one row. An empty table gives no rows.
    """
    sized = materialize(_sized(docs, text), "sized")
    targets = materialize(source_targets(sized, weights), "targets")
    renamed = targets.withColumnRenamed("source", "_source")
    each = F.expr("total div n + CASE WHEN i <= total % n THEN 1 ELSE 0 END")
    return (
        copies(sized, renamed, seed)
        .join(renamed, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("copies", each)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 0, text: str = "text") -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were.

    Equal rows are one before they are shuffled, and come out as often as they are taken together;
    else as in ``mix``. Clashing names do no harm: rows travel packed.
    """
    sized = materialize(_sized(docs, text), "sized")
    targets = materialize(source_targets(sized, weights), "targets").withColumnRenamed("source", "_source")
    chosen = copies(sized, targets, seed).where("total > 0").select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), F.col("total").alias("_total"))
    h, h2 = _hashes(docs)
    rows = docs.select(F.struct("*").alias("_row"), h.alias("_h"), h2.alias("_h2"))
    distinct = rows.groupBy("_h", "_h2").agg(F.first("_row").alias("_row"))
    taken = distinct.join(materialize(chosen, "copies"), ["_h", "_h2"])
    return unpacked(taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_total").cast("int")))))
