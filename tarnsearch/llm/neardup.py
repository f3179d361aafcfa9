"""Near-duplicates by one-permutation MinHash, confirmed on full shingle sets.

1. One pass over the texts: a digest of the word sequence, and a one-permutation MinHash
   signature (the hash range is cut in bins, a bin keeps its least hash, an empty bin
   borrows from a full one chosen by an own random walk: optimal densification).
2. Texts with the same words are one class; its smallest id stands for it.
3. Bands of the signature are bucket keys. In a bucket every document is compared with one
   only, its centre (a star), so a bucket of n documents gives n - 1 pairs. Centres are drawn by a
   hash of document and bucket: two documents that share many buckets meet many centres.
4. Pairs are confirmed on their texts' full sets; links make components.
5. A bucket that still holds several components may hide a link that its star did not show. Its
   documents get further, sharper buckets: ``COMBINED`` bands at once, in which dissimilar
   documents seldom meet, with ``CENTRES`` centres each. A component found before is stood for, in each
   bucket and draw, by one of its documents. Rounds go on, with new draws, until no bucket holds
   several components or ``IDLE`` rounds in a row find no link.

Every round costs at most a pair per component, bucket and centre, whatever the groups' sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.graph import components
from tarnsearch.llm.text import SPACED, Block, blocks, distinct, document_key, mix, one_by_one, packed, unpacked
from tarnsearch.plans.work import materialize, materialize_in_buckets


COMBINED = 3
SHARP_BUCKETS = 100
CENTRES = 4  # of a sharp bucket, in one round
IDLE = 2


@dataclass(frozen=True)
class NearDup:
    """Linked if ``percent * union <= 100 * intersection``. A pair exactly at 85 percent
    shares none of 40 bands of 4 with chance 1e-13, at 80 percent with chance 7e-10."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 4


_STEP = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of each set of hashes, with optimal densification.

    Every empty bin walks over bins in an order of its own, the same in every set, and
    takes the value of the first full one. A set without hashes has no use for its row.
    """
    values = np.full((len(sets), bins), _NONE)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    at = (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(values, (owner, at), hashes)
    full = values != _NONE
    rows, empty = np.nonzero(~full & full.any(axis=1, keepdims=True))
    own = np.arange(bins, dtype=np.uint64) * _STEP
    step = np.uint64(0)
    while len(rows):
        step += np.uint64(1)
        there = (mix(own + step) % np.uint64(bins)).astype(np.int64)[empty]
        found = full[rows, there]
        values[rows[found], empty[found]] = values[rows[found], there[found]]
        rows, empty = rows[~found], empty[~found]
    return values


def sketch(block: Block, how: NearDup) -> pd.DataFrame:
    """Per text: digest of its words, number of distinct shingles, bucket keys."""
    sets = [distinct(s) for s in block.shingles(how.shingle)]
    bands = signatures(sets, how.bands * how.rows).reshape(len(sets), how.bands, how.rows)
    keys = np.tile(np.arange(how.bands, dtype=np.uint64), (len(sets), 1))
    for row in range(how.rows):
        keys = mix(keys * _STEP + bands[:, :, row])
    return pd.DataFrame(
        {
            "digest": [hashlib.md5(b" ".join(t.lower().split())).digest() for t in block.texts],
            "n_shingles": [len(s) for s in sets],
            "keys": [k if len(s) else k[:0] for s, k in zip(sets, keys.view(np.int64))],
        }
    )


def _sketches(how: NearDup):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [sketch(b, how) for b in blocks(one_by_one(batch), SPACED)]
            columns = [[value for part in parts for value in part[c]] for c in ("digest", "n_shingles", "keys")]
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["digest", "n_shingles", "keys"])

    return F.arrow_udf(run, "digest binary, n_shingles bigint, keys array<bigint>")


def shingle_set(data: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = data.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def _linked(how: NearDup):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, left = [], None, set()
        for x, y in zip(one_by_one(a), one_by_one(b)):
            if last is None or x != last:
                last, left = x, shingle_set(x, how.shingle)
            right = shingle_set(y, how.shingle)
            both = len(left & right)
            out.append(100 * both >= how.percent * (len(left) + len(right) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def _open_buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return rows.join(mixed.select("key"), "key", "left_semi")


def _star_pairs(rows: DataFrame, turn: int, how: NearDup) -> DataFrame:
    """The centres of every bucket with one row of each other component in it.

    For each draw a component is stood for by its row of the least hash in the bucket, and the
    least of these is the centre; the next round draws anew. So a bucket gives no more pairs than
    it holds components, times the draws, however many rows a component has there.
    """
    draws = range(1, 1 + (CENTRES if turn else 1))
    for d in draws:
        rows = rows.withColumn(f"draw{d}", F.xxhash64("id", "key", F.lit(d), F.lit(turn)))
    stand = rows.groupBy("key", "label").agg(
        *(F.min_by(c, f"draw{d}").alias(f"{c}{d}") for d in draws for c in ("id", "n")),
        *(F.min(f"draw{d}").alias(f"draw{d}") for d in draws),
    )
    centres = stand.groupBy("key").agg(
        *(F.min_by(c, f"draw{d}").alias(f"{name}{d}") for d in draws for c, name in ((f"id{d}", "c_id"), (f"n{d}", "c_n"), ("label", "c_label")))
    )
    pair = "struct(least(id{0}, c_id{0}) AS a, greatest(id{0}, c_id{0}) AS b, label <> c_label{0} AND "
    pair += "100 * least(n{0}, c_n{0}) >= {1} * greatest(n{0}, c_n{0}) AS fits)"
    met = F.expr("filter(array(" + ", ".join(pair.format(d, how.percent) for d in draws) + "), p -> p.fits)")
    return stand.join(centres, "key").select(F.explode(met).alias("p")).select("p.a", "p.b").distinct()


def _sharp_keys(bands: int) -> Column:
    """Bucket keys of several bands each; which ones is fixed by a rule."""
    keys = []
    for i in range(SHARP_BUCKETS):
        drawn = np.random.default_rng(i).choice(bands, min(COMBINED, bands), replace=False)
        keys.append(F.xxhash64(F.lit(i), *(F.get("keys", F.lit(int(d))) for d in sorted(drawn))))
    return F.array(*keys)


def near_duplicates(docs: DataFrame, how: NearDup | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    White space alone separates words; A-Z are lower-cased. A text with fewer words than a
    shingle is one shingle; a null text, or one without words, is linked with nothing. Rows
    that repeat a doc_id are one document with the links of them all; each is returned. Rows
    without a doc_id are one document below all others; null stands for it in both columns.
    """
    how = how or NearDup()
    docs = docs.select(document_key().alias("id"), F.col(text).cast("binary").alias("text"))
    sketched = materialize(docs.select("id", _sketches(how)("text").alias("s")).select("id", "s.*"), "sketches")
    worded = sketched.where("n_shingles > 0")
    classes = worded.groupBy("digest").agg(F.min("id").alias("id"))
    # The class of the same words that a document stands for; a repeated id may stand for several.
    nodes = worded.join(classes, ["digest", "id"], "left_semi").dropDuplicates(["digest"])
    bands = nodes.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    rows = materialize(_open_buckets(materialize(bands, "bands").withColumn("label", F.col("id"))), "buckets")
    # In buckets by id, as they were shuffled: pairs come to the texts, in whatever round.
    texts = materialize_in_buckets(
        docs.join(rows.select("id").distinct(), "id", "left_semi")
        .withColumn("_md5", F.md5("text"))
        .dropDuplicates(["id", "_md5"])
        .drop("_md5"),
        "texts",
        "id",
    )
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    links = _same_document(worded, classes)
    labels = materialize(components(links), "labels")
    tested = None
    turn = idle = 0
    while rows.head(1):
        pairs = _star_pairs(rows, turn, how)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = pairs.join(left, "a").join(right, "b").where(_linked(how)("text_a", "text_b")).select("a", "b")
        found = materialize(found, "links")
        if turn and not found.head(1):
            idle += 1
            if idle == IDLE:
                break
            turn += 1
            continue
        idle = 0
        # The components so far are stars: fewer rows than the links they came from, and nearer to the end.
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialize(components(stars.union(found)), "labels")
        named = labels.withColumnRenamed("node", "id")
        labelled = rows.drop("label").join(named, "id", "left").withColumn("label", F.coalesce("component", "id"))
        labelled = labelled.drop("component")
        if not turn:
            unsure = materialize(_open_buckets(labelled).select("id", "label").distinct(), "unsure")
            labelled = nodes.join(unsure, "id").select(
                "id", F.col("n_shingles").alias("n"), "label", F.explode(_sharp_keys(how.bands)).alias("key")
            )
        rows = materialize(_open_buckets(labelled), "buckets")
        turn += 1
    groups = (
        classes.join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("digest", F.coalesce("component", "id").alias("component"))
    )
    known = sketched.select("id", "digest", "n_shingles").join(groups, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return known.select(
        _public("id").alias("doc_id"),
        "n_shingles",
        _public(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _public(key):
    """A key as the id it was made of."""
    key = F.col(key) if isinstance(key, str) else key
    return F.nullif(key, F.lit(-(2**63)))


def _same_document(worded: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a document whose id is repeated with other words."""
    torn = worded.groupBy("id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1")
    own = worded.select("id", "digest").join(torn.select("id"), "id", "left_semi")
    return materialize(
        own.join(classes.withColumnRenamed("id", "c"), "digest").select(F.col("id").alias("a"), F.col("c").alias("b"))
        .where("a <> b").distinct(),
        "links",
    )


def keep_one_of_each(docs: DataFrame, how: NearDup | None = None, text: str = "text") -> DataFrame:
    """The documents of which no smaller one is linked, all columns as they were.

    Repeated rows of such a document all stay. The texts are shuffled by id once.
    """
    found = near_duplicates(docs, how, text)
    gone = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    rows = packed(docs)
    return unpacked(rows.join(gone, F.col("_row.doc_id").cast("bigint") == F.col("_gone"), "left_anti"))
