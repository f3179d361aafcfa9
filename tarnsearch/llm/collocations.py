"""Collocations: phrases whose words keep company more than their counts explain.

1. Texts are cut into pieces, pieces into words; blocks of texts become shards: the words of a shard
   are numbers (one per language and word), 0 stands between pieces. Each shard counts its words.
2. A shard has an FM-index in both directions, sorted as deep as the longest phrase. A phrase is a pair
   of intervals, one in either index; it is extended to the left through the
   words before the rows of its interval (the Burrows-Wheeler column), to the right through those of
   the mirrored index, with both intervals kept in step.
3. Phrases grow by a word per round. A phrase of d words counts only if the d - 1 words it
   starts with and the d - 1 it ends with are frequent in the whole corpus: in the shard it must be among
   the right extensions of frequent phrases and among the left extensions of them. Shards'
   counts are then summed over the corpus, and the phrases that stay frequent are the next round's.

A frequent word's number in the first shard that has it, with that shard's, is its id everywhere, so only
words travel as text, and only once. The rest works on tables of frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.plans.work import materialize, work_folder

SHARD_WORDS = 1 << 20
STEP = 1 << 18
NO_LANGUAGE = "und"
SALTS = 32


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``words`` words, at least ``least`` of them; one that makes up ``inside`` percent of a shorter
    one replaces it. ``top`` are reported per language."""

    words: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000


# What bytes are: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (not negative) in ascending order and their places, equal ones by place."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 62:
        place = np.argsort(key, kind="stable")
        return key[place], place
    both = key.astype(np.int64) << bits
    both |= np.arange(len(key))
    both.sort()  # plain numbers: several times as quick as sorting places
    return both >> bits, both & ((1 << bits) - 1)


def _distinct(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``size`` in ascending order, and which of them each key is."""
    if size > 8 * len(key) + 1024:
        return np.unique(key, return_inverse=True)
    there = np.zeros(size, bool)
    there[key] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[key]


def encode(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, pa.Array]:
    """A shard: numbers of words, 0 between pieces and texts; and what 1, 2, ... stand for, as language, tab, word."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = kind == 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = pa.py_buffer(data[kind == 0])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
    # The language of a word is that of its text.
    known = sorted(set(langs))
    place = {lang: i for i, lang in enumerate(known)}
    code = np.array([place[lang] for lang in langs], np.int64)
    lang = code[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")]
    width = max(1, len(words.dictionary))
    both, symbol = _distinct(lang * width + words.indices.to_numpy(), len(known) * width)
    # A 0 before every word that a piece begins with.
    breaks = np.cumsum(kind == 2)
    first = np.ones(len(starts), bool)
    first[1:] = breaks[starts[1:]] != breaks[starts[:-1]]
    seq = np.zeros(len(starts) + int(first.sum()) + 1, np.int32)
    seq[np.arange(len(starts)) + np.cumsum(first)] = symbol + 1
    names = pa.array(known, pa.string()).take(pa.array(both // width))
    return seq, pc.binary_join_element_wise(names, words.dictionary.take(pa.array(both % width)).cast(pa.string()), "\t")


STORED = "shard bigint, seq binary, length int, gram string, number int, n bigint"
SHARD_BITS, NUMBER_BITS = 12, 28  # of a task's shards and of a shard's words


def _shards(size: int):
    """Neighbouring texts as shards of about ``size`` words (a longer text alone): a row of a shard's sequence, and
    rows of its words."""

    def shard(number: int, texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        seq, words = encode(texts, langs)
        names = ["shard", "seq", "length", "gram", "number", "n"]
        squeezed = pa.compress(seq.tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([squeezed], pa.binary()), pa.array([len(seq)], pa.int32())]
            + [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.int64())],
            names,
        )
        k = len(words)
        n = np.bincount(seq, minlength=k + 1)[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, number)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), words]
            + [pa.array(np.arange(1, k + 1, dtype=np.int32)), pa.array(n)],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SHARD_BITS
        texts, langs, letters = [], [], 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                texts.append(text.as_py() or b"")
                langs.append(lang.as_py())
                letters += len(texts[-1])
                if letters >= 6 * size:
                    yield from shard(number, texts, langs)
                    number, texts, langs, letters = number + 1, [], [], 0
        if texts:
            yield from shard(number, texts, langs)

    return run


@dataclass
class Phrases:
    """Intervals of phrases in both indexes: rows [at, at + n) of the one, [back, back + n) of the mirrored one."""

    at: np.ndarray
    back: np.ndarray
    n: np.ndarray

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.at[which], self.back[which], self.n[which])


def _sorted_places(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` numbers that start there (0 ends them)."""
    rank = seq.astype(np.int64)
    padded = np.concatenate((seq, np.zeros(depth, seq.dtype)))
    width = int(seq.max(initial=0)) + 1
    for d in range(1, depth):
        following = padded[d : d + len(seq)].astype(np.int64)
        if d > 1:
            for e in range(1, d):
                following[padded[e : e + len(seq)] == 0] = 0
        following[seq == 0] = 0
        key, place = in_order(rank * width + following)
        if d < depth - 1:
            rank = np.empty(len(seq), np.int64)
            rank[place] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    return place if depth > 1 else in_order(rank)[1]


class Index:
    """A bidirectional FM-index of a sequence, for phrases of up to ``depth`` numbers."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.size = int(seq.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.size))))
        # The column of numbers before (and, in the mirrored index, after) each row.
        self.before = np.roll(seq, 1)[_sorted_places(seq, depth)]
        mirrored = seq[::-1]
        self.after = np.roll(mirrored, 1)[_sorted_places(mirrored, depth)]
        self.ranks_before, self.ranks_after = self._ranks(self.before), self._ranks(self.after)

    def words(self, numbers: np.ndarray) -> Phrases:
        return Phrases(self.starts[numbers], self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers])

    def _ranks(self, column: np.ndarray) -> np.ndarray:
        """For each row how many rows above it hold the same number."""
        word, row = in_order(column)
        ranks = np.empty(len(column), np.int32)
        ranks[row] = np.arange(len(column)) - self.starts[word]
        return ranks

    def _extend(self, column: np.ndarray, ranks: np.ndarray, at: np.ndarray, back: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-word extensions through a column: the phrase, the word, both intervals' starts, the count."""
        # So many phrases at a time that their rows are about STEP.
        cuts = np.searchsorted(np.cumsum(n), np.arange(1, int(n.sum()) // STEP + 1) * STEP)
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(n)]):
            some = self._some(column, ranks, at[a:b], back[a:b], n[a:b])
            parts.append((some[0] + a, *some[1:]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _some(self, column: np.ndarray, ranks: np.ndarray, at: np.ndarray, back: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        owner = np.repeat(np.arange(len(at)), n)
        row = np.arange(len(owner)) + np.repeat(at - (np.cumsum(n) - n), n)
        key, order = in_order(owner * self.size + column[row])  # rows stay in order in a group
        row = row[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(first)
        count = np.diff(np.concatenate((head, [len(key)])))
        owner, word = np.divmod(key[head], self.size)
        near = self.starts[word] + ranks[row[head]]
        # In the other index extensions lie in the order of their words, from the phrase's own start on.
        before = np.cumsum(count) - count
        far = back[owner] + before - before[np.searchsorted(owner, owner)]
        some = word > 0
        return owner[some], word[some], near[some], far[some], count[some]

    def left(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        owner, word, at, back, n = self._extend(self.before, self.ranks_before, phrases.at, phrases.back, phrases.n)
        return owner, word, Phrases(at, back, n)

    def right(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        owner, word, back, at, n = self._extend(self.after, self.ranks_after, phrases.back, phrases.at, phrases.n)
        return owner, word, Phrases(at, back, n)

    def find(self, phrases: np.ndarray) -> Phrases:
        """The intervals of phrases (rows of numbers) that occur, by steps to the left from their last words."""
        found = self.words(phrases[:, -1])
        for d in range(phrases.shape[1] - 2, -1, -1):
            # Phrases that end alike share an interval, which is extended once.
            at, same = np.unique(found.at, return_index=True)
            ends = found.take(same)
            owner, word, longer = self.left(ends)
            wanted = np.searchsorted(at, found.at) * self.size + phrases[:, d]
            found = longer.take(np.searchsorted(owner * self.size + word, wanted))
        return found


def extensions(seq: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases a word longer whose beginning and end are both frequent.

    ``frequent`` holds phrases, rows of numbers, that occur in ``seq``. Returns the row that each new
    phrase begins with, the word that follows, and the count.
    """
    depth = frequent.shape[1] + 1
    # Only words of frequent phrases stay, with smaller numbers; others separate like piece ends.
    used = np.zeros(int(seq.max(initial=0)) + 1, np.int32)
    used[frequent.ravel()] = 1
    kept = np.flatnonzero(used)
    used[kept] = np.arange(1, len(kept) + 1)
    index = Index(used[seq], depth)
    phrases = index.find(used[frequent])
    owner, word, longer = index.right(phrases)
    ended = np.zeros(len(seq) + 1, bool)
    ended[index.left(phrases)[2].at] = True
    both = ended[longer.at]
    return owner[both], kept[word[both] - 1], longer.n[both]


def _ids(k: int) -> list[str]:
    """Columns of the words of a phrase."""
    return [f"w{i}" for i in range(1, k + 1)]


def _longer(k: int):
    """Phrases of k words of one shard, from its words and its phrases of k - 1 words that are frequent in the corpus."""
    kinds = pa.schema([("shard", pa.int64()), *((c, pa.int64()) for c in _ids(k)), ("n", pa.int64())])

    def run(shard: pa.Table, known: pa.Table) -> pa.Table:
        if not shard.num_rows or not known.num_rows:
            return kinds.empty_table()
        squeezed, length = shard.column("seq")[0].as_py(), shard.column("length")[0].as_py()
        seq = np.frombuffer(pa.decompress(squeezed, 4 * length, "zstd"), np.int32)
        words = known.filter(known.column("number").is_valid())
        number, ids = words.column("number").to_numpy(), words.column("w1").to_numpy()
        if k == 2:
            frequent = number[:, None]
        else:
            phrases = known.filter(known.column("number").is_null())
            if not phrases.num_rows:
                return kinds.empty_table()
            order = np.argsort(ids)
            sides = [phrases.column(c).to_numpy() for c in _ids(k - 1)]
            frequent = np.column_stack([number[order][np.searchsorted(ids[order], w)] for w in sides])
        owner, word, n = extensions(seq, frequent)
        id_of = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
        id_of[number] = ids
        made = [id_of[frequent[owner, i]] for i in range(k - 1)] + [id_of[word]]
        name = np.full(len(n), shard.column("shard")[0].as_py())
        return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in (name, *made, n)], schema=kinds)

    return run


def frequent_phrases(docs: DataFrame, how: Collocations, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, gram, k, a), the phrases of up to ``words`` words found ``least`` times; (lang, n), all words."""
    spark = docs.sparkSession
    given = docs.select(
        F.make_valid_utf8(F.col(text)).cast("binary").alias("text"),
        F.coalesce(F.make_valid_utf8(F.col(lang).cast("string")), F.lit(NO_LANGUAGE)).alias("lang"),
    )
    folder = work_folder(spark, "shards")
    # Row groups are read whole, so they are kept small.
    encoded = given.mapInArrow(_shards(SHARD_WORDS), STORED)
    encoded.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    stored = spark.read.schema(encoded.schema).parquet(folder)
    shards = stored.where("seq is not null").select("shard", "seq", "length")
    counted = stored.where("gram is not null").select("shard", "gram", "number", "n")
    # A word has at most a row per shard. The hash only makes the sorting cheap.
    same = Window.partitionBy(F.xxhash64("gram"), "gram")
    own = F.shiftleft("shard", NUMBER_BITS) + F.col("number")
    words = counted.withColumn("a", F.sum("n").over(same)).withColumn("w1", F.min(own).over(same))
    words = materialize(
        words.where(F.col("a") >= how.least).select("shard", "number", "w1", "a", F.when(F.col("w1") == own, F.col("gram")).alias("gram")),
        "words",
    )
    named = words.where("gram is not null").withColumn("phrase", F.substring_index("gram", "\t", -1))
    named = named.select("w1", _language().alias("lang"), F.col("phrase").alias("gram"), "a")
    tables = [named.select("lang", "gram", F.lit(1).alias("k"), "a")]
    here = words.select("shard", "number", "w1")
    known = here
    for k in range(2, how.words + 1):
        ids = _ids(k)
        kinds = "shard bigint, " + ", ".join(f"{c} bigint" for c in ids) + ", n bigint"
        grams = shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_longer(k), kinds)
        total = F.sum("n").over(Window.partitionBy(*ids))
        level = materialize(grams.withColumn("a", total).where(F.col("a") >= how.least).drop("n"), "phrases")
        known = here.unionByName(level.drop("a"), allowMissingColumns=True)
        spelt = level.groupBy(*ids).agg(F.max("a").alias("a"))
        for i, c in enumerate(ids):
            own_lang = ["lang"] if i == 0 else []
            spelt = spelt.join(named.select(F.col("w1").alias(c), *own_lang, F.col("gram").alias(f"g{i}")), c)
        tables.append(spelt.select("lang", F.concat_ws(" ", *(f"g{i}" for i in range(k))).alias("gram"), F.lit(k).alias("k"), "a"))
    sizes = counted.withColumn("phrase", F.substring_index("gram", "\t", -1)).groupBy(_language().alias("lang")).agg(F.sum("n").alias("n"))
    return materialize(reduce(DataFrame.unionByName, tables), "frequent"), sizes


def _language():
    """What stands before the phrase and its tab."""
    return F.expr("substring(gram, 1, length(gram) - length(phrase) - 1)")


def collocations(docs: DataFrame, how: Collocations | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is words that follow each other inside a piece; pieces end at ``. , ; : ! ?`` and line
    ends, words at blanks and tabs; A-Z are lower-cased. Cut after its first k words, a phrase has
    the score floor(1000000 a a / (l r)), with the counts of the phrase and its two parts; its
    lowest cut counts, of equal ones the first. A null text is empty, a null language
    ``und``. Equal scores are ordered by count and then by phrase. Repeated rows count as often as they
    are there; an empty table gives no rows; other columns are not looked at.
    """
    how = how or Collocations()
    frequent, n = frequent_phrases(docs, how, text, lang)
    found = frequent.where("k >= 2")
    # Parts of a frequent phrase are as frequent, so their counts are in the same table.
    split = F.split("gram", " ")
    cuts = found.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumn("first", F.array_join(F.slice(split, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(split, F.col("cut") + 1, F.col("k")), " "))
    left = frequent.select(F.col("lang"), F.col("gram").alias("first"), F.col("a").alias("l"))
    right = frequent.select(F.col("lang"), F.col("gram").alias("rest"), F.col("a").alias("r"))
    # Counts below 10 ** 15; the product of three factors stays below 10 ** 38.
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("over", (a * a * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)"))
    scored = scored.withColumn("under", (l * r).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # Of the phrases around a shorter one the largest count.
    inner = F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(gram, ' '), i, m), ' '))))"
    )
    around = (
        found.where("k >= 3")
        .select("lang", F.explode(inner).alias("gram"), F.col("a").alias("outer"))
        .groupBy("lang", "gram")
        .agg(F.max("outer").alias("outer"))
    )
    stay = best.join(around, ["lang", "gram"], "left").where(F.expr(f"outer is null or 100 * outer < {how.inside} * a"))
    flat = stay.select("lang", F.col("gram").alias("phrase"), "a", "best.l", "best.r", "best.score")
    # First inside salts of a language, then among the salts' bests.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(f"_r <= {how.top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(f"rank <= {how.top}").join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
