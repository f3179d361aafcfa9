"""Quality rules whose cutoffs are chosen on labelled documents with a bound on false rejections.

A rule is a measure of a text and a ladder of cutoffs: a text whose measure exceeds the
cutoff is rejected. On the labelled documents of a stratum, a cutoff that rejects k of n
good ones is *certified* if so few would be seen with probability at most
``delta / (number of tests)`` were the true share of rejected good documents as high as
``alpha / (number of rules)``: an exact binomial tail, Bonferroni's correction over strata,
rules and cutoffs. Of the certified cutoffs of a rule the strictest is applied. With
probability at least 1 - delta, all rules together reject no more than ``alpha`` of the
good documents of any stratum. A stratum with too few labels certifies nothing and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import SPACED_CASED, Block, blocks, distinct, one_by_one, packed, unpacked
from tarnsearch.plans.work import materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_lines bigint, n_upper bigint, n_letters bigint, n_marks bigint"
)


def _share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def measures() -> dict[str, Column]:
    return {
        "symbols_per_word": _share("n_symbols", "n_words"),
        "marks_per_word": _share("n_marks", "n_words"),
        "upper_share": _share("n_upper", "n_letters"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_word_share": _share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Risk:
    """``alpha``: share of good documents a stratum may lose. ``delta``: chance of being wrong.
    ``cutoffs``: per measure a ladder, the strictest first; fixed before any label is seen."""

    alpha: float = 0.05
    delta: float = 0.05
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.4),
            "marks_per_word": (0.02, 0.05, 0.1, 0.2, 0.4),
            "upper_share": (0.1, 0.15, 0.25, 0.4, 0.6),
            "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5),
            "repeat_word_share": (0.05, 0.1, 0.15, 0.2, 0.3),
        }
    )


def _count(data: np.ndarray, wanted: np.ndarray) -> int:
    return int(np.count_nonzero(wanted[data]))


def _mask(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


_SYMBOL, _UPPER, _MARK = _mask(SYMBOLS), _mask(bytes(range(65, 91))), _mask(b"!")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123)]))
_SPACE = _mask(b" \t\n\x0b\x0c\r")
_POINT = np.arange(256) & 0xC0 != 0x80  # bytes that start a code point


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a run of ``window`` words that the text has twice or more.

    Exact: words are numbered, and the numbers of neighbours are paired and numbered again.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        step = min(width, window - width)
        ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]
        width += step
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.bincount(often, minlength=len(words) + 1) - np.bincount(often + window, minlength=len(words) + 1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def features(block: Block) -> pd.DataFrame:
    """The numbers of ``FEATURES`` per text."""
    out = []
    for data, n_words, windows in zip(block.texts, np.diff(block.bounds), block.shingles(WINDOW, False)):
        raw = np.frombuffer(data, np.uint8)
        lines = [line for line in data.split(b"\n") if line.strip()]
        # Equal windows have equal hashes: without equal hashes nothing is repeated.
        repeats = len(distinct(windows)) < len(windows)
        out.append(
            (
                n_words,
                _count(raw, _POINT) - _count(raw, _SPACE),
                _count(raw, _SYMBOL),
                len(lines) - len(set(lines)),
                repeated_words(data.split()) if repeats else 0,
                len(lines),
                _count(raw, _UPPER),
                _count(raw, _LETTER),
                _count(raw, _MARK),
            )
        )
    return pd.DataFrame(out, columns=[f.split()[0] for f in FEATURES.split(",")], dtype="int64")


def _features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        parts = [features(b) for b in blocks(one_by_one(batch), SPACED_CASED)]
        names = [f.split()[0] for f in FEATURES.split(",")]
        columns = [np.concatenate([p[c].to_numpy() for p in parts] or [np.empty(0, np.int64)]) for c in names]
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names)


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(f"_row.{column}").cast("string"), F.lit(""))


def with_features(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """``_row``, ``_stratum`` and one column per feature."""
    rows = packed(docs)
    return (
        rows.withColumn("_stratum", _stratum(stratum))
        .withColumn("_f", F.arrow_udf(_features, FEATURES)(F.col(f"_row.{text}").cast("binary")))
        .select("_row", "_stratum", "_f.*")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, summed exactly in logarithms."""
    from math import exp, lgamma, log, log1p

    if k >= n:
        return 1.0
    return min(
        1.0,
        sum(
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p))
            for i in range(k + 1)
        ),
    )


def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    # Beyond the mean the tail exceeds any level asked for: no need to sum it.
    return pd.Series([1.0 if a >= b * c else binomial_tail(a, b, c) for a, b, c in zip(k, n, p)], dtype=float)


def certified_cutoffs(featured: DataFrame, labels: DataFrame, risk: Risk, doc_id: str = "doc_id") -> DataFrame:
    """Strictest certified cutoff per stratum and rule: ``_stratum``, ``_rule``, ``_cutoff``.

    featured: ``_id``, ``_stratum`` and the features. labels: doc_id, quality (1: good).
    Several labels of a document count as bad if one of them is; null ones don't count.
    """
    good = (
        labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(doc_id).cast("bigint").alias("_id"))
        .agg(F.min("quality").alias("_quality"))
        .where("_quality = 1")
    )
    ladder = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cut"), (value > cut).alias("hit"))
            for rule, value in measures().items()
            for cut in risk.cutoffs.get(rule, ())
        )
    )
    held_out = featured.where(~base_failed()).join(good, "_id", "left_semi")
    counts = (
        held_out.select("_stratum", F.explode(ladder).alias("t"))
        .groupBy("_stratum", F.col("t.rule").alias("_rule"), F.col("t.cut").alias("_cut"))
        .agg(F.count("*").alias("n"), F.count_if("t.hit").alias("k"))
    )
    rules = max(1, len(risk.cutoffs))
    tests = max(1, featured.select("_stratum").distinct().count() * sum(map(len, risk.cutoffs.values())))
    return (
        counts.where(F.pandas_udf(_tail, "double")("k", "n", F.lit(risk.alpha / rules)) <= risk.delta / tests)
        .groupBy("_stratum", "_rule")
        .agg(F.min("_cut").alias("_cutoff"))
    )


def _wide(cutoffs: DataFrame, risk: Risk) -> DataFrame:
    """One row per stratum, a column per rule (null: not certified)."""
    return cutoffs.groupBy("_stratum").agg(
        *(F.max(F.when(F.col("_rule") == rule, F.col("_cutoff"))).alias(f"_cut_{rule}") for rule in risk.cutoffs)
    )


def judged(featured: DataFrame, cutoffs: DataFrame, risk: Risk) -> DataFrame:
    """Adds ``base_failed``, ``rejected_by`` (rules, comma-joined, or '') and ``kept``."""
    known = measures()
    fails = [F.when(known[rule] > F.col(f"_cut_{rule}"), F.lit(rule)) for rule in risk.cutoffs]
    return (
        featured.join(_wide(cutoffs, risk), "_stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.concat_ws(",", *fails) if fails else F.lit(""))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    )


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, risk: Risk | None = None, text: str = "text", stratum: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, the features, base_failed, rejected_by, kept.

    Null or empty texts have no words and fail the base rule. Null strata are one stratum.
    Repeated rows are judged each; an empty table gives an empty result.
    The features are written once, narrow, and read for calibration and for the verdicts.
    """
    risk = risk or Risk()
    featured = materialize(
        with_features(docs, text, stratum).withColumn("_id", F.col("_row.doc_id").cast("bigint")).drop("_row"),
        "quality",
    )
    cutoffs = materialize(certified_cutoffs(featured, labels, risk), "cutoffs")
    names = [f.split()[0] for f in FEATURES.split(",")]
    return judged(featured, cutoffs, risk).select(
        F.col("_id").alias("doc_id"), *names, "base_failed", "rejected_by", "kept"
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, risk: Risk | None = None, text: str = "text", stratum: str = "lang"
) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    Calibration reads the texts once for their features; the verdicts are found where the
    texts are read again, so that no text is shuffled.
    """
    risk = risk or Risk()
    narrow = with_features(docs, text, stratum).withColumn("_id", F.col("_row.doc_id").cast("bigint")).drop("_row")
    cutoffs = materialize(certified_cutoffs(materialize(narrow, "quality"), labels, risk), "cutoffs")
    return unpacked(judged(with_features(docs, text, stratum), cutoffs, risk).where("kept"))
