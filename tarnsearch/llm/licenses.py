"""License scans: blocks of text that contain a license template, by an exact set-similarity join.

Blocks are windows of words at every half window. A template is looked for in windows of ``window``
words, doubled until they have twice its words: any run of as many words as the template has lies
in one block, however long the template. A block meets a template if it has
at least ``percent`` of the template's distinct words. Words of the templates are ordered by
the number of documents that have them, rarest first, over the whole corpus. Then

- prefix: a block that meets a template of t words, m of them needed, shares one of the
  template's first t - m + 1 words; only those are indexed, and a block offers its own prefix only;
- length: a block with fewer than m template words is no candidate, nor is any block of a document
  with fewer than the least m of its window's templates;
- position: words after the shared one, on the shorter side, must be enough for m;

and candidates are confirmed on whole sets. The templates are a parameter; their words are shipped
as literals (``MOST_WORDS`` at most), the blocks are never shuffled. Texts are cut into words once;
the words of documents that the length filter leaves are written for the second pass. Beside
the join, the plain naming phrases are found where their words stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import LOWER, PLAIN_WORD, UPPER, ascii_lower, document_key, whole
from tarnsearch.plans.work import materialize

MOST_WORDS = 20_000

# Naming phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Notices as their licenses ask for them, and whole short licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction",
    ),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction including"
        " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"
        " of the software and to permit persons to whom the software is furnished to do so subject to the"
        " following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any"
        " kind express or implied including but not limited to the warranties of merchantability fitness for a"
        " particular purpose and noninfringement in no event shall the authors or copyright holders be liable for"
        " any claim damages or other liability whether in an action of contract tort or otherwise arising from out"
        " of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met redistributions of source code must retain the above copyright"
        " notice this list of conditions and the following disclaimer redistributions in binary form must reproduce"
        " the above copyright notice this list of conditions and the following disclaimer in the documentation and"
        " or other materials provided with the distribution this software is provided by the copyright holders and"
        " contributors as is and any express or implied warranties including but not limited to the implied"
        " warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the"
        " copyright holder or contributors be liable for any direct indirect incidental special exemplary or"
        " consequential damages including but not limited to procurement of substitute goods or services loss of"
        " use data or profits or business interruption however caused and on any theory of liability whether in"
        " contract strict liability or tort including negligence or otherwise arising in any way out of the use of"
        " this software even if advised of the possibility of such damage",
    ),
)


@dataclass(frozen=True)
class LicenseScan:
    phrases: Sequence[tuple[str, str]] = PHRASES
    templates: Sequence[tuple[str, str]] = TEMPLATES
    percent: int = 80
    window: int = 128  # of templates up to half its words


def _places(phrase: list[str]) -> Column:
    """Where the words of a phrase stand consecutively, as word numbers from 0."""

    def starts(i: Column) -> Column:
        found = F.get("words", i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            found = found & (F.get("words", i + k) == word)
        return F.coalesce(found, F.lit(False))

    nowhere = F.array().cast("array<int>")
    everywhere = F.sequence(F.lit(0), F.size("words") - 1)
    return F.when(F.array_contains("words", phrase[0]), F.filter(everywhere, starts)).otherwise(nowhere)


def _csv(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _array(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def template_words(body: str) -> list[str]:
    return re.findall(PLAIN_WORD, body.translate(str.maketrans(UPPER, LOWER)))


def window_of(body: str, window: int) -> int:
    """``window``, doubled until it has twice the template's words."""
    while window < 2 * len(template_words(body)):
        window *= 2
    return window


def scan_licenses(docs: DataFrame, how: LicenseScan | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are the smallest and largest of
    them (null without any). labels has the templates' too. score is the largest containment
    of a template that some block meets, or 0. A null or empty text has no words. Every row counts: rows
    that repeat another give the same result again, an empty table gives no rows. Columns of docs other than doc_id
    and the text are not looked at.
    """
    how = how or LicenseScan()
    if how.window < 2:
        raise ValueError("a window has two words or more")
    templates = [
        (label, window_of(body, how.window), sorted(set(template_words(body))))
        for label, body in how.templates
        if template_words(body)
    ]
    vocabulary = sorted({w for *_, words in templates for w in words})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    if not templates:
        raise ValueError("no template has a word")
    windows = sorted({window for _, window, _ in templates})
    fewest = {
        window: min(_needed(len(words), how.percent) for _, w, words in templates if w == window) for window in windows
    }
    of_window = {window: {x for _, w, words in templates if w == window for x in words} for window in windows}

    found = [(label, _places(phrase.split())) for phrase, label in how.phrases]
    base = F.concat(F.array().cast("array<int>"), *(places for _, places in found))
    labels = F.filter(
        F.array(*(F.when(F.size(places) > 0, F.lit(label)) for label, places in found)).cast("array<string>"),
        lambda x: x.isNotNull(),
    )

    def enough(window: int) -> Column:
        """Whether the document has words for some template of the window."""
        known = F.array_intersect("known", _array(sorted(of_window[window])))
        return F.size(known) >= fewest[window]

    any_enough = F.lit(False)
    for window in windows:
        any_enough = any_enough | enough(window)
    scanned = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            document_key().alias("id"),
            F.unhex(F.md5(whole(text))).alias("digest"),
            F.regexp_extract_all(ascii_lower(whole(text)), F.lit(PLAIN_WORD), F.lit(0)).alias("words"),
        )
        .withColumn("known", F.array_intersect("words", _array(vocabulary)))
        .select(
            "doc_id",
            "id",
            "digest",
            "known",
            F.size("words").cast("bigint").alias("n_words"),
            F.when(F.size("words") > 0, base).otherwise(F.array().cast("array<int>")).alias("places"),
            F.when(F.size("words") > 0, labels).otherwise(F.array().cast("array<string>")).alias("base"),
            F.when(any_enough, F.col("words")).alias("words"),
        ),
        "scanned",
    )

    # Documents per template word: one row per word of the templates.
    counts = scanned.select(F.explode("known").alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    ordered = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(ordered)}
    index, whole_sets = [], []
    for number, (label, window, words) in enumerate(templates):
        words = sorted(words, key=place.__getitem__)
        needed = _needed(len(words), how.percent)
        index += [
            (window, word, number, i, needed, len(words)) for i, word in enumerate(words[: len(words) - needed + 1])
        ]
        whole_sets.append((number, label, words))

    def prefix(words: Column, least: Column) -> Column:
        return F.slice(words, F.lit(1), F.greatest(F.size(words) - least + 1, F.lit(0)))

    def blocks(window: int) -> Column:
        half, least = window // 2, F.lit(fewest[window])
        words = _array([w for w in ordered if w in of_window[window]])
        indexed = _array(sorted({row[1] for row in index if row[0] == window}))
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - half - 1, F.lit(0)), F.lit(half))
        every = F.transform(
            starts,
            lambda start: F.struct(
                F.lit(window).alias("window"),
                start.alias("start"),
                F.array_intersect(words, F.slice("words", start + 1, F.lit(window))).alias("block"),
            ),
        )
        some = F.filter(
            every, lambda b: (F.size(b["block"]) >= least) & F.arrays_overlap(prefix(b["block"], least), indexed)
        )
        return F.when(enough(window), some).otherwise(F.slice(every, 1, 0))

    spark = docs.sparkSession
    entries = spark.createDataFrame(index, "window int, word string, template int, i int, needed int, n int")
    sets = spark.createDataFrame(whole_sets, "template int, label string, template_words array<string>")
    least = F.element_at(F.create_map(*(F.lit(x) for pair in fewest.items() for x in pair)), F.col("window"))
    met = (
        scanned.where("words is not null")
        .select("id", "digest", F.explode(F.concat(*map(blocks, windows))).alias("b"))
        .select("id", "digest", "b.*")
        .select("*", F.posexplode(prefix(F.col("block"), least)).alias("j", "word"))
        .join(F.broadcast(entries), ["window", "word"])  # bounded by MOST_WORDS and the templates
        .where(F.size("block") >= F.col("needed"))
        .where(F.least(F.col("n") - F.col("i"), F.size("block") - F.col("j")) >= F.col("needed"))
        .dropDuplicates(["id", "digest", "start", "template"])
        .join(F.broadcast(sets), "template")  # a row per template
        .withColumn("shared", F.size(F.array_intersect("block", "template_words")))
        .where("shared >= needed")
        .groupBy("id", "digest")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("n")).alias("score"))
    )
    return scanned.drop("words", "known").join(met, ["id", "digest"], "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        _csv(F.col("base")).alias("base_labels"),
        _csv(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
