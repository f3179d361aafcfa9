"""URL filters: host-suffix and path-prefix rules met by hash. DataFrame operations only.

A URL is expanded into the expressions that could be a rule: each suffix of its host at a dot
with each prefix of its path as long as some rule's path. An expression meets the rules by the
first 4 bytes of its SHA-256 in an equi-join; full digests are then compared. Of the rules that
fit, the longest wins. Distinct URLs are expanded once, with their expressions as narrow
rows; a hot URL is one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.text import ascii_lower
from tarnsearch.plans.work import materialize

# The verdict on a URL that no rule fits.
OTHERWISE = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host has no blank to be confused with the one between: rules and URLs are told apart in full.
    return F.sha2(F.concat(F.octet_length(host).cast("string"), F.lit(" "), host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """From host, path, action: one row per host and path, with digests. ``block`` wins over ``allow``.

    Rules with a null, or with an empty host, fit nothing.
    """
    known = (
        rules.where("host <> '' and path is not null and action in ('allow', 'block')")
        .groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("action").alias("action"))
    )
    full = _digest(F.col("r_host"), F.col("r_path"))
    return known.select("*", full.alias("r_digest"), _short(full).alias("short"))


def _expressions(lengths: list[int]) -> Column:
    """Host suffixes, whole hosts first, with path prefixes of the rules' lengths."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    usable = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    return F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                usable, lambda n: F.struct(h.alias("h"), F.substring("path", F.lit(1), n).alias("p"))
            ),
        )
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that wins, else null), verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest
    fitting rule wins; of equally long ones that with the longer host, then ``block``. A null URL, or one
    without ``://``, has an empty host and no rule. Rows that repeat another give the same
    result again; an empty table gives no rows.
    """
    rules = materialize(prepared_rules(rules), "rules")
    # Lengths of paths among the rules: as many as there are lengths, not rules.
    lengths = sorted(r.n for r in rules.select(F.length("r_path").alias("n")).distinct().collect())
    located = pages.select(
        "page_id",
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    ).withColumn(
        # No rule fits without a host: such rows need not meet under one key. No host has a slash.
        "meets",
        F.when(F.col("host") == "", F.concat(F.lit("/"), F.xxhash64("page_id", "path"))).otherwise(F.col("host")),
    )
    places = materialize(located.where("host <> ''").select("host", "path").distinct(), "places")
    full = _digest(F.col("e.h"), F.col("e.p"))
    fitting = (
        places.select("host", "path", F.explode(_expressions(lengths)).alias("e"))
        .select("host", "path", full.alias("digest"))
        .withColumn("short", _short(F.col("digest")))
        .join(rules, "short")
        .where("digest = r_digest")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length(F.concat("r_host", "r_path")).alias("length"),
                    F.length("r_host").alias("of_host"),
                    (F.col("action") == "block").alias("strict"),
                    F.concat("r_host", "r_path").alias("rule"),
                    "action",
                )
            ).alias("best")
        )
    )
    return located.join(fitting.withColumnRenamed("host", "meets"), ["meets", "path"], "left").select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(otherwise)).alias("verdict"),
    )
