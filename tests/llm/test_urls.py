from collections import Counter

from pyspark.sql import functions as F

from tarnsearch.llm.urls import filter_urls

PAGES = "page_id bigint, url string, html string"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("org", "/fr/", "block"), ("a.org", "/fr/x", "allow"), ("", "/", "block"), (None, "/", "block"), ("b.c", "", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h.lower() + p), len(h), a == "block", h.lower() + p, a)
        for h, p, a in RULES
        if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_equals_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://net", "http://net/", "x://A.NET/q?u=://org/fr/", "http://example.net/en/1",
            "http://w.example.net/en", "http://notexample.net/en/", "http://example.com/de/é#x", "http://org/fr/", "http://a.org/fr/xy",
            "http://b.c", "http://b.c?x", "http://a..b.c/", "http://É.net/\n/x", "http://" + "a." * 200 + "net/" + "p" * 5000,
            "http://example.net:80/en/"]
    rows = [(i % 15, u, "x") for i, u in enumerate(urls + urls[4:6] * 3)] + [(None, urls[7], None)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS short")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    found = sorted((tuple(r) for r in filter_urls(pages, rules).collect()), key=str)
    assert found == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert filter_urls(pages, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_rows_without_a_host_are_spread(spark):
    """A third of all rows without a host does not meet in one task."""
    urls = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'http://h' || id || '.net/' END AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    hints = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hints}
    try:
        for k, v in hints.items():
            spark.conf.set(k, v)
        found = filter_urls(urls, rules).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 3000 and all((r.rule == "net/") == (r.host != "") for r in found)
    hostless = Counter(r.task for r in found if r.host == "")
    assert sum(hostless.values()) == 1000 and max(hostless.values()) < 500
