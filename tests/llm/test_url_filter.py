"""URL filter: hosts, paths, rules and reputation on odd rows."""

from pyspark.sql import functions as F

from tracelake.llm import url_filter as U


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/1?q=/x", "x://example.org", "http://example.org/en/12", "http://xexample.org/en/1#f", "a.com/fr/", None, "", "http://b.com/fr/#?", "https://b.com/de/x", "u://c.net://d/p"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, host string")
    good = spark.createDataFrame([(9, 0), (9, 1), (None, 1), (77, 1), (1, None)], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in U.judge(pages, good).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/"), 1: ("example.org", "", None), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("xexample.org", "/en/1", "org/"),
        4: ("", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("b.com", "/fr/", "com/fr/"), 8: ("b.com", "/de/x", "com/de/"), 9: ("c.net:", "//d/p", None),
    }
    assert U.judge(pages.limit(0), good).count() == 0
    assert U.judge(pages, good.limit(0)).count() == len(urls)


def test_reputation_shrinks_to_the_level_above(spark):
    hosts = [(f"good{i}.a.net", 40.0, 39.0) for i in range(20)] + [("bad.a.net", 40.0, 1.0), ("new.a.net", 0.0, 0.0), ("one.a.net", 1.0, 0.0)]
    got = {r["host"]: r for r in U.reputations(spark.createDataFrame(hosts, "host string, n double, y double")).collect()}
    assert got["bad.a.net"]["low"] < got["bad.a.net"]["mean"] < 0.3 < got["one.a.net"]["mean"] < got["new.a.net"]["mean"] < got["good1.a.net"]["mean"]


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "www.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.co.de.net": ("de.net", "net"), "localhost": ("localhost", "localhost"),
        "10.1.2.3:8080": ("10.1.2.3", "10.1.2.3"), "[::1]:80": ("[::1]", "[::1]"), "me@www.example.org:443": ("example.org", "org"), "example.org.": ("example.org", "org"), "": ("", ""),
    }
    domain, suffix = U.site(F.col("h"))
    got = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in want], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == want
