"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) are summed by host, registered domain
(one label and the suffix) and suffix (the last label, or two where the last
but one is a registry such as ``co`` under a country). Ports and user names
count for nothing; an address in numbers is its own domain. Each level's rate is shrunk
towards the posterior mean of the level above by a beta-binomial prior whose
strength is estimated from the level itself by moments; a host is allowed if
the lower bound of its posterior, ``z`` standard deviations below the mean,
reaches ``least_good``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

#: (verdict, host/path): fixed values of the query's contract.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
Z, LEAST_GOOD = 1.645, 0.5
#: Labels under a two-letter country that registries keep for themselves.
REGISTRIES = "ac co com edu go gob gov gv id ltd me mil ne net nhs nom or org plc sch".split()
_UNDER = rf"(^|\.)({'|'.join(REGISTRIES)})\.[a-z][a-z]$"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are a short list that the driver holds."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def site(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    number = name.rlike(r"^[0-9.]*$") | name.startswith("[")
    suffix = F.when(number, name).when(name.rlike(_UNDER), F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    rest = F.regexp_extract(F.left(name, F.length(name) - F.length(suffix) - 1), r"([^.]*)$", 1)
    return F.when(name == suffix, name).otherwise(F.concat(rest, F.lit("."), suffix)), suffix


def _strength(level: DataFrame) -> float:
    """Prior strength a + b of units (n, y) round their parents' means m (columns n, y, m), by moments."""
    p = level.filter("n > 0").withColumn("m", F.least(F.greatest("m", F.lit(1e-6)), F.lit(1 - 1e-6)))
    total = F.sum("n")
    s, k, pairs = p.agg(F.sum(F.col("n") * (F.col("y") / F.col("n") - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))), F.count("*"), total - F.count("*")).first()
    if not k or pairs is None or pairs <= 0:
        return 2.0
    rho = min(max((s - k) / pairs, 1e-3), 1 / 3)
    return 1 / rho - 1


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, n labelled pages, y good ones) -> host, mean, low: posterior mean and its lower bound.

    Without any outcome every host has the prior of one good and one bad page.
    """
    domain, suffix = site(F.col("host"))
    h = cut(hosts.select("host", "n", "y", domain.alias("domain"), suffix.alias("suffix")))
    d = cut(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("hosts")))
    s = cut(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("domains")))
    n, y = d.agg(F.sum("n"), F.sum("y")).first()
    m0 = (y + 1) / (n + 2) if n else 0.5
    k = _strength(s.withColumn("m", F.lit(m0)))
    s = s.select("suffix", "domains", ((F.lit(k * m0) + F.col("y")) / (k + F.col("n"))).alias("m"))
    d = cut(attach(d, s, "suffix", "domains", d.count()))
    k = _strength(d)
    d = d.select("domain", "hosts", ((k * F.col("m") + F.col("y")) / (k + F.col("n"))).alias("m"))
    h = cut(attach(h.select("host", "domain", "n", "y"), d, "domain", "hosts", h.count()))
    k = _strength(h)
    a, b = k * F.col("m") + F.col("y"), k * (1 - F.col("m")) + F.col("n") - F.col("y")
    low = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", (a / (a + b)).alias("mean"), low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id", least_good: float = LEAST_GOOD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_mean, host_low.

    ``outcomes`` (page_id, good 0/1): several for one id count by their
    largest; ids that are null or in no page, and null outcomes, count for
    nothing. A null url, or one without ``://``, has an empty host and path
    and is judged as the host "". Repeated rows are judged alike; no pages
    give no rows.
    """
    host, path = host_path(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    known = outcomes.filter("good IS NOT NULL").groupBy("page_id").agg(F.max("good").cast("long").alias("good"))
    hosts = p.join(known, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("y"), F.count("*").alias("pages"))
    hosts = cut(hosts)
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    seen = attach(p, cut(reputations(hosts).join(hosts.select("host", "pages"), "host")), "host", "pages", total)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") >= least_good, "allow").otherwise("block")
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("host_mean"), F.col("low").alias("host_low"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality that ``labels`` gives to the id of the page."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_UNIT = "sum(n * (y / n - m) ^ 2 / (m * (1 - m))) FILTER (n > 0) AS s, count(*) FILTER (n > 0) AS k, sum(n) - count(*) FILTER (n > 0) AS pairs"
_K = "CASE WHEN k > 0 AND pairs > 0 THEN 1 / least(greatest((s - k) / pairs, 1e-3), 1.0 / 3) - 1 ELSE 2.0 END"
_FITS = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN"
_CASES = [(w, r, _FITS.format(h=r[: r.index("/")], p=r[r.index("/") :])) for w, r in sorted(RULES, key=lambda r: -len(r[1]))]
OP6_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT doc_id, max(quality)::BIGINT AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h2 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS y,
              regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name
       FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY host),
h3 AS (SELECT *, CASE WHEN regexp_full_match(name, '[0-9.]*') OR starts_with(name, '[') THEN name
                      WHEN regexp_matches(name, '{_UNDER}') THEN regexp_extract(name, '([^.]*\\.[^.]*)$', 1)
                      ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM h2),
h AS (SELECT host, n, y, suffix, CASE WHEN name = suffix THEN name ELSE concat(regexp_extract(left(name, length(name) - length(suffix) - 1), '([^.]*)$', 1), '.', suffix) END AS domain FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
g AS (SELECT (sum(y) + 1) / (sum(n) + 2) AS m FROM d),
s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(m) AS m FROM d, g GROUP BY suffix),
sk AS (SELECT {_K} AS k FROM (SELECT {_UNIT} FROM s0)),
s1 AS (SELECT suffix, (k * m + y) / (k + n) AS m FROM s0, sk),
d0 AS (SELECT domain, n, y, m FROM d JOIN s1 USING (suffix)),
dk AS (SELECT {_K} AS k FROM (SELECT {_UNIT} FROM d0)),
d1 AS (SELECT domain, (k * m + y) / (k + n) AS m FROM d0, dk),
h0 AS (SELECT host, n, y, m FROM h JOIN d1 USING (domain)),
hk AS (SELECT {_K} AS k FROM (SELECT {_UNIT} FROM h0)),
h1 AS (SELECT host, k * m + y AS a, k * (1 - m) + n - y AS b FROM h0, hk)
SELECT page_id, host, path,
       CASE {" ".join(f"{c} '{r}'" for _, r, c in _CASES)} END AS rule,
       CASE {" ".join(f"{c} '{w}'" for w, _, c in _CASES)}
            WHEN a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {LEAST_GOOD} THEN 'allow' ELSE 'block' END AS verdict
FROM p JOIN h1 USING (host)
"""
