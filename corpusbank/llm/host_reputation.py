"""URL filter: host rules, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are pooled per host, registered domain (last two labels) and
suffix (last label).  The bad rate of a suffix is shrunk to the overall rate, that of a domain to
its suffix, that of a host to its domain, each through a beta-binomial prior whose strength is
estimated from the spread between the groups of that level (moments).  A host is blocked when the
lower bound of its posterior bad rate exceeds ``threshold``; hosts without labelled pages have
their domain's prior, so they are judged by their surroundings.

Defined cases: a null url or one without ``://`` has an empty host and path; empty hosts pool like
any other host; a page without label counts in no rate; a repeated label row counts as bad if one
of its rows does; without any labels every host has rate 1/2 and is allowed (the bound stays
below the threshold); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.llm.common import ascii_lower, table
from corpusbank.session import stage

# (verdict, rule): host, then path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))
THRESHOLD = 0.5
Z = 1.645  # one-sided 95 %
MIN_SPREAD, MAX_SPREAD = 1e-4, 0.5


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule; null if none fits."""
    found = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def _spread(groups: DataFrame) -> float:
    """Beta-binomial correlation of the groups (_n, _k) around their prior means (_prior)."""
    n, k, m = F.col("_n"), F.col("_k"), F.col("_prior")
    row = groups.agg(
        F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)).alias("over"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("scale")).first()
    rho = row["over"] / row["scale"] if row["scale"] else MIN_SPREAD
    return min(max(rho, MIN_SPREAD), MAX_SPREAD)


def host_posteriors(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts (host, _n labelled pages, _k bad ones) with ``rate`` and its lower ``bound``.

    One aggregate row per level goes to the driver (the strength of its prior).
    """
    parts = F.split("host", r"\.", -1)
    hosts = hosts.withColumn("_suffix", F.element_at(parts, -1)).withColumn(
        "_domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))
    pool = [F.sum("_n").alias("_n"), F.sum("_k").alias("_k")]
    total = hosts.agg(*pool).first()
    overall = ((total["_k"] or 0) + 0.5) / ((total["_n"] or 0) + 1.0)

    def shrunk(groups: DataFrame) -> tuple[Column, float]:
        strength = 1.0 / _spread(groups) - 1.0
        return (F.col("_k") + strength * F.col("_prior")) / (F.col("_n") + strength), strength

    domains = hosts.groupBy("_domain", "_suffix").agg(*pool)
    suffixes = domains.groupBy("_suffix").agg(*pool).withColumn("_prior", F.lit(overall))
    suffixes = suffixes.select("_suffix", shrunk(suffixes)[0].alias("_prior"))
    domains = domains.join(suffixes, "_suffix")
    domains = domains.select("_domain", shrunk(domains)[0].alias("_prior"))
    hosts = hosts.join(domains, "_domain")
    rate, strength = shrunk(hosts)
    weight = F.col("_n") + F.lit(strength)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return hosts.withColumn("rate", rate).select(
        "host", F.col("_n").alias("n_labelled"), "rate",
        (F.col("rate") - z * deviation).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url",
               rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound for every page.

    ``outcomes`` has (page_id long, bad 0/1).  Pages are pooled to one row per host before
    anything else, and the hosts' verdicts join back on the host: the host table is broadcast
    when it is small, otherwise the pages of a hot host are split by adaptive execution.
    """
    named = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"),
                         url_path(F.col(url)).alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").cast("long").alias("_bad"))
    hosts = stage(
        named.select("page_id", "host").join(known, "page_id", "left")
        .groupBy("host").agg(F.count("_bad").alias("_n"),
                             F.coalesce(F.sum("_bad"), F.lit(0)).alias("_k")), "hosts")
    posteriors = stage(host_posteriors(hosts, z), "host-rates")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdicts = {r: v for v, r in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()])
    by_rate = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return named.join(posteriors, "host", "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_rate).alias("verdict"),
        "rate", "bound")


def op4_host_reputation(spark, sf_dir: str) -> DataFrame:
    """All pages.  A page's outcome is the quality label with its number (0: bad)."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.filter("quality IS NOT NULL").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
l AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k
      FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
g AS (SELECT *, string_split(host, '.')[-1] AS suffix,
             array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM g GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k,
             (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM h)::DOUBLE AS m
      FROM d GROUP BY suffix),
cs AS (SELECT 1.0::DOUBLE / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m))
              / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.0001), 0.0001), 0.5) - 1 AS c FROM s),
sp AS (SELECT suffix, (k + c * m) / (n + c) AS m FROM s, cs),
dm AS (SELECT d.*, sp.m FROM d JOIN sp USING (suffix)),
cd AS (SELECT 1.0::DOUBLE / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m))
              / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.0001), 0.0001), 0.5) - 1 AS c FROM dm),
dp AS (SELECT domain, (k + c * m) / (n + c) AS m FROM dm, cd),
hm AS (SELECT g.*, dp.m FROM g JOIN dp USING (domain)),
ch AS (SELECT 1.0::DOUBLE / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m))
              / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.0001), 0.0001), 0.5) - 1 AS c FROM hm),
hp AS (SELECT host, n + c AS w, (k + c * m) / (n + c) AS rate FROM hm, ch),
hv AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) AS bound FROM hp),
r AS (SELECT page_id, p.host, path, bound, CASE
        WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/')
          THEN 'example.net/en/'
        WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/')
          THEN 'example.com/de/'
        WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
      END AS rule FROM p LEFT JOIN hv ON p.host = hv.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
