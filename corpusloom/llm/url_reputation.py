"""URL filter by empirical-Bayes host reputation (operator 10).

Labelled page outcomes are counted per host, rolled up to registered domains and
suffixes, and shrunk through beta-binomial priors from the top down: the posterior
mean of a suffix is the prior mean of its domains, that of a domain the prior mean
of its hosts.  The strength of each prior is estimated from the data by moments.
A page is kept when the lower posterior bound of its host reaches the cutoff.

Suffixes: the last label of a host, or the last two where the last one has two letters (a
country) and the one before is among SECOND_LEVEL, as in ``co.uk``; a registered domain is
one label more.  IP hosts are domains of their own under the suffix ``ip``.  This is a rule,
not a list of all public suffixes: hosting sites such as ``x.github.io`` are one domain.

Defined results: a null url, or one without ``://``, has an empty host and path and
is judged by the empty suffix; repeated rows are judged alike; a label that repeats
for a page counts once, with its largest outcome; without any label all hosts get
``default_mean``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
CUTOFF, Z, DEFAULT_MEAN = 0.5, 1.645, 0.5
#: Labels that stand for registries below a country's suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: Limits of the intra-class correlation rho; a prior is worth 1 / rho - 1 outcomes.
RHO_MIN, RHO_MAX = 0.001, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    numeric = F.rlike(bare, F.lit(r"^[0-9.]+$")) | F.rlike(bare, F.lit(r"^\[|:"))
    deep = F.rlike(bare, F.lit(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"))
    suffix = F.when(numeric, "ip").when(deep, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return suffix, F.when(numeric, bare).when(deep, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row, k: the prior strength by moments of (n, good) around the column mean."""
    pq = F.col(mean) * (1 - F.col(mean))
    over = F.sum((F.col("good") - F.col("n") * F.col(mean)) * (F.col("good") - F.col("n") * F.col(mean)) - F.col("n") * pq)
    room = F.sum(F.col("n") * (F.col("n") - 1) * pq)
    rho = F.greatest(F.lit(RHO_MIN), F.least(F.lit(RHO_MAX), F.coalesce(F.try_divide(over, room), F.lit(RHO_MAX))))
    return groups.agg(rho.alias("rho")).select((1 / F.col("rho") - 1).alias("k"), F.lit(1).alias("one"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, z: float = Z, default_mean: float = DEFAULT_MEAN) -> DataFrame:
    """Per host of pages (page_id, url): host, n, good, mean, bound.

    outcomes: (page_id, good), good 1 or 0; null outcomes and pages are left out.
    Sizes: one row per host is shuffled; the strengths are one row per level.
    """
    seen = outcomes.select("page_id", F.col("good").cast("int").alias("good")).dropna().groupBy("page_id").agg(F.max("good").alias("good"))
    labelled = pages.select("page_id", url_parts(F.col("url"))[0].alias("host")).join(seen, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    # What follows is over hosts, of which each level's strength needs a pass: they are counted once.
    hosts = materialize(hosts, "hosts")
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top = suffixes.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(default_mean)).alias("top_mean")).withColumn("one", F.lit(1))

    def shrunk(groups: DataFrame, prior: str, mean: str) -> DataFrame:
        """Adds the posterior mean under the prior mean and the level's strength, and the weight."""
        groups = groups.withColumn("one", F.lit(1)).join(F.broadcast(_strength(groups, prior)), "one")
        return groups.withColumn(mean, (F.col("k") * F.col(prior) + F.col("good")) / (F.col("k") + F.col("n"))).withColumn("weight", F.col("k") + F.col("n")).drop("one", "k")

    suffixes = shrunk(suffixes.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").drop("one"), "top_mean", "suffix_mean")
    domains = shrunk(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean")
    hosts = shrunk(hosts.join(domains.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]), "domain_mean", "mean")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - F.lit(z) * sd).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, cutoff: float = CUTOFF, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every row of pages (page_id, url).

    The join on the host is a plain equi-join, so that adaptive execution may split a hot host.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = host_reputation(pages, outcomes, z=z).select("host", F.when(F.col("bound") >= cutoff, "allow").otherwise("block").alias("own"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("own")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page is good if the document with its id is of quality and not toxic.
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)


SQL = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages
), rows AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), seen AS (
  SELECT doc_id AS page_id, max((quality = 1 AND toxic = 0)::INT) AS good FROM labels WHERE doc_id IS NOT NULL AND (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id
), h0 AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS good FROM rows LEFT JOIN seen USING (page_id) GROUP BY host
), h AS (
  SELECT *, CASE WHEN ip THEN b ELSE array_to_string(list_slice(string_split(b, '.'), CASE WHEN deep THEN -3 ELSE -2 END, -1), '.') END AS domain,
         CASE WHEN ip THEN 'ip' ELSE array_to_string(list_slice(string_split(b, '.'), CASE WHEN deep THEN -2 ELSE -1 END, -1), '.') END AS suffix
  FROM (SELECT *, regexp_matches(b, '^[0-9.]+$') OR regexp_matches(b, '^\[|:') AS ip, regexp_matches(b, '(^|\.)(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z]$') AS deep
        FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS b FROM h0))
), d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM d GROUP BY suffix),
top AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good)::DOUBLE / sum(n)::DOUBLE ELSE 0.5::DOUBLE END AS m FROM s),
ks AS (
  SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
         THEN sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5::DOUBLE END)) - 1 AS k
  FROM s, top
), sm AS (SELECT suffix, (k * m + good) / (k + n) AS m FROM s, top, ks),
dp AS (SELECT d.*, sm.m FROM d JOIN sm USING (suffix)),
kd AS (
  SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
         THEN sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5::DOUBLE END)) - 1 AS k
  FROM dp
), dm AS (SELECT domain, suffix, (k * m + good) / (k + n) AS m FROM dp, kd),
hp AS (SELECT h.*, dm.m FROM h JOIN dm USING (domain, suffix)),
kh AS (
  SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
         THEN sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.5::DOUBLE END)) - 1 AS k
  FROM hp
), hm AS (SELECT host, (k * m + good) / (k + n) AS m, k + n AS w FROM hp, kh),
own AS (SELECT host, CASE WHEN m - 1.645::DOUBLE * sqrt(m * (1 - m) / (w + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS own FROM hm),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM rows
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict
FROM ruled JOIN own USING (host)
"""
