"""Operator 5: URL filters by rules and by an empirical-Bayes host reputation.

Native DataFrame expressions throughout. A page's url gives a host and a path; the longest
matching rule decides. Where no rule matches, the host's reputation decides: labelled page
outcomes (1 = bad) are counted per host, and beta-binomial priors shrink them level by level,

    all pages -> public suffix -> registered domain -> host.

The prior of each level has its parent's posterior mean, and a strength fitted on all children of
that level by the method of moments (intraclass correlation ``rho``, strength ``1/rho - 1``). A host
is blocked if the lower credible bound of its bad share exceeds ``max_bad``. The bound is the posterior's mean
less ``Z`` of its deviations; it differs from the 5 % quantile of the beta distribution by 0.06 at most
where that is near one half and the posterior has the weight of ten pages.

Defined cases: null or scheme-less urls have empty host and path and take the prior of all pages;
hosts without outcomes take their domain's prior; null outcomes are left out; repeated pages are
judged one by one; with no outcomes at all nothing is blocked. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: One-sided 95 % bound; block where even the lower bound of the bad share is above this.
Z, MAX_BAD = 1.645, 0.5
#: Bounds of a fitted prior strength, in pseudo-pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "id.au", "net.au",
    "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr",
    "com.br", "edu.br", "gov.br", "net.br", "org.br", "com.ar", "gob.ar", "org.ar", "com.mx", "gob.mx", "org.mx", "com.co", "com.pe", "com.ve",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "org.hk", "com.tw", "org.tw", "com.sg", "edu.sg", "com.my", "co.id", "or.id",
    "co.th", "in.th", "com.ph", "com.vn", "co.in", "net.in", "org.in", "gov.in", "com.pk", "com.bd", "co.il", "org.il", "com.tr", "org.tr",
    "com.sa", "com.eg", "co.za", "org.za", "co.ke", "com.ng", "com.gh", "com.pl", "net.pl", "org.pl", "com.pt", "com.es", "org.es", "com.gr",
    "com.ua", "com.ru", "co.at", "or.at", "co.hu",
)
IP = r"^(\d+(\.\d+){3}|\[.*\])$"


def site_of(host: Column) -> Column:
    """The host without user, port and a dot at its end."""
    return F.regexp_replace(host, r"^.*@|:\d*$|\.(:\d*)?$", "")


def suffix_of(site: Column) -> Column:
    """The public suffix; an address is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(IP), site).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """The registered domain: the public suffix and the label before it; the whole site if it has no more labels."""
    return F.when(site.rlike(IP), site).when(F.substring_index(site, ".", -2).isin(*SUFFIXES), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest matching rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame) -> float:
    """The strength of a level's prior, by moments: children have (n, bad, prior)."""
    m = F.col("prior")
    x = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / F.greatest(m * (1 - m), F.lit(1e-9)))
    rho = (x - F.count("*")) / F.greatest(F.sum("n") - F.count("*"), F.lit(1.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (MAX_STRENGTH + 1))), F.lit(1 / (MIN_STRENGTH + 1)))
    return children.filter("n > 0").agg((1 / rho - 1).alias("strength")).first()["strength"]


def _mean(strength: float) -> Column:
    return (F.col("bad") + F.lit(strength) * F.col("prior")) / (F.col("n") + F.lit(strength))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Posterior of each host of ``hosts`` (host): n, bad, alpha, beta, mean, lower bound.

    ``outcomes`` has (host, bad): one row for each labelled page. Counts by site (the host without user and
    port) are stored once; each level is an aggregate of them, and four numbers come to the driver.
    """
    site = site_of(F.col("host"))
    counts = outcomes.filter(F.col("bad").isNotNull()).groupBy(site.alias("site")).agg(F.count("*").alias("n"), F.sum("bad").cast("double").alias("bad"))
    seen = stored(counts.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}), "sites")
    total = seen.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    prior = (total["bad"] + 0.5) / (total["n"] + 1.0)
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = seen.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(prior))
    k_suffix = _strength(by_suffix)
    suffix = by_suffix.select("suffix", _mean(k_suffix).alias("prior"))
    by_domain = seen.groupBy("suffix", "domain").agg(*sums).join(suffix, "suffix")
    k_domain = _strength(by_domain)
    domain = stored(by_domain.select("domain", _mean(k_domain).alias("domain_mean")), "domains")
    strength = F.lit(_strength(seen.join(domain.withColumnRenamed("domain_mean", "prior"), "domain")))
    # hosts without outcomes take the mean of the level above that has some
    own = hosts.select("host").distinct().withColumn("site", site).withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))})
    own = own.join(seen.select("site", "n", "bad"), "site", "left").join(domain, "domain", "left")
    own = own.join(suffix.withColumnRenamed("prior", "suffix_mean"), "suffix", "left")
    own = own.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0.0)).alias("bad"), F.coalesce("domain_mean", "suffix_mean", F.lit(prior)).alias("prior"))
    a, b = F.col("bad") + strength * F.col("prior"), F.col("n") - F.col("bad") + strength * (1 - F.col("prior"))
    post = own.select("host", "n", "bad", a.alias("alpha"), b.alias("beta"))
    a, b = F.col("alpha"), F.col("beta")
    return post.withColumn("mean", a / (a + b)).withColumn("lower", F.col("mean") - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """Rows of ``pages`` (page_id, url) with host, path, rule, verdict and the host's posterior.

    ``outcomes`` has (page_id, bad), bad 0, 1 or null.
    """
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = split.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    # stored, so that both sides of the last join are plain shuffles, which Spark splits where a host is frequent
    hosts = stored(host_reputation(judged, split).select("host", F.col("mean").alias("bad_share"), "lower"), "reputation")
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(hosts, "host", "left").select(
        "page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_share", "lower"
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes by id: a labelled row is bad if it is toxic or of low quality.

    The label table numbers its rows as the crawl does, so that page ``n`` takes the label of
    record ``n``; pages without a label have no outcome. Repeated labels count once, the worst.
    """
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0)
    return labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


_SITE = r"regexp_replace(host, '^.*@|:\d*$|\.(:\d*)?$', '', 'g')"
_FIT = f"1 / least(greatest(coalesce((sum(n * pow(bad / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / greatest(sum(n) - count(*), 1.0), 0.0), 1 / {MAX_STRENGTH + 1}), 1 / {MIN_STRENGTH + 1}) - 1 AS k"
_LAST = "array_to_string(list_slice(string_split(site, '.'), -{}, -1), '.')"
_LEVELS = f"""CASE WHEN regexp_matches(site, '{IP}') THEN site WHEN {_LAST.format(2)} IN {SUFFIXES} THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain,
    CASE WHEN regexp_matches(site, '{IP}') THEN site WHEN {_LAST.format(2)} IN {SUFFIXES} THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix"""
SQL = rf"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN coalesce(toxic, quality) IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id),
seen AS (
  SELECT *, {_LEVELS} FROM (
    SELECT {_SITE} AS site, count(*) AS n, CAST(sum(bad) AS DOUBLE) AS bad
    FROM split JOIN outcomes USING (page_id) WHERE bad IS NOT NULL GROUP BY 1)),
total AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM seen),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY suffix),
fit_s AS (SELECT {_FIT} FROM by_suffix, total),
suffix AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM by_suffix, total, fit_s),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY domain, suffix),
fit_d AS (SELECT {_FIT} FROM by_domain JOIN suffix USING (suffix)),
domain AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM by_domain JOIN suffix USING (suffix), fit_d),
fit_h AS (SELECT {_FIT} FROM seen JOIN domain USING (domain)),
hosts AS (SELECT *, {_LEVELS} FROM (SELECT DISTINCT host, {_SITE} AS site FROM split)),
post AS (
  SELECT host, coalesce(seen.bad, 0) + k * p AS a, coalesce(seen.n, 0) - coalesce(seen.bad, 0) + k * (1 - p) AS b
  FROM (SELECT host, site, coalesce(d.m, s.m, total.m) AS p FROM hosts LEFT JOIN domain d USING (domain) LEFT JOIN suffix s USING (suffix), total)
  LEFT JOIN seen USING (site), fit_h),
bound AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lo FROM post)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN lo > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
LEFT JOIN bound USING (host)
"""
