"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted per host. A beta-binomial prior is fitted by moments at each level of the
hierarchy (all -> suffix -> registered domain -> host), and each level's posterior mean is the next one's prior mean,
so that a host with few labels leans on its domain and a domain on its suffix. A host is blocked when the lower bound
of its rate of bad pages is over ``max_bad``. Only DataFrame expressions are used.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the reputation of the empty
host; pages with null ids have no outcomes; repeated pages and labels count each time; without any label every host has
the flat prior 1/2 with weight 2, and its bound is under max_bad; columns beside those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, stage

# The rules of the query, as (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Suffixes of two labels; other hosts have a suffix of one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in", "com.cn")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """z: standard deviations below the mean of the bound. max_bad: bound over which a host is blocked."""

    z: float = 1.645
    max_bad: float = 0.3
    least_weight: float = 0.5
    most_weight: float = 200.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its verdict. Of rules of one length, block comes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        name, at, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(at + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; an address or a single label is its own domain, with an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    lone = (F.size(labels) < 2) | bare.rlike(r"^[0-9.]+$|^\[") | (F.element_at(labels, -1) == "")
    last = lambda n: F.concat_ws(".", F.slice(labels, -n, n))
    k = F.when(last(2).isin(*LONG_SUFFIXES) & (F.size(labels) > 2), 2).otherwise(1)
    suffix = F.when(lone, "").when(k == 2, last(2)).otherwise(last(1))
    domain = F.when(lone, bare).when(k == 2, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(last(2))
    return domain, suffix


def prior_weight(groups: DataFrame, p: Reputation) -> DataFrame:
    """One row (w): the weight of the prior, by moments, from rows (n, s). Sums are of integers, so order does not count."""
    x = groups.where("n > 0").agg(
        F.count("*").cast("double").alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("sn"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("ss"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("nn"),
        (F.coalesce(F.sum(F.expr("(s * s * 1000000L) div n")), F.lit(0)).cast("double") / F.lit(1e6)).alias("sq"),
    )
    x = x.withColumn("q", F.when(F.col("sn") > 0, F.expr("ss / sn")).otherwise(F.lit(0.5)))
    x = x.withColumn("v", F.expr("q * (1D - q)"))
    x = x.withColumn("d", F.expr("CASE WHEN sn > 0 THEN (sn - nn / sn - g + 1D) * v ELSE 0D END"))
    x = x.withColumn("r", F.expr("CASE WHEN d > 0 THEN (sq - ss * q - (g - 1D) * v) / d ELSE 0D END"))
    w = F.expr(f"CASE WHEN r > 0 THEN 1D / r - 1D ELSE {p.most_weight}D END")
    return x.select(F.greatest(F.lit(p.least_weight), F.least(F.lit(p.most_weight), w)).alias("w"))


def reputations(hosts: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """From rows (host, n, s), s of n outcomes bad: rows (host, bad_bound)."""
    domain, suffix = domain_parts(F.col("host"))
    hosts = stage(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "s"), "hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "domains")
    suffixes = stage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "suffixes")
    # Three numbers and a rate: one row each, read by the driver.
    wh, wd, ws = (prior_weight(x, p).first()[0] for x in (hosts, domains, suffixes))
    n, s = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    base = s / n if n else 0.5
    mean = lambda prior, w: (F.col("s") + F.lit(w) * prior) / (F.col("n") + F.lit(w))
    suffixes = suffixes.select("suffix", mean(F.lit(base), ws).alias("suffix_mean"))
    domains = stage(domains.join(suffixes, "suffix").select("domain", "suffix", mean(F.col("suffix_mean"), wd).alias("domain_mean")), "domains")
    a = F.col("s") + F.lit(wh) * F.col("domain_mean")
    b = F.col("n") - F.col("s") + F.lit(wh) * (F.lit(1.0) - F.col("domain_mean"))
    rep = hosts.join(domains, ["domain", "suffix"]).select("host", a.alias("a"), b.alias("b"))
    bound = F.expr(f"a / (a + b) - {p.z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1D)))")
    return rep.select("host", bound.alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, p: Reputation = Reputation()) -> DataFrame:
    """Judge each row of pages (page_id, url) by rules and by the outcomes (page_id, bad) of labelled pages.

    Returns page_id, host, path, rule, verdict, bad_bound. Reputations are staged and joined on host; both sides are
    plain shuffles, so a host with a large share of the pages is split by Spark's skew join. Equal urls and rows are judged alike.
    """
    with scratch(pages.sparkSession):
        return _judged(pages, outcomes, rules, p)


def _judged(pages: DataFrame, outcomes: DataFrame, rules, p: Reputation) -> DataFrame:
    host, path = url_parts(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.groupBy("page_id").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("s"))
    hosts = at.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")
    )
    rep = keep(reputations(hosts, p), "reputation")
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > F.lit(p.max_bad), "block").otherwise("allow")
    return at.join(rep, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), F.round("bad_bound", 6).alias("bad_bound")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages judged with the labels of the documents of the same id: bad is low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    return filter_urls(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _weight_sql(groups: str) -> str:
    return f"""(SELECT greatest(0.5::DOUBLE, least(200.0::DOUBLE, CASE WHEN r > 0 THEN 1.0::DOUBLE / r - 1.0::DOUBLE ELSE 200.0::DOUBLE END)) AS w FROM (
      SELECT CASE WHEN d > 0 THEN (sq - ss * q - (g - 1.0::DOUBLE) * v) / d ELSE 0.0::DOUBLE END AS r FROM (
      SELECT *, CASE WHEN sn > 0 THEN (sn - nn / sn - g + 1.0::DOUBLE) * v ELSE 0.0::DOUBLE END AS d FROM (
      SELECT *, q * (1.0::DOUBLE - q) AS v FROM (
      SELECT *, CASE WHEN sn > 0 THEN ss / sn ELSE 0.5::DOUBLE END AS q FROM (
      SELECT count(*)::DOUBLE AS g, coalesce(sum(n), 0)::DOUBLE AS sn, coalesce(sum(s), 0)::DOUBLE AS ss,
             coalesce(sum(n * n), 0)::DOUBLE AS nn, coalesce(sum((s * s * 1000000) // n), 0)::DOUBLE / 1e6::DOUBLE AS sq
      FROM {groups} WHERE n > 0)))))) """


def _rule_sql(what: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, at, tail = rule[0].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{at + tail}') THEN '{rule[what]}'")
    return "CASE " + " ".join(cases) + " END"


SQL = f"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
seen AS (
  SELECT doc_id AS page_id, count(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS n,
         coalesce(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END), 0)::BIGINT AS s FROM labels GROUP BY 1),
bare AS (
  SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(s), 0)::BIGINT AS s,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM urls LEFT JOIN seen USING (page_id) GROUP BY host),
cut AS (SELECT *, string_split(b, '.') AS l, regexp_matches(b, '^[0-9.]+$|^\\[') AS addr FROM bare),
marked AS (SELECT *, len(l) < 2 OR addr OR l[-1] = '' AS lone,
  CASE WHEN len(l) > 2 AND (l[-2] || '.' || l[-1]) IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM cut),
hosts AS (SELECT host, n, s,
  CASE WHEN lone THEN b WHEN k = 2 THEN l[-3] || '.' || l[-2] || '.' || l[-1] ELSE l[-2] || '.' || l[-1] END AS domain,
  CASE WHEN lone THEN '' WHEN k = 2 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM marked),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s FROM domains GROUP BY 1),
wh AS {_weight_sql("hosts")}, wd AS {_weight_sql("domains")}, ws AS {_weight_sql("suffixes")},
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(s)::DOUBLE / sum(n)::DOUBLE ELSE 0.5::DOUBLE END AS p FROM suffixes),
sm AS (SELECT suffix, (s + (SELECT w FROM ws) * (SELECT p FROM base)) / (n + (SELECT w FROM ws)) AS m FROM suffixes),
dm AS (SELECT domain, suffix, (s + (SELECT w FROM wd) * m) / (n + (SELECT w FROM wd)) AS m FROM domains JOIN sm USING (suffix)),
ab AS (SELECT host, s + (SELECT w FROM wh) * m AS a, n - s + (SELECT w FROM wh) * (1.0::DOUBLE - m) AS b FROM hosts JOIN dm USING (domain, suffix)),
rep AS (SELECT host, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0::DOUBLE))) AS bad_bound FROM ab)
SELECT page_id, host, path, {_rule_sql(0)} AS rule,
       coalesce({_rule_sql(1)}, CASE WHEN bad_bound > 0.3::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, round(bad_bound, 6) AS bad_bound
FROM urls LEFT JOIN rep USING (host)
"""
