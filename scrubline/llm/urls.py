"""URL filtering by rules and empirical-Bayes host reputation (native).

Reputation. Labelled outcomes of pages (bad or not) are counted by host. Each
level's rate has a beta prior whose mean is the level above and whose strength
is fitted by the method of moments across the groups of its own level: all
pages -> public suffix -> registered domain -> host. A host with few labelled
pages is thus judged mostly by its domain, a new domain by its suffix. A page is
blocked when the lower posterior bound of its host's bad rate, mean minus ``z``
standard deviations of the beta posterior, exceeds ``threshold``.

Rules come first: a rule fits its host and all subdomains when the url's path
starts with the rule's path; the longest rule (host and path) that fits wins.

Everything is DataFrame expressions, aggregates and joins. Only counts by host
are shuffled. Hosts with at least a thousandth of all pages (at most 1,000 of
them) are joined by broadcast, the others by a shuffle, so one host may hold any
share of the pages.

Edge cases: null url or no ``://`` -> empty host and path, judged by the rate of
all labelled pages; no labelled page at all -> rate 0 with prior strength 1, so
allowed; several outcomes for one key -> bad if any is; repeated pages each get
a row; other columns of ``pages`` are kept unless an output has their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Suffixes of two labels under which names are registered (a parameter).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
THRESHOLD, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pseudo-pages.
WEAKEST, STRONGEST = 1.0, 1000.0
HEAVY_SHARE = 1000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    after = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.regexp_extract(after, r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def domain_of(host: Column, two: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more (the host if shorter)."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    return (F.when(name.rlike(r"^[0-9.]*$"), name)
            .when(F.substring_index(name, ".", -2).isin(*two), F.substring_index(name, ".", -3))
            .otherwise(F.substring_index(name, ".", -2)))


def suffix_of(domain: Column) -> Column:
    return (F.when(domain.rlike(r"^[0-9.]*$"), F.lit(""))
            .when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def prior_strength(groups: DataFrame) -> float:
    """Method of moments over (n, bad) rows: how many pseudo-pages the prior of
    this level weighs. The variance of rates beyond sampling noise sets it."""
    p = F.col("bad") / F.col("n")
    r = (groups.where("n >= 2").agg(
        F.count("*").alias("k"), F.avg(p).alias("m"), F.var_pop(p).alias("v"),
        F.avg(1 / F.col("n")).alias("inv"))).first()
    if not r.k or r.m is None or r.m <= 0 or r.m >= 1:
        return STRONGEST
    noise = r.m * (1 - r.m) * r.inv
    between = r.v - noise
    if between <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, r.m * (1 - r.m) / between - 1))


def reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of each host from its (host, n_pages, n, bad): n, bad counted
    over labelled pages. Adds prior_mean, post_mean and bound."""
    names = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    by_domain = names.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    by_suffix = names.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sbad"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = total.bad / total.n if total.n else 0.0
    if total.n:
        ks = prior_strength(by_suffix.selectExpr("sn AS n", "sbad AS bad"))
        kd = prior_strength(by_domain.selectExpr("dn AS n", "dbad AS bad"))
        kh = prior_strength(names)
    else:
        ks = kd = kh = WEAKEST
    joined = names.join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix")
    ms = (F.col("sbad") + ks * mean) / (F.col("sn") + ks)
    md = (F.col("dbad") + kd * ms) / (F.col("dn") + kd)
    a, b = F.col("bad") + kh * md, F.col("n") - F.col("bad") + kh * (1 - md)
    post = a / (a + b)
    sd = F.sqrt(post * (1 - post) / (a + b + 1))
    return joined.select("host", "n_pages", "n", "bad", md.alias("prior_mean"), post.alias("post_mean"),
                         (post - Z * sd).alias("bound"))


def judge(pages: DataFrame, rules: list[Rule], outcomes: DataFrame, key: Column,
          url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, verdict and their host's figures.

    ``outcomes`` has (key, bad): labelled outcomes; ``key`` is the expression
    over a page (and its parsed ``path``) that finds its outcome, null for none.
    """
    new = ["host", "path", "rule", "verdict", "n_labelled", "n_bad", "bound"]
    kept = [c for c in pages.columns if c not in new]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.fillna("", ["host", "path"])
    # one row per (host, key): a host's copies of one page are joined once
    counts = parsed.select("host", key.alias("key")).groupBy("host", "key").agg(F.count("*").alias("c"))
    label = outcomes.groupBy("key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = (counts.join(label, "key", "left").groupBy("host").agg(
        F.sum("c").alias("n_pages"), F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("c") * F.col("bad")), F.lit(0)).alias("bad")))
    hosts = written(pages.sparkSession, hosts, "hosts")
    known = reputation(hosts).select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "bound", "n_pages")
    known = written(pages.sparkSession, known, "reputation")
    total = known.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    is_heavy = F.col("n_pages") * HEAVY_SHARE >= F.lit(total)
    heavy, light = known.where(is_heavy).drop("n_pages"), known.where(~is_heavy).drop("n_pages")
    near = parsed.join(F.broadcast(heavy), "host", "left")  # at most HEAVY_SHARE rows
    figures = ["n_labelled", "n_bad", "bound"]
    judged = (near.where("bound IS NOT NULL")
              .unionByName(near.where("bound IS NULL").drop(*figures).join(light, "host", "left")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*kept, "host", "path", text.alias("rule"), F.coalesce(verdict, by_bound).alias("verdict"), *figures)


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the label of the document that its path numbers
    (bad: toxic, or of quality 0)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").cast("string").alias("key"),
                             (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    number = F.regexp_extract(F.col("path"), r"/([0-9]+)(?:[./]|$)", 1)
    out = judge(pages, RULES, outcomes, F.when(number != "", number))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bound", 6).alias("bound"))


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(r: Rule) -> str:
    return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"


def _strength(level: str) -> str:
    return f"""(SELECT CASE WHEN k = 0 OR m <= 0 OR m >= 1 OR v - m * (1 - m) * inv <= 0 THEN {STRONGEST}
      ELSE least({STRONGEST}, greatest({WEAKEST}, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) END
      FROM (SELECT count(*) AS k, avg(bad / n) AS m, var_pop(bad / n) AS v, avg(1.0::DOUBLE / n) AS inv FROM {level} WHERE n >= 2))"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_LONGEST = sorted(RULES, key=lambda r: (-len(r.text), r.text))
ORACLE = f"""
WITH parsed AS (
  SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
lab AS (SELECT CAST(doc_id AS VARCHAR) AS key, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
hosts AS (
  SELECT host, count(lab.bad)::DOUBLE AS n, coalesce(sum(lab.bad), 0)::DOUBLE AS bad
  FROM parsed LEFT JOIN lab ON lab.key = nullif(regexp_extract(path, '/([0-9]+)(?:[./]|$)', 1), '') GROUP BY host),
named AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]*$') THEN '' WHEN strpos(domain, '.') > 0 THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix
  FROM (SELECT *, CASE WHEN regexp_matches(nm, '^[0-9.]*$') THEN nm
                       WHEN array_to_string(list_slice(string_split(nm, '.'), -2, -1), '.') IN ({_TWO}) THEN array_to_string(list_slice(string_split(nm, '.'), -3, -1), '.')
                       ELSE array_to_string(list_slice(string_split(nm, '.'), -2, -1), '.') END AS domain
        FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS nm FROM hosts))),
dom AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1, 2),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1),
k AS (SELECT {_strength("suf")} AS ks, {_strength("dom")} AS kd, {_strength("named")} AS kh, (SELECT sum(bad) / sum(n) FROM hosts) AS m),
post AS (
  SELECT host, n, bad, bad + kh * md AS a, n - bad + kh * (1 - md) AS b
  FROM (SELECT named.*, kh, (dom.bad + kd * ((suf.bad + ks * m) / (suf.n + ks))) / (dom.n + kd) AS md
        FROM named JOIN dom USING (suffix, domain) JOIN suf USING (suffix), k)),
figures AS (SELECT host, n, bad, a / (a + b) - {Z} * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM post)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _LONGEST)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _LONGEST)} WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, round(bound, 6) AS bound
FROM parsed JOIN figures USING (host)
"""
