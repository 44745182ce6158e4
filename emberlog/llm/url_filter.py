"""URL filtering by rules and by the reputation of hosts, estimated with empirical Bayes.

Labelled pages give bad and good outcomes. Counts are summed by host, by registered domain and by
suffix, and each level is shrunk towards the one above: the mean of the level above becomes a beta
prior, with as much weight as the spread of that level's children calls for (by moments, between
``MIN_WEIGHT`` and ``MAX_WEIGHT`` outcomes). A host is blocked if the lower bound of its posterior
rate of bad pages, ``Z`` standard deviations below the mean, exceeds ``BLOCK_ABOVE``. A host that
no labelled page mentions gets the posterior of its domain, suffix or of all pages.

A suffix is the last label of a host, or its last two where ``SUFFIXES`` lists them; a registered domain is
the suffix and one label more. User names and ports do not count there; a numeric address is a domain of its
own. The outcomes of the registered query are those labels whose ``doc_id`` equals a ``page_id``: the tables
name no other link between the two, and do not promise this one.

Only DataFrame functions are used. Pages are shuffled only for the join with the table of hosts,
where Spark finds that table too large to broadcast; adaptive execution splits a large host there.
NULL urls and urls without ``://`` have an empty host and path, match no rule, and are judged by
the overall rate. Repeated pages give repeated rows, an empty table an empty one. Labels with NULL
in both outcomes, or without an id, do not count.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import UPPER, fresh, table, written

BLOCK_ABOVE = 0.5
Z = 1.645
MIN_WEIGHT = 1.0
MAX_WEIGHT = 1000.0


# Suffixes of two labels below which names are registered; the last three are those of the
# tables here, whose sites are named below them.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "ne.jp",
    "or.jp", "co.kr", "com.cn", "com.br", "com.mx", "com.ar", "com.tr", "example.com", "example.net", "example.org",
)


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def last_labels(host: Column, n: int) -> Column:
    """The last ``n`` labels of a host; the host itself if it has no more."""
    return F.substring_index(host, ".", -n)


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host, and the suffix that it is registered below."""
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")
    listed = last_labels(name, 2).isin(*suffixes) if suffixes else F.lit(False)
    numeric = name.rlike("^[0-9.]+$")
    domain = F.when(numeric, name).when(listed, last_labels(name, 3)).otherwise(last_labels(name, 2))
    suffix = F.when(numeric, "").when(listed, last_labels(name, 2)).otherwise(last_labels(name, 1))
    return domain, suffix


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else NULL; the rules become one CASE."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _weight(mean: Column) -> Column:
    """How many outcomes the mean of a parent is worth as a prior for its children, as an aggregate of these.

    With rates p of n outcomes and their mean m, the variance between children is what exceeds
    binomial noise; a beta with mean m and that variance has m(1-m)/variance - 1 outcomes.
    """
    noise = F.max(mean * (1 - mean))
    spread = F.sum((F.col("bad") / F.col("n") - mean) ** 2 * F.col("n"))
    between = (spread - (F.count("*") - 1) * noise) / F.greatest(F.sum("n"), F.lit(1))
    weight = F.when(between > 0, noise / between - 1).otherwise(F.lit(MAX_WEIGHT))
    return F.greatest(F.least(weight, F.lit(MAX_WEIGHT)), F.lit(MIN_WEIGHT)).cast("double")


class Reputation(NamedTuple):
    """Beta posteriors, ``a`` and ``b``, by host, by domain, by suffix, and of all outcomes."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    a: float
    b: float


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> Reputation:
    """Posteriors from rows (host, bad, n), one per host. The sums over all and the weight of their mean
    are single numbers and go through the driver."""
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = written(outcomes.select("host", domain.alias("domain"), suffix.alias("suffix"), "bad", "n"), "outcomes")

    def total(df, *by):
        return df.groupBy(*by).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))

    def posterior(known: DataFrame, *columns: str) -> DataFrame:
        """From each row's counts, the mean of its parent and what that is worth."""
        a = F.col("bad") + F.col("weight") * F.col("prior")
        b = F.col("n") - F.col("bad") + F.col("weight") * (1 - F.col("prior"))
        return known.select(*columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))

    def below(level: DataFrame, parent: DataFrame, link: str) -> DataFrame:
        known = level.join(parent.select(link, F.col("mean").alias("prior")), link)
        return posterior(known.join(known.groupBy(link).agg(_weight(F.col("prior")).alias("weight")), link), *level.columns)

    by_domain = total(hosts, "domain", "suffix")
    by_suffix = written(total(by_domain, "suffix"), "reputation")
    sums = by_suffix.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    bad, n = sums["bad"] or 0, sums["n"] or 0
    mean = F.lit((bad + 1) / (n + 2))
    weight = by_suffix.agg(_weight(mean).alias("weight")).first()["weight"]
    top = posterior(by_suffix.withColumns({"prior": mean, "weight": F.lit(weight)}), "suffix")
    middle = written(below(by_domain, top, "suffix"), "reputation")
    return Reputation(below(hosts, middle, "domain"), middle, top, bad + 1.0, n - bad + 1.0)


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Mean less ``z`` standard deviations of a beta distribution."""
    n = a + b
    return a / n - F.lit(z) * F.sqrt(a * b / (n * n * (n + 1)))


def host_rates(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, a, b) for every row of ``hosts`` (host): its own posterior, else that of its
    domain, of its suffix or of all."""
    found = host_reputation(outcomes, suffixes)
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    rows = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"))
    for level, link in ((found.hosts, "host"), (found.domains, "domain"), (found.suffixes, "suffix")):
        rows = rows.join(level.select(link, *(F.col(x).alias(f"{link}_{x}") for x in "ab")), link, "left")
    pick = {x: F.coalesce(*(F.col(f"{link}_{x}") for link in ("host", "domain", "suffix")), F.lit(getattr(found, x))) for x in "ab"}
    return rows.select("host", "domain", *(c.cast("double").alias(x) for x, c in pick.items()))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES,
               url_col: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, bad_rate and bad_bound; ``outcomes`` are rows
    (host, bad, n)."""
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")]
    split = pages.select(
        *keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    rates = written(host_rates(split.select("host").distinct(), outcomes, suffixes), "reputation")
    # Joined by two columns, so that both sides are shuffled for the join if the table is too
    # large to broadcast, and adaptive execution can split a large host.
    key, domain, a_, b_ = fresh(split, "rated_host", "rated_domain", "rated_a", "rated_b")
    rates = rates.toDF(key, domain, a_, b_)
    joined = split.join(
        rates, (F.col("host") == F.col(key)) & (domain_and_suffix(F.col("host"), suffixes)[0] == F.col(domain)), "left"
    )
    a, b = F.coalesce(a_, F.lit(1.0)), F.coalesce(b_, F.lit(1.0))
    host, path = F.col("host"), F.col("path")
    rated = joined.select(*keep, host, path, (a / (a + b)).alias("bad_rate"), lower_bound(a, b).alias("bad_bound"))
    method = F.when(F.col("bad_bound") > BLOCK_ABOVE, "block").otherwise("allow")
    return rated.select(
        *keep, "host", "path", fitting_rule(rules, host, path, lambda r: r.text).alias("rule"),
        F.coalesce(fitting_rule(rules, host, path, lambda r: r.action), method).alias("verdict"),
        "bad_rate", "bad_bound",
    )


def label_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes by host: a page is bad if its label says low quality or toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marked = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(
        F.col("doc_id").alias("page"), bad.cast("long").alias("bad")
    )
    return (
        pages.select(F.col("page_id").alias("page"), url_host(F.col("url")).alias("host"))
        .join(marked, "page").groupBy("host")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    )


def _case(field: str) -> str:
    out = "null"
    for rule in sorted(RULES, key=lambda r: (len(r.text), r.text)):
        value = rule.text if field == "rule" else rule.action
        out = (f"case when (host = '{rule.host}' or ends_with(host, '.{rule.host}')) "
               f"and starts_with(path, '{rule.path}') then '{value}' else {out} end")
    return out


def _shrink(level: str, parent: str, link: str) -> str:
    return f"""
    {level}_k as (select l.*, p.mean as prior from {level} l join {parent}_p p using ({link})),
    {level}_w as (
      select {link}, greatest(least(case when v > 0 then noise / v - 1 else {MAX_WEIGHT} end, {MAX_WEIGHT}), {MIN_WEIGHT}) as weight
      from (select {link}, max(prior * (1 - prior)) as noise,
                   (sum(pow(bad / n - prior, 2) * n) - (count(*) - 1) * max(prior * (1 - prior)))
                   / greatest(sum(n), 1) as v
            from {level}_k group by {link})),
    {level}_p as (
      select *, a / (a + b) as mean from (
        select k.*, bad + weight * prior as a, n - bad + weight * (1 - prior) as b
        from {level}_k k join {level}_w using ({link})))"""


@query(
    "op8_url_filter",
    rf"""
    with u as (
      select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
    m as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'gs') as name from u),
    p as (
      select *, regexp_full_match(name, '[0-9.]+') as numeric,
             array_to_string(string_split(name, '.')[-2:], '.') as two,
             list_contains([{", ".join(f"'{x}'" for x in SUFFIXES)}], two) as listed from m),
    l as (
      select page_id, host, path,
             case when numeric then name when listed then array_to_string(string_split(name, '.')[-3:], '.')
                  else two end as domain,
             case when numeric then '' when listed then two else string_split(name, '.')[-1] end as suffix from p),
    o as (
      select host, domain, suffix, 0 as top, case when quality = 0 or toxic = 1 then 1 else 0 end as bad
      from l join labels on doc_id = page_id where quality is not null or toxic is not null),
    hosts as (select host, domain, suffix, sum(bad)::double as bad, count(*) as n from o group by all),
    domains as (select domain, suffix, sum(bad)::double as bad, count(*) as n from o group by all),
    suffixes as (select suffix, top, sum(bad)::double as bad, count(*) as n from o group by all),
    top_p as (select top, sum(bad) + 1 as a, count(*) - sum(bad) + 1 as b,
                     (sum(bad)::double + 1) / (count(*) + 2) as mean from o group by top),
    {_shrink("suffixes", "top", "top")},
    {_shrink("domains", "suffixes", "suffix")},
    {_shrink("hosts", "domains", "domain")},
    j as (
      select l.page_id, l.host, l.path,
             coalesce(h.a, d.a, s.a, (select a from top_p), 1)::double as a,
             coalesce(h.b, d.b, s.b, (select b from top_p), 1)::double as b
      from l left join hosts_p h on h.host = l.host left join domains_p d on d.domain = l.domain
      left join suffixes_p s on s.suffix = l.suffix)
    select page_id, host, path, {_case("rule")} as rule,
           coalesce({_case("action")}, case when a / (a + b)
             - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {BLOCK_ABOVE}
             then 'block' else 'allow' end) as verdict
    from j
    """,
)
def _op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge_urls(pages, label_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")
