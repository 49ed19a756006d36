"""Operator 12: URL filters by rules and by empirical-Bayes host reputation.

Rules come first: a rule ``host/path`` fits the pages of its host and of all
subdomains whose path starts with the rule's path, and the longest rule that fits
decides.  Pages that no rule fits are judged by their host's reputation.  Labelled
pages are counted per host (``n`` labelled, ``x`` of them bad), and every host's rate
is shrunk through beta-binomial priors: the host towards its registered domain, the
domain towards its suffix, the suffix towards the whole table, which itself has
Jeffreys' prior.  How strongly each level pulls is learnt from the table by moments:
with prior means ``m`` and ``v = m (1 - m)``, groups whose rates correlate by ``rho``
have E sum (x - n m)^2 / n = sum v (1 + rho (n - 1)), so that
``rho = (sum (x - n m)^2 / n - sum v) / sum v (n - 1)`` and the prior counts like
``1 / rho - 1`` pages, one at least.  The variance of a posterior is its own and, as far
as it leans on its prior, that of the level above.  A host is blocked if the lower bound
of its bad rate (mean less ``z`` standard deviations) is above ``limit``: few or no
labelled pages leave a wide posterior, and no page is blocked for want of knowledge.

DataFrame functions only.  Pages shrink to (name, label) before anything moves, hosts
are pre-aggregated where they are read, so a host with a third of all pages is one row
a task; the host table is written once, three one-row sums over it give the
strengths.  Lookups are broadcast after a count of their rows, and are plain
equi-joins beyond that, whose skewed partitions Spark splits.  The rules are a
parameter, a chain of conditions in the scan's own stage.

A null url, or one without ``://``, has an empty host and path; no rule fits it and all
such rows share one reputation.  Hosts keep user and port; reputation does not look at
them.  A page's several labels count once (bad if one is), null labels not at all;
repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import lookup
from .common import staged, table

#: The rules of the registered query: (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered; others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
#: A host is blocked if its bad rate is above LIMIT with this many deviations to spare.
LIMIT, Z = 0.5, 1.645
#: Correlations are held inside these bounds, and are DEFAULT where nothing tells them.
RHO_LEAST, RHO_MOST, RHO_DEFAULT = 1e-4, 0.5, 0.1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url, both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the last condition is looked at first
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> dict[str, Column]:
    """Name (host without user and port), registered domain and suffix.  An address
    of digits is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$|\.+$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    last = F.element_at(labels, -1)
    address = last.rlike(r"^[0-9]+$")
    paired = two.isin(*TWO_LABEL_SUFFIXES)
    return {"name": name, "domain": F.when(address, name).when(paired, three).otherwise(two),
            "suffix": F.when(address, name).when(paired, two).otherwise(last)}


def _strength(groups: DataFrame) -> float:
    """Pages that the prior of a level counts for.  ``groups``: n, x and the prior mean m."""
    v = F.col("m") * (1 - F.col("m"))
    seen = groups.where("n > 0").agg(F.sum((F.col("x") - F.col("n") * F.col("m")) ** 2 / F.col("n") - v).alias("over"),
                                     F.sum(v * (F.col("n") - 1)).alias("room")).first()
    rho = seen.over / seen.room if seen.room else RHO_DEFAULT
    return 1 / min(max(rho, RHO_LEAST), RHO_MOST) - 1


def reputations(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", limit: float = LIMIT,
                z: float = Z) -> DataFrame:
    """``name``, ``domain``, ``suffix``, ``n``, ``x``, posterior ``rate``, lower ``bound`` and
    ``blocked`` of every host.  ``outcomes``: a row for each page, ``bad`` true, false or null (unlabelled)."""
    bad = F.col(bad_col).cast("long")
    host = F.coalesce(F.col(host_col), F.lit(""))
    hosts = staged(outcomes.select(levels(host)["name"].alias("name"), bad.alias("bad"))
                   .groupBy("name").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
                   .select(*[c.alias(k) for k, c in levels(F.col("name")).items()], "n", "x"), "host-outcomes")
    sums = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    whole = hosts.agg(*sums).first()
    mean = ((whole.x or 0) + 0.5) / ((whole.n or 0) + 1)
    above, key = None, None  # the level above: its key, posterior means and variances
    for level, groups in (("suffix", suffixes), ("domain", domains), ("name", hosts)):
        if above is None:
            groups = groups.withColumns({"m": F.lit(mean), "w": F.lit(mean * (1 - mean) / ((whole.n or 0) + 2))})
        else:
            groups = groups.join(lookup(above), key)
        s = _strength(groups)
        total = F.col("n") + s
        groups = groups.withColumn("rate", (F.col("x") + s * F.col("m")) / total)
        groups = groups.withColumn("var", F.col("rate") * (1 - F.col("rate")) / (total + 1) + (s / total) ** 2 * F.col("w"))
        above, key = groups.select(level, F.col("rate").alias("m"), F.col("var").alias("w")), level
    bound = F.col("rate") - z * F.sqrt("var")
    return (groups.withColumn("bound", bound).withColumn("blocked", F.col("bound") > limit)
                  .select("name", "domain", "suffix", "n", "x", "rate", "bound", "blocked"))


def judged(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]] = RULES,
           labels: DataFrame | None = None, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.  ``labels``: (``id``,
    ``bad``) of labelled pages; without them only rules block."""
    host, path = host_and_path(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    cut = cut.select("*", rule.alias("rule"), verdict.alias("_says"))
    if labels is None:
        judged_ = cut.withColumn("verdict", F.coalesce("_says", F.lit("allow")))
    else:
        once = labels.where(F.col("bad").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.max("bad").alias("bad"))
        known = reputations(cut.select("_id", "host").join(once, "_id", "left"), limit=limit, z=z)
        blocked = lookup(known.where("blocked").select(F.col("name").alias("_name"), F.lit("block").alias("_by_host")))
        judged_ = (cut.withColumn("_name", levels(F.col("host"))["name"]).join(blocked, "_name", "left")
                      .withColumn("verdict", F.coalesce("_says", "_by_host", F.lit("allow"))))
    return judged_.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url by the fixed rules, else by its host's reputation.  Outcomes are
    the table ``labels`` (pages and documents are numbered alike): bad is toxic or of no quality."""
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judged(table(spark, sf_dir, "pages"), "page_id", "url", labels=seen)


def _level_sql(name: str) -> tuple[str, str]:
    """Domain and suffix of a name in SQL."""
    labels = f"string_split({name}, '.')"
    last = f"list_extract({labels}, -1)"
    two, three = (f"array_to_string(list_slice({labels}, -{k}, -1), '.')" for k in (2, 3))
    paired = f"{two} IN ({', '.join(repr(s) for s in TWO_LABEL_SUFFIXES)})"
    address = f"regexp_full_match({last}, '[0-9]+')"
    return (f"CASE WHEN {address} THEN {name} WHEN {paired} THEN {three} ELSE {two} END",
            f"CASE WHEN {address} THEN {name} WHEN {paired} THEN {two} ELSE {last} END")


def _pull_sql(groups: str) -> str:
    """The prior's strength from a table of n, x, m, as one row (s)."""
    rho = (f"coalesce(sum((x - n * m) * (x - n * m) / n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), {RHO_DEFAULT})")
    return f"SELECT 1 / least(greatest({rho}, {RHO_LEAST}), {RHO_MOST}) - 1 AS s FROM {groups} WHERE n > 0"


def _posterior_sql(key: str, level: int) -> str:
    """Posterior mean m and variance w of a level's groups."""
    return (f"SELECT {key}, r AS m, r * (1 - r) / (n + s + 1) + s / (n + s) * (s / (n + s)) * w AS w "
            f"FROM (SELECT *, (x + s * m) / (n + s) AS r FROM g{level}, s{level})")


def op12_sql() -> str:
    domain, suffix = _level_sql("name")
    rules = " UNION ALL ".join(f"SELECT '{says}' AS says, '{text}' AS rule, '{text.partition('/')[0]}' AS rh, '/{text.partition('/')[2]}' AS rp" for says, text in RULES)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH rules AS ({rules}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{lower}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$|\.+$', '') AS name FROM cut),
seen AS (SELECT doc_id, max((toxic = 1) OR (quality = 0)) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT name, {domain} AS domain, {suffix} AS suffix, n, x FROM (
  SELECT name, count(bad) AS n, count(*) FILTER (WHERE bad) AS x FROM named LEFT JOIN seen ON page_id = doc_id GROUP BY name)),
g1 AS (SELECT *, m0 * (1 - m0) / (n0 + 2) AS w, m0 AS m FROM (SELECT suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY suffix),
  (SELECT (sum(x) + 0.5) / (sum(n) + 1) AS m0, sum(n) AS n0 FROM hosts)),
s1 AS ({_pull_sql("g1")}),
p1 AS ({_posterior_sql("suffix", 1)}),
g2 AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x, any_value(p1.m) AS m, any_value(p1.w) AS w FROM hosts JOIN p1 USING (suffix) GROUP BY domain, suffix),
s2 AS ({_pull_sql("g2")}),
p2 AS ({_posterior_sql("domain", 2)}),
g3 AS (SELECT name, n, x, p2.m AS m, p2.w AS w FROM hosts JOIN p2 USING (domain)),
s3 AS ({_pull_sql("g3")}),
p3 AS ({_posterior_sql("name", 3)}),
fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM (SELECT DISTINCT host, path FROM cut) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN m - {Z} * sqrt(w) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM named JOIN p3 USING (name) LEFT JOIN fits USING (host, path)
"""
