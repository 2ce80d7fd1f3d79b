"""URL filters: path rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes are a table of hosts and whether each page was bad; without one they come from the rules: a page of a
host that some rule names counts as bad if a block rule decides it and as good if not. Beta-binomial priors shrink the
outcomes from host to registered domain to suffix: each level's posterior mean is the mean of the next level's prior.
What a prior weighs comes from the data too: the more the units of a level differ among each other, beyond what chance
explains, the less it weighs (method of moments). A level's own uncertainty is handed down, so the bound is wide where
little was seen. A page without a rule is blocked when even the lower bound of its host's posterior is over `limit`,
and only if some page under its suffix was labelled.

Only DataFrame functions are used. Counts are aggregated per host before anything is shuffled, domains and suffixes
are summed from the hosts, and hosts go back to the pages by an equi-join whose right side is unique, which adaptive
execution may split for a hot host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules become one CASE expression; a longer list belongs in a table.
MAX_RULES = 500
#: Default of second-level names under which domains are registered (before a country's two letters); pass a fuller list
#: where one is at hand.
SHARED_SECOND_LEVELS = ("co", "com", "org", "net", "ac", "gov", "edu")
#: A prior weighs between one and a thousand pages.
LEAST_RHO, MOST_RHO = 1 / 1001, 1 / 2


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty if the url is null or has no `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("_host", F.coalesce(host, F.lit("")))
    return pages.withColumn("path", F.coalesce(path, F.lit(""))).withColumn("host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host")


def matched_rule(host, path, rules=RULES):
    """The longest rule (host and path together) that fits, as a struct of rule and verdict; null if none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_domain_and_suffix(hosts: DataFrame, second_levels=SHARED_SECOND_LEVELS) -> DataFrame:
    """Adds suffix (the last label, or the last two under a shared second level) and domain (one label more)."""
    bare = F.split(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", ""), r"\.")
    n = F.size("_labels")
    two = (n >= 3) & F.element_at("_labels", -2).isin(*second_levels) & (F.length(F.element_at("_labels", -1)) == 2)
    tail = lambda k: F.array_join(F.slice("_labels", F.greatest(n - k + 1, F.lit(1)), k), ".")
    return hosts.withColumn("_labels", bare).withColumn("suffix", F.when(two, tail(F.lit(2))).otherwise(tail(F.lit(1)))).withColumn("domain", F.when(two, tail(F.lit(3))).otherwise(tail(F.lit(2)))).drop("_labels")


def names_host(host, rules=RULES):
    """Whether some rule is about this host or one above it, whatever the path."""
    out = F.lit(False)
    for name in sorted({r[0] for r in rules}):
        out = out | (host == name) | F.endswith(host, F.lit("." + name))
    return out


def prior_weight(units: DataFrame, k: str, n: str, p: str) -> DataFrame:
    """One row `weight`: how many pages the prior means p are worth for units with k bad ones of n. The variance of k / n
    is p (1 - p) (1 + (n - 1) rho) / n; rho is set so that the sums agree, and the weight is 1 / rho - 1."""
    k, n, p = F.col(k), F.col(n), F.col(p)
    seen = units.where(n > 0)
    rho = F.sum(n * (k / n - p) * (k / n - p) - p * (1 - p)) / F.sum(p * (1 - p) * (n - 1))
    sums = seen.agg(F.sum(p * (1 - p) * (n - 1)).alias("spread"), rho.alias("rho"))
    rho = F.least(F.greatest(F.when(F.col("spread") > 0, F.col("rho")).otherwise(F.lit(MOST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return sums.select((1 / F.coalesce(rho, F.lit(MOST_RHO)) - 1).alias("weight"))


def shrunk(units: DataFrame, k: str, n: str, prior: str, v_prior: str, mean: str, variance: str) -> DataFrame:
    """Adds the posterior's mean and variance to units with a prior mean and the variance of that."""
    units = units.crossJoin(F.broadcast(prior_weight(units, k, n, prior)))  # one row
    w, n = F.col("weight"), F.col(n)
    units = units.withColumn(mean, (F.col(k) + w * F.col(prior)) / (n + w))
    own = F.col(mean) * (1 - F.col(mean)) / (n + w + 1)
    return units.withColumn(variance, own + (w / (n + w)) * (w / (n + w)) * F.col(v_prior)).drop("weight")


def host_reputation(labelled: DataFrame, z: float = 1.645, second_levels=SHARED_SECOND_LEVELS) -> DataFrame:
    """From rows of host and bad (boolean, null if not labelled): each host with the posterior of its share of bad
    pages: rate, lower and upper (mean and z standard deviations, cut to 0..1), and n_suffix, the labelled pages under
    its suffix.

    Suffixes shrink to the share of all labelled pages (with one page's worth of an even prior), domains to their
    suffix, hosts to their domain. An empty table gives no rows; without labelled pages all rates are a half.
    """
    bad, seen = F.sum(F.when(F.col("bad"), 1.0).otherwise(0.0)), F.count("bad").cast("double")
    hosts = with_domain_and_suffix(labelled.groupBy("host").agg(bad.alias("k"), seen.alias("n")), second_levels)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("k").alias("dk"), F.sum("n").alias("dn"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dk").alias("sk"), F.sum("dn").alias("sn"))
    total = suffixes.agg(F.coalesce(F.sum("sk"), F.lit(0.0)).alias("k"), F.coalesce(F.sum("sn"), F.lit(0.0)).alias("n"))
    total = total.select(((F.col("k") + 0.5) / (F.col("n") + 1.0)).alias("p0"), "n").select("p0", (F.col("p0") * (1 - F.col("p0")) / (F.col("n") + 2.0)).alias("v0"))
    suffixes = shrunk(suffixes.crossJoin(F.broadcast(total)), "sk", "sn", "p0", "v0", "ps", "vs")  # total has one row
    domains = shrunk(domains.join(suffixes.select("suffix", "sn", "ps", "vs"), "suffix"), "dk", "dn", "ps", "vs", "pd", "vd")
    hosts = shrunk(hosts.join(domains.select("suffix", "domain", "sn", "pd", "vd"), ["suffix", "domain"]), "k", "n", "pd", "vd", "p", "v")
    half = z * F.sqrt("v")
    return hosts.select(
        "host", "domain", "suffix", F.col("n").cast("long").alias("n_labelled"), F.col("k").cast("long").alias("n_bad"), F.col("sn").cast("long").alias("n_suffix"),
        F.round("p", 9).alias("rate"), F.round(F.greatest(F.col("p") - half, F.lit(0.0)), 9).alias("lower"), F.round(F.least(F.col("p") + half, F.lit(1.0)), 9).alias("upper"),
    )


def judge_urls(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, z: float = 1.645, limit: float = 0.5, second_levels=SHARED_SECOND_LEVELS) -> DataFrame:
    """Every page with page_id, host, path, rule, verdict, rate and lower.

    The rule's verdict stands where a rule fits; otherwise the page is blocked if its host's lower bound is over limit.
    outcomes: rows of host (lower case) and bad (boolean); without it they come from the rules and the pages. Null urls
    have an empty host, which is judged like any other host. Repeated rows count as often as they stand; other columns
    of pages are ignored.
    """
    pages = with_host_and_path(pages.select("page_id", "url")).withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules))
    pages = pages.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("ruled"))
    if outcomes is None:
        labelled = pages.select("host", F.when(names_host(F.col("host"), rules), F.coalesce(F.col("ruled") == "block", F.lit(False))).alias("bad"))
    else:
        labelled = outcomes.select("host", "bad").union(pages.select("host", F.lit(None).cast("boolean")))
    hosts = host_reputation(labelled, z, second_levels)
    judged = pages.join(hosts.select("host", "rate", "lower", "n_suffix"), "host", "left")
    verdict = F.coalesce("ruled", F.when((F.col("lower") > limit) & (F.col("n_suffix") > 0), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rate", "lower")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_FITS = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'"
    for h, p, v in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r[0]))
) + " END"
_TAIL = lambda k: f"array_to_string(labels[greatest(len(labels) - {k - 1}, 1):], '.')"
_TWO = "(len(labels) >= 3 AND length(labels[-1]) = 2 AND labels[-2] IN (" + ", ".join(f"'{x}'" for x in SHARED_SECOND_LEVELS) + "))"
_NAMED = "(" + " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in sorted({r[0] for r in RULES})) + ")"


def _weight(name: str, units: str, k: str, n: str, p: str) -> str:
    return f"""{name} AS (SELECT 1 / coalesce(least(greatest(CASE WHEN spread > 0 THEN rho ELSE {MOST_RHO!r} END, {LEAST_RHO!r}), {MOST_RHO!r}), {MOST_RHO!r}) - 1 AS w FROM (
  SELECT sum({p} * (1 - {p}) * ({n} - 1)) AS spread, sum({n} * ({k} / {n} - {p}) * ({k} / {n} - {p}) - {p} * (1 - {p})) / sum({p} * (1 - {p}) * ({n} - 1)) AS rho FROM {units} WHERE {n} > 0))"""


def _shrunk(keys: str, units: str, weight: str, k: str, n: str, p: str, v: str, mean: str, variance: str) -> str:
    return f"""(SELECT {keys}, {mean}, {mean} * (1 - {mean}) / ({n} + w + 1) + (w / ({n} + w)) * (w / ({n} + w)) * {v} AS {variance}
  FROM (SELECT *, ({k} + w * {p}) / ({n} + w) AS {mean} FROM {units}, {weight}))"""


ORACLE_SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
m AS (SELECT *, {_FITS} AS fit FROM p),
r AS (SELECT page_id, host, path, split_part(fit, '|', 2) AS rule, split_part(fit, '|', 1) AS ruled FROM m WHERE fit IS NOT NULL
      UNION ALL SELECT page_id, host, path, NULL, NULL FROM m WHERE fit IS NULL),
h AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '.') AS labels,
        CAST(count(*) FILTER (WHERE ruled = 'block') AS DOUBLE) AS k, CASE WHEN {_NAMED} THEN CAST(count(*) AS DOUBLE) ELSE 0.0 END AS n FROM r GROUP BY host),
h2 AS (SELECT host, k, n, CASE WHEN {_TWO} THEN {_TAIL(2)} ELSE {_TAIL(1)} END AS suffix,
        CASE WHEN {_TWO} THEN {_TAIL(3)} ELSE {_TAIL(2)} END AS domain FROM h),
g AS (SELECT p0, p0 * (1 - p0) / (n + 2.0) AS v0 FROM (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS p0, coalesce(sum(n), 0) AS n FROM h2)),
s0 AS (SELECT suffix, sum(k) AS sk, sum(n) AS sn, any_value(p0) AS p0, any_value(v0) AS v0 FROM h2, g GROUP BY suffix),
{_weight("ws", "s0", "sk", "sn", "p0")},
s AS {_shrunk("suffix, sn", "s0", "ws", "sk", "sn", "p0", "v0", "ps", "vs")},
d0 AS (SELECT h2.suffix, domain, sum(k) AS dk, sum(n) AS dn, any_value(sn) AS sn, any_value(ps) AS ps, any_value(vs) AS vs FROM h2 JOIN s ON h2.suffix = s.suffix GROUP BY h2.suffix, domain),
{_weight("wd", "d0", "dk", "dn", "ps")},
d AS {_shrunk("suffix, domain, sn", "d0", "wd", "dk", "dn", "ps", "vs", "pd", "vd")},
u0 AS (SELECT host, k, n, sn, pd, vd FROM h2 JOIN d ON h2.suffix = d.suffix AND h2.domain = d.domain),
{_weight("wh", "u0", "k", "n", "pd")},
u AS {_shrunk("host, sn", "u0", "wh", "k", "n", "pd", "vd", "p", "v")},
rep AS (SELECT host, sn, round(p, 9) AS rate, round(greatest(p - 1.645 * sqrt(v), 0.0), 9) AS lower FROM u)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN lower > 0.5 AND sn > 0 THEN 'block' ELSE 'allow' END) AS verdict, rate, lower
FROM r JOIN rep ON r.host = rep.host
"""
