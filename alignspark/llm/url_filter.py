"""URL filter: rules, and Empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host.  Each level's share of good pages
has a beta prior whose mean is the posterior mean of the level above (host,
registered domain, suffix, all pages) and whose strength is fitted to the
spread of that level's shares by the method of moments for the beta-binomial.
A page passes if the lower bound of its host's posterior stays at or above
``least``; hosts without labels stand on their domain's or suffix's posterior.
Rules come first: the longest rule that fits a url decides.

Everything is grouped and joined by host, domain and suffix, never by page
pairs; a host that holds a third of all pages is one row after map-side
aggregation, and the join back to the pages is one that Spark splits when it
is skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    return ascii_lower(F.coalesce(F.regexp_extract(after, r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: Public suffixes of two labels under which names are registered, the frequent ones of the public suffix list.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "ac.jp", "co.jp", "ne.jp", "or.jp", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "org.nz", "com.br", "gov.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "com.tw", "co.in", "gov.in", "org.in", "co.kr", "or.kr", "com.mx", "com.ar", "com.tr", "co.za", "com.sg", "co.il",
)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are listed, else the last."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate({ord(a): a.lower() for a in UPPER}), slash + path


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, then the one that sorts first; null if none fits."""
    cases = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        cases = F.when(fits, F.lit(rule)) if cases is None else cases.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if cases is None else cases


def rule_verdict(rule: Column, rules: dict[str, str]) -> Column:
    return reduce(lambda c, r: c.when(rule == r, F.lit(rules[r])), rules, F) if rules else F.lit(None).cast("string")


def _strength(groups: DataFrame, floor: float, ceiling: float) -> Column:
    """1/rho - 1 for the intra-class correlation rho of counts k of n about the means m."""
    spread = F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * F.col("m") * (1 - F.col("m")))
    room = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    rho = F.least(F.greatest(F.coalesce(F.try_divide(spread, room), F.lit(floor)), F.lit(floor)), F.lit(ceiling))
    return 1 / rho - 1


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, floor: float = 0.001, ceiling: float = 0.5, z: float = 1.6448536269514722) -> DataFrame:
    """Posteriors from outcomes (host, good 0/1): level, key, mean, bound.

    Levels are host, domain, suffix and all; the bound is the posterior mean
    less z posterior standard deviations.  Without outcomes there is the level
    'all' alone, with a uniform prior.
    """
    hosts = outcomes.where("good IS NOT NULL AND host IS NOT NULL").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("k"))
    # all levels are made from the hosts' counts, so the outcomes are read once
    hosts = common.written(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "host_outcomes")
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    everything = outcomes.sparkSession.createDataFrame([(k + 1.0, n - k + 1.0)], "a double, b double")

    def level(groups: DataFrame, key: str, above: DataFrame | None, on: str | None) -> DataFrame:
        """The posteriors of one level, written once; the strength of its prior is one number."""
        mean = F.lit((k + 1.0) / (n + 2.0)) if above is None else F.col("m")
        known = groups if above is None else groups.join(above.select(F.col("key").alias(on), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), on)
        known = common.written(known.withColumn("m", mean), f"{key}_groups")
        s = F.lit(known.agg(_strength(known, floor, ceiling)).first()[0])
        return known.select(F.col(key).alias("key"), (s * F.col("m") + F.col("k")).alias("a"), (s * (1 - F.col("m")) + F.col("n") - F.col("k")).alias("b"))

    suffixes = level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffix", None, None)
    domains = level(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k")), "domain", suffixes, "suffix")
    by_host = level(hosts, "host", domains, "domain")
    parts = [("host", by_host), ("domain", domains), ("suffix", suffixes), ("all", everything.select(F.lit("").alias("key"), "a", "b"))]
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("level"), "key", "a", "b") for name, df in parts))
    total = F.col("a") + F.col("b")
    mean = F.col("a") / total
    return rows.select("level", "key", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], least: float = 0.6, id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] = SUFFIXES, **prior) -> DataFrame:
    """page_id, host, path, rule, verdict, level (whose posterior stands), bound; one row for each page.

    A null url, or one without ``://``, has an empty host and path and is
    judged by the posterior of empty hosts or of all pages.  Equal rules for a
    url: the longest, then the one that sorts first.  Repeated pages are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    url = F.col(common.quoted(url_col))
    rows = pages.select(F.col(common.quoted(id_col)).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    known = common.written(reputation(outcomes, suffixes, **prior), "reputation")
    hosts = rows.groupBy("host", "domain", "suffix").agg(F.lit(1).alias("one")).drop("one")
    found = hosts
    for name, on in (("host", "host"), ("domain", "domain"), ("suffix", "suffix")):
        found = found.join(known.where(F.col("level") == name).select(F.col("key").alias(on), F.col("bound").alias(f"b_{name}")), on, "left")
    everything = known.where("level = 'all'").select("bound").first()[0]
    level = F.when(F.col("b_host").isNotNull(), "host").when(F.col("b_domain").isNotNull(), "domain").when(F.col("b_suffix").isNotNull(), "suffix").otherwise("all")
    judged = found.select("host", level.alias("level"), F.coalesce("b_host", "b_domain", "b_suffix", F.lit(everything)).alias("bound"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "host", "path", rule.alias("rule")).join(judged, "host")
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "level", F.round("bound", 6).alias("bound"))
