"""Empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (good or bad) are counted per host, registered domain (last two names) and suffix (last name). The good
rate of a suffix is shrunk to the overall rate, a domain's to its suffix, a host's to its domain, as the mean of a beta posterior.
The prior strength of each level is estimated from the data: with S = sum n (p - m)^2 over the units of a level, and m the mean of what is
above, the beta-binomial overdispersion is rho = (S - sum m(1-m)) / sum (n-1) m(1-m), kept within [0.001, 0.5], and the strength
1/rho - 1. A page is blocked if the upper bound of its host's posterior, mean + z sd, is under the floor; listed rules come first.

Defined results: a url that is null or has no ``://`` has an empty host and path and takes the overall rate; hosts without labelled
pages take their domain's prior, unknown domains their suffix's; null labels are no outcome; without any label all unlisted pages
are allowed; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW_RHO, HIGH_RHO = 0.001, 0.5
#: Fixed values: (host, path start, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(units: DataFrame, m: str) -> Column:
    """The prior strength of units (n, good) below their mean ``m``, as a scalar subquery."""
    v = F.col(m) * (1 - F.col(m))
    gap = F.col("good") / F.col("n") - F.col(m)
    rho = (F.sum(F.col("n") * gap * gap) - F.sum(v)) / F.sum((F.col("n") - 1) * v)
    return units.agg(F.coalesce(1 / F.greatest(F.lit(LOW_RHO), F.least(F.lit(HIGH_RHO), rho)) - 1, F.lit(1 / HIGH_RHO - 1)).alias("k")).scalar()


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def posteriors(outcomes: DataFrame) -> tuple[Column, DataFrame, DataFrame, DataFrame]:
    """From (host, good 0/1): the overall rate as a scalar; then (suffix), (suffix, domain) and (domain, host) with rate and strength."""
    counted = (outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).filter("n > 0")
               .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)))
    overall = counted.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).scalar()

    def shrunk(units: DataFrame, m: str) -> DataFrame:
        k = _strength(units, m)
        return units.withColumn("k", k).withColumn("rate", (F.col("good") + F.col("k") * F.col(m)) / (F.col("n") + F.col("k"))).withColumn(
            "strength", F.col("n") + F.col("k"))

    suffix = shrunk(_counted(counted, "suffix").withColumn("m", overall), "m")
    suffix = suffix.select("suffix", F.col("rate").alias("s_rate"), F.col("strength").alias("s_strength"))
    domain = shrunk(_counted(counted, "suffix", "domain").join(suffix, "suffix"), "s_rate")
    domain = domain.select("suffix", "domain", F.col("rate").alias("d_rate"), F.col("strength").alias("d_strength"))
    host = shrunk(counted.join(domain, ["suffix", "domain"]), "d_rate")
    host = host.select("host", F.col("n").alias("labelled"), F.col("rate").alias("h_rate"), F.col("strength").alias("h_strength"))
    return overall, suffix, domain, host


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules=RULES, floor: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict, good_rate and upper_bound. ``outcomes`` has (host, good)."""
    overall, suffix, domain, host = posteriors(outcomes)
    made = ("host", "path", "rule", "verdict", "good_rate", "upper_bound")
    columns = [c for c in pages.columns if c.casefold() not in made]
    rows = pages.select(*[F.col(f"`{c}`") for c in columns], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = (rows.withColumn("_domain", F.substring_index("host", ".", -2)).withColumn("_suffix", F.substring_index("host", ".", -1)).withColumn("m", overall)
            .join(host, "host", "left")
            .join(domain.select(F.col("domain").alias("_domain"), "d_rate", "d_strength"), "_domain", "left")
            .join(suffix.withColumnRenamed("suffix", "_suffix"), "_suffix", "left"))
    rate = F.coalesce("h_rate", "d_rate", "s_rate", "m")
    strength = F.coalesce("h_strength", "d_strength", "s_strength", F.lit(0.0))
    upper = rate + z * F.sqrt(rate * (1 - rate) / (strength + 1))
    rows = rows.withColumn("good_rate", rate).withColumn("upper_bound", upper).withColumn("_rule", listed(F.col("host"), F.col("path"), rules))
    return rows.select(*[F.col(f"`{c}`") for c in columns], "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce(F.col("_rule.verdict"), F.when(F.col("upper_bound") < floor, "block").otherwise("allow")).alias("verdict"),
                       "good_rate", "upper_bound")
