"""URL filter: fixed rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled outcomes of pages are counted by host. Beta-binomial priors shrink them level by level: the
suffix's bad rate towards the overall rate, the registered domain's towards its suffix, the host's
towards its domain. Each level's prior strength comes from the spread of the rates below it, by
moments. A host is blocked where the lower bound of its posterior bad rate (mean less Z standard
deviations) reaches the threshold. Suffix and registered domain are the last one and two labels.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and has no
reputation of its own (it is judged by the overall rate); labels that are null don't count; several
labels of a page all count; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Fixed values: (host, path prefix, verdict) of the rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
Z = 1.645
THRESHOLD = 0.5
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for domain, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def strength(below: DataFrame) -> float:
    """Prior strength of a level from rows (n, bad, mean of the level above): a sum of squares, so one row comes back."""
    row = below.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), 2)).alias("ss"), F.sum(F.col("above") * (1 - F.col("above"))).alias("within"), F.sum(F.col("n") * F.col("above") * (1 - F.col("above"))).alias("most")
    ).first()
    if not row.n or row.most <= 0:
        return STRENGTH[1]
    # E[ss] = within + rho * (most - within), with rho = 1 / (strength + 1)
    rho = (row.ss - row.within) / (row.most - row.within) if row.most > row.within else 0.0
    return float(min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1 if rho > 0 else STRENGTH[1])))


def reputations(rows: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, float]:
    """(host, bad_rate, lower) of every host in rows, from outcomes (host, bad); and the overall rate.

    A host without labels has its domain's rate, with the prior's spread.
    """
    labelled = outcomes.where("host <> '' and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    hosts = rows.where("host <> ''").groupBy("host").agg(F.lit(0).alias("_")).drop("_").join(labelled, "host", "left").fillna(0, ["n", "bad"])
    labels = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2)))
    hosts = durable(hosts, "hosts", few=True)  # a row a host; the levels above are sums of these
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = float((total.bad + 0.5) / (total.n + 1)) if total.n else 0.5
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("above", F.lit(rate))
    m = strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.lit(m * rate) + F.col("bad")) / (F.lit(m) + F.col("n"))).alias("above"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    m = strength(domains)
    domains = domains.select("domain", ((F.lit(m) * F.col("above") + F.col("bad")) / (F.lit(m) + F.col("n"))).alias("above"))
    hosts = hosts.join(domains, "domain")
    m = strength(hosts)
    mean = (F.lit(m) * F.col("above") + F.col("bad")) / (F.lit(m) + F.col("n"))
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.lit(m) + F.col("n") + 1))
    return hosts.withColumn("bad_rate", mean).select("host", "bad_rate", (F.col("bad_rate") - F.lit(Z) * spread).alias("lower")), rate


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, bad_rate of every page; labels: (key, bad boolean)."""
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    outcomes = rows.select("page_id", "host").join(labels.select(F.col(key).alias("page_id"), "bad"), "page_id")
    scores, rate = reputations(rows, outcomes)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.coalesce("lower", F.lit(rate if rate < THRESHOLD else 1.0)) >= THRESHOLD, "block").otherwise("allow")
    return rows.join(scores, "host", "left").select(
        F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.coalesce("bad_rate", F.lit(rate)).alias("bad_rate")
    )
