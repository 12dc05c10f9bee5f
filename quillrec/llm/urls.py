"""URL filters: explicit host/path rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Going down from the whole table to public suffix, registered
domain and host, each level's groups get a beta prior centred on their parent's posterior mean; its strength
is the beta-binomial moment estimate over all groups of the level. A host is blocked when the lower bound of
its posterior bad rate is above the table's own rate, so sparse hosts fall back on what lies above them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.operators.skew import salted_join
from quillrec.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1_000  # rules travel inside the plan
# Labels that stand before a two-letter country label as part of a public suffix. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    """Block or allow a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """What follows the first `://`, A-Z lower-cased; empty for null or without `://`."""
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?` or `#`; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label, or the last two for suffixes such as `co.uk`."""
    two = F.substring_index(host, ".", -2)
    deep = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$") & (host != two)
    return F.when(deep, two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Suffix and the label before it."""
    labels = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<len, rule, verdict>; null if none does.

    Of equally long rules the greatest by text wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = []
    for rule in rules:
        text = rule.host + rule.path
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.struct(
            F.lit(len(text)).alias("len"), F.lit(text).alias("rule"), F.lit(rule.verdict).alias("verdict")
        )
        fits.append(F.when(inside & F.startswith(path, F.lit(rule.path)), found))
    if not fits:
        return F.lit(None).cast("struct<len:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of the bad rate of every host.

    `outcomes`: host, bad (0/1 or null: not labelled), any number of rows per host; other columns are ignored.
    Returns host, n, bad, mean, lower, rate (the table's own rate). A host without labelled pages has its
    domain's mean. Without any labelled page every mean and bound is 0. Null hosts count as the empty host.
    """
    host = F.coalesce(F.col("host"), F.lit(""))
    hosts = outcomes.groupBy(host.alias("host")).agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
    )
    plain = F.regexp_replace("host", r":\d*$", "")
    hosts = stage(hosts.withColumn("suffix", suffix_of(plain)).withColumn("domain", domain_of(plain)))
    share = F.sum("k") / F.when(F.sum("n") > 0, F.sum("n"))
    rate = hosts.agg(F.coalesce(share, F.lit(0.0)).alias("rate")).scalar()
    above, parent = None, None
    for level in LEVELS:
        keys = LEVELS[: LEVELS.index(level) + 1]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            groups = groups.withColumn("m", rate)
        else:
            groups = groups.join(above.select(*parent, F.col("mean").alias("m")), list(parent))
        spread = F.col("m") * (1 - F.col("m"))
        labelled = F.col("n") > 0
        moments = groups.where(labelled).agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("s"),
            F.sum(spread).alias("a"),
            F.sum(spread * (F.col("n") - 1)).alias("b"),
        )
        rho = F.greatest(F.lit(1e-4), F.least(F.lit(0.5), (F.col("s") - F.col("a")) / F.col("b")))
        strength = moments.select(1 / F.when(F.col("b") > 0, rho).otherwise(1e-4) - 1).scalar()
        groups = groups.withColumn("strength", strength)
        total = F.col("strength") + F.col("n")
        mean = (F.col("strength") * F.col("m") + F.col("k")) / total
        above = groups.withColumn("mean", mean).withColumn(
            "lower", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
        )
        parent = keys
    return above.select("host", "n", F.col("k").alias("bad"), "mean", "lower", rate.alias("rate"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], z: float = 1.645) -> DataFrame:
    """Judge every page by its URL.

    `pages`: page_id, url; `outcomes`: page_id, bad (0/1), repeated rows of a page count as bad if any is.
    Returns page_id, host, path, rule, verdict, one row per row of `pages` (repeated rows stay; a null id has
    no outcome). Other columns of either table are ignored. Empty tables give an empty result.
    """
    parts = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    marks = outcomes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parts.select("page_id", "host").join(marks, "page_id", "left")
    bad = (F.col("lower") > F.col("rate")) & (F.col("rate") > 0)
    blocked = host_reputation(labelled, z).where(bad).select("host", F.lit(True).alias("blocked"))
    judged = salted_join(parts, blocked, "host", "left")
    verdict = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), verdict).alias("verdict"),
    )
