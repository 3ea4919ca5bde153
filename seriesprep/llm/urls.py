"""URL filter: hand-made rules first, then an empirical-Bayes reputation of the host.

The share of bad pages of a host is a beta-binomial posterior. Its prior is the posterior mean of
the registered domain, whose prior is that of the suffix, whose prior is that of all pages. The
prior's weight at each level is estimated from how much the children differ beyond chance (method
of moments). A host is blocked when the lower bound of its bad share passes a threshold, so a few
bad pages of a little-known host do not block it.

Defined results: a null url or one without ``://`` has empty host and path and the reputation of
the empty host. A page without label counts nowhere as evidence; without any label every page is
allowed unless a rule blocks it. A page with several label rows is bad if one of them is. Repeated
pages are judged each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import ascii_lower, stored


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The stated rules.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
#: Suffixes of two labels under which names are registered. Fixed values.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za")
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls; of equal ones the first."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_levels(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host, without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(wide, F.substring_index(name, ".", -3)).otherwise(two)


def prior_weight(children: DataFrame, mean: str, least: float = 1.0, most: float = 1_000.0) -> float:
    """Pseudo-observations of a level's prior: from the spread of the children's shares about
    their priors beyond binomial chance."""
    n, k, m = F.col("n"), F.col("k"), F.col(mean)
    spread = F.sum(n * F.pow(k / n - m, 2) / (m * (1 - m)))
    row = children.filter("n > 0").agg(spread.alias("x"), F.count("*").alias("c"), F.sum(n - 1).alias("d")).first()
    if not row.c or not row.d:
        return most
    share = (row.x - row.c) / row.d
    return min(most, max(least, 1 / share - 1)) if share > 0 else most


def host_reputation(urls: DataFrame, outcomes: DataFrame, z: float) -> DataFrame:
    """``host, bad_mean, bad_low`` of every host in ``urls`` (page_id, host).

    Pages are summed to one row per host, with partial sums before the shuffle; every later step
    works on host rows. Only three numbers, the weights, come to the driver.
    """
    suffix, domain = host_levels(F.col("host"))
    hosts = stored(
        urls.join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k"),
        "hosts",
    )
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((whole.k or 0) + 1) / ((whole.n or 0) + 2)
    level, prior = hosts, F.lit(float(base))
    known: DataFrame | None = None
    for i, key in enumerate(LEVELS):
        upper = LEVELS[i - 1] if i else None
        keys = [key, upper] if upper else [key]
        level = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if known is None:
            level = level.withColumn("prior", prior)
        else:
            level = level.join(known.select(upper, F.col("mean").alias("prior")), upper)
        weight = F.lit(prior_weight(level, "prior"))
        a = F.col("prior") * weight + F.col("k")
        b = (1 - F.col("prior")) * weight + F.col("n") - F.col("k")
        known = level.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return known.select("host", F.col("mean").alias("bad_mean"), (F.col("mean") - z * deviation).alias("bad_low"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: 1 for low quality or toxic; rows without any outcome are left out."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"))
        .filter("bad is not null")
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[UrlRule] = RULES,
    bad_share: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_mean, bad_low`` of every page.

    ``outcomes``: ``page_id, bad`` (0/1), one row per page. The join with the host table may have
    hot hosts; it is a plain equi-join, so the adaptive skew join splits them.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(urls.select("page_id", "host"), outcomes, z)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bad_low") > bad_share, "block").otherwise("allow")
    return urls.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"), "bad_mean", "bad_low",
    )
