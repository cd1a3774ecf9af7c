"""URL filters: explicit host and path rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, then rolled up to the registered domain and the suffix. Each
level's rate is shrunk towards its parent's by a beta-binomial prior whose weight is fitted by moments over the
whole table. A host is blocked if even the lower quantile of its beta posterior is over the limit, which is set
by the bad rate of all outcomes unless it is given.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; the empty host is a host
like any other. Repeated pages each get a row and each counts as an outcome. No outcomes at all: every page that no
rule names is allowed. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rule, verdict; the text up to the first slash is the host, the rest the start of the path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Suffixes of two labels, besides the plain last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
#: A host is blocked if its lower bound is over so many times the rate of all outcomes.
LIFT = 1.25
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    where, _, start = rule.partition("/")
    return ((host == where) | host.endswith(f".{where}")) & path.startswith(f"/{start}")


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        hit = fits(rule, host, path)
        name = F.when(hit, F.lit(rule)) if name is None else name.when(hit, F.lit(rule))
        verdict = F.when(hit, F.lit(says)) if verdict is None else verdict.when(hit, F.lit(says))
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; suffixes: those of two labels. A single label is its own domain and suffix."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    suffix = F.when(long, two).otherwise(F.substring_index(host, ".", -1))
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), suffix


def _weight(table: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior weight by moments: n and k per group against the parent's rate p.

    E[(k/n - p)^2] = p(1-p)(1/n + (1-1/n)/(w+1)); solved for w over all groups, weighted by n.
    """
    x = table.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), 2)).alias("v"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("a"),
        F.sum((F.col("n") - 1) * F.col("p") * (1 - F.col("p"))).alias("b"),
    ).first()
    if not x["b"] or x["v"] is None or x["v"] <= x["a"]:
        return most
    return min(most, max(least, x["b"] / (x["v"] - x["a"]) - 1))


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction on the side where it settles fast."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    keep = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(z), 1 / keep(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            f = f * d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    return np.where(turned, 1 - front * f, front * f)


def beta_quantile(a, b, share: float) -> np.ndarray:
    """Where the distribution function of beta(a, b) reaches the share, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        under = beta_cdf(a, b, mid) < share
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _lower(a: Column, b: Column, share: float) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(x.to_numpy(), y.to_numpy(), share))

    return run(a, b)


def reputation(outcomes: DataFrame, limit: float | None = None, share: float = 0.05, lift: float = LIFT, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, bad (null: no outcome; other than 0 counts as bad) -> host, n, k, posterior mean, lower bound, blocked.

    One row per host that occurs, with or without outcomes. Counts are combined before they are shuffled, so a host with
    a third of all rows costs no more than any other. The lower bound is the posterior's quantile of `share`. limit: a rate; if not
    given, `lift` times the rate of all outcomes, at most half the way from it to one.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.when(F.col("bad") != 0, 1).otherwise(0)).alias("k"))
    domain, suffix = domain_of(F.col("host"), suffixes)
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = by_suffix.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    base = (total["k"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    w = _weight(by_suffix.select(F.col("sn").alias("n"), F.col("sk").alias("k"), F.lit(base).alias("p")))
    by_suffix = by_suffix.select("suffix", ((F.col("sk") + w * base) / (F.col("sn") + w)).alias("sp"))
    by_domain = by_domain.join(by_suffix, "suffix")
    w = _weight(by_domain.select(F.col("dn").alias("n"), F.col("dk").alias("k"), F.col("sp").alias("p")))
    by_domain = by_domain.select("domain", "suffix", ((F.col("dk") + w * F.col("sp")) / (F.col("dn") + w)).alias("p"))
    hosts = hosts.join(by_domain, ["domain", "suffix"])
    w = _weight(hosts)
    a, b = F.col("k") + w * F.col("p"), F.col("n") - F.col("k") + w * (1 - F.col("p"))
    limit = min(lift * base, (1 + base) / 2) if limit is None else limit
    judged = hosts.select("host", "n", "k", a.alias("a"), b.alias("b")).withColumn("bad_rate_low", _lower(F.col("a"), F.col("b"), share))
    # without any outcome there is no ground to block
    blocked = (F.col("bad_rate_low") > limit) & F.lit(bool(total["n"]))
    return judged.select("host", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), "bad_rate_low", blocked.alias("blocked"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float | None = None, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages: page_id, url. outcomes: url, bad. -> page_id, host, path, rule, verdict, bad_rate_low.

    Two joins at most: the few host rows against the pages, broadcast only if adaptive execution finds them under the
    session's own limit, else shuffled with skewed hosts split.
    """
    host, path = split_url(F.col("url"))
    known = reputation(outcomes.select(host.alias("host"), F.col("bad")), limit, suffixes=suffixes)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return judged.join(known.select("host", "bad_rate_low", "blocked"), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bad_rate_low",
    )
