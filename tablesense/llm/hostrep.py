"""URL filter by empirical-Bayes host reputation (operator 1), DataFrames only.

Labelled page outcomes (good or bad) are counted per host. The tree suffix >
registered domain > host shares strength: each node's rate of good pages has a
beta prior centred at its parent's posterior mean, whose weight is fitted per
level as the beta-binomial moment estimate over all children. The bound of a
host is an upper quantile of its beta posterior (Laplace approximation on the
logit scale); the filter blocks hosts whose bound is below ``min_rate``, that is
those that are bad beyond doubt. Hosts with little evidence follow their domain.
Explicit rules (host, path) come first; the longest fitting one wins.

Pages are counted per host by partial aggregation before any shuffle, so a
host with a third of all pages costs one row per task. The verdict is joined
back by host: broadcast when the written host table is at most
``BROADCAST_NAMES`` rows, else by a shuffle join.

Defined results: a null url or one without ``://`` has empty host and path,
and is judged by the overall prior; repeated pages are each judged; several
labels of one page count each; a page without label adds no outcome; without
any label every bound is the default prior's; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import BROADCAST_NAMES, maybe_broadcast, written

# Suffixes of more than one label, under which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    min_rate: float = 0.5        # least rate of good pages
    z: float = 1.645             # one-sided 95 % upper bound
    root_good: float = 2.0       # prior of the root: Beta(good, bad)
    root_bad: float = 1.0
    least_weight: float = 1.0    # bounds of a fitted prior weight
    most_weight: float = 1000.0


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.array_join(F.reverse(F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), n)), ".")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(str(r))):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def fitted_weight(children: DataFrame, p: Reputation) -> float:
    """The beta-binomial moment estimate of the prior's weight from children
    (n, good) and their parents' means (mu): one aggregated row."""
    var = F.col("mu") * (1 - F.col("mu"))
    s, v, d = children.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mu"), 2)),
        F.sum(var), F.sum(var * (F.col("n") - 1))).first()
    if v is None:
        return p.least_weight
    raw = d / (s - v) - 1 if d > 0 and s > v else p.most_weight
    return max(p.least_weight, min(raw, p.most_weight))


def shrink(children: DataFrame, p: Reputation) -> DataFrame:
    """Add alpha, beta (posterior) and mean to children with n, good, mu."""
    w = F.lit(fitted_weight(children, p))
    return (children.withColumn("alpha", F.col("good") + w * F.col("mu"))
            .withColumn("beta", F.col("n") - F.col("good") + w * (1 - F.col("mu")))
            .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("mu"))


def host_reputation(outcomes: DataFrame, p: Reputation | None = None) -> DataFrame:
    """``outcomes`` (host, n, good) per host, unlabelled hosts with n = 0:
    host, n, good, mean, bound."""
    p = p or Reputation()
    hosts = (outcomes.withColumn("suffix", suffix_of(F.col("host")))
             .withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = written(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes")
    n, good = suffixes.agg(*sums).first()
    root = ((good or 0) + p.root_good) / ((n or 0) + p.root_good + p.root_bad)
    s = shrink(suffixes.withColumn("mu", F.lit(root)), p).select("suffix", F.col("mean").alias("mu"))
    d = written(shrink(domains.join(s, "suffix"), p).select("suffix", "domain", F.col("mean").alias("mu")), "domain-means")
    h = shrink(hosts.join(d, ["suffix", "domain"]), p)
    spread = F.sqrt(1 / F.col("alpha") + 1 / F.col("beta"))
    bound = 1 / (1 + F.exp(-(F.log(F.col("alpha") / F.col("beta")) + p.z * spread)))
    return h.select("host", "n", "good", "mean", bound.alias("bound"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[Rule], p: Reputation | None = None,
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every page. ``labels`` has columns id (the page's identifier) and
    good (boolean, null: no outcome). Result: page_id, host, path, rule,
    verdict, n (labelled pages of the host), mean, bound."""
    p = p or Reputation()
    u = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    u = u.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    per_page = (labels.where(F.col("good").isNotNull() & F.col("id").isNotNull()).groupBy("id")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good")))
    seen = u.join(per_page, u.page_id == per_page.id, "left")
    outcomes = written(seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                                                F.coalesce(F.sum("good"), F.lit(0)).alias("good")), "hosts")
    rep = maybe_broadcast(written(host_reputation(outcomes, p), "reputation"), limit=BROADCAST_NAMES)
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= p.min_rate, "allow").otherwise("block")
    return (u.join(rep, "host").withColumn("hit", hit)
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "n", "mean", "bound"))
