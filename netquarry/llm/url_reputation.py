"""URL filter: curated rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and public suffix. From the top down each
level's beta prior is its parent's posterior mean with a strength fitted to that level by the method of moments: the
more the children of a level differ from their parents, the weaker the prior and the more a host's own pages count.
A host is blocked if its share of bad pages exceeds `limit` with a probability of at least `certainty`, that is if the
lower posterior bound lies above the limit; a host with few labelled pages keeps its parents' standing.

Everything is DataFrame operations. Outcomes are summed in each partition before the shuffle, so a host with a third
of all pages costs no more than others; the host table joins pages as Spark sees fit, and adaptive execution splits a
hot host's pages. The bound is a normal approximation of the beta posterior on the logit scale.

A null or malformed url has an empty host and path and gets the verdict of the prior for unknown hosts. Pages may
repeat; outcomes that are null do not count. Without any outcome the prior is one half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import settle

LIMIT = 0.5
CERTAINTY_Z = 1.2816  # one-sided 90 %
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0
#: Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "net.au", "org.au", "org.uk"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host without its port; a bare name is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    double = two.isin(TWO_LABEL_SUFFIXES)
    suffix = F.when(double, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _shrunk(child: DataFrame, parent: DataFrame, up: str) -> DataFrame:
    """child: (key, its parent in `up`, bad, n) -> with p, the posterior mean under a prior at the parent's p, and a, b of the beta."""
    both = child.join(parent.select(F.col(parent.columns[0]).alias(up), F.col("p").alias("prior")), up, "left")
    # Moments: E[(bad - n prior)^2] = n prior (1 - prior) (1 + (n - 1) / (strength + 1)).
    v = F.col("prior") * (1 - F.col("prior"))
    extra = F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * v)
    scale = F.sum(F.col("n") * (F.col("n") - 1) * v)
    rho = both.where("n > 0").groupBy(F.lit(1).alias("one")).agg((extra / F.when(scale > 0, scale)).alias("rho"))
    strength = F.when(F.col("rho") > 0, 1 / F.col("rho") - 1).otherwise(F.lit(MOST_STRENGTH))
    strength = F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), strength))
    fitted = F.broadcast(rho.select("one", strength.alias("strength")))  # a single row
    out = both.withColumn("one", F.lit(1)).join(fitted, "one", "left")
    out = out.withColumn("strength", F.coalesce("strength", F.lit(MOST_STRENGTH)))  # no outcome at all
    out = out.withColumn("a", F.col("strength") * F.col("prior") + F.col("bad"))
    out = out.withColumn("b", F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad"))
    return out.withColumn("p", F.col("a") / (F.col("a") + F.col("b")))


def reputations(pages: DataFrame) -> DataFrame:
    """pages: (host, outcome) -> one row per host: host, n, bad, bad_rate (posterior mean), lower (posterior bound)."""
    domain, suffix = levels(F.col("host"))
    bad = F.when(F.col("outcome") == 0, 1).when(F.col("outcome").isNotNull(), 0)
    hosts = pages.groupBy("host").agg(F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.count(bad).alias("n"))
    hosts = settle(hosts.withColumn("domain", domain).withColumn("suffix", suffix))  # one row per host, read by three levels
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(1))
    top = suffixes.groupBy("all").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("p"))
    suffixes = _shrunk(suffixes, top, "all").select("suffix", "p")
    domains = settle(_shrunk(settle(domains), settle(suffixes), "suffix").select("domain", "p"))
    found = _shrunk(hosts, domains, "domain")
    sd = F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    lower = 1 / (1 + F.exp(-(F.log(F.col("a") / F.col("b")) - CERTAINTY_Z * sd)))
    return found.select("host", "n", "bad", F.col("p").alias("bad_rate"), lower.alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_rate, lower. outcomes: (_url, outcome) of labelled pages."""
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_page"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    labelled = outcomes.select(F.col("_url"), "outcome").withColumn("host", url_parts(F.col("_url"))[0])
    unseen = rows.select("host", F.lit(None).cast("int").alias("outcome"))
    found = reputations(labelled.select("host", F.col("outcome").cast("int").alias("outcome")).unionByName(unseen))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = rows.join(found, "host").withColumn("rule", rule)
    by_host = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select(
        F.col("_page").alias(id_col), "host", "path", "rule", F.coalesce(verdict, by_host).alias("verdict"), "bad_rate", "lower"
    )
