"""Operator 4: URL filter by empirical-Bayes host reputation (DataFrame functions only).

Labelled pages are outcomes (good or not) of their hosts. A host with few
outcomes is shrunk towards its registered domain, that towards its public
suffix, that towards all pages: on each level the outcomes of the children
have a beta prior around the parent's posterior mean, with a strength fitted
by the method of moments to how much the children of that level differ. A
host is allowed if the lower bound of its posterior (mean less ``z`` standard
deviations) reaches ``least``. Fixed rules go before the method: of those
whose host the url's host is or lies under, and whose path begins the url's
path, the longest decides.

Outcomes are added up before they are shuffled, so a host with a third of all
pages is a few partial sums; its pages meet their host's verdict in a join
whose hot partitions Spark splits.

Defined results: a null url, or one without ``://``, has empty host and path;
the empty host is judged as any other. A page without label only gets a
verdict. A page_id with several labels is good if all its labels are. Pages
that repeat an id are each judged, and each counts if labelled. A host without
labelled pages has its domain's posterior, and so on up; without any label at
all the mean is the prior's 1/2. Empty tables give an empty result. Of other
columns none is passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, only, stage

#: Public suffixes of two labels; every other last label is a suffix itself.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")

#: Least posterior bound of an allowed host, and its distance from the mean.
LEAST_BOUND = 0.6
Z = 1.645

#: Range of a fitted prior's strength, in pseudo-outcomes.
WEAKEST, STRONGEST = 1.0, 1e6


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that applies, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    parts = [(r, *r.partition("/")[::2], v) for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(h).alias("host"), F.lit("/" + p).alias("path"),
                               F.lit(v).alias("verdict")) for r, h, p, v in parts])
    found = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"])))
                     & path.startswith(r["path"]))
    first = F.get(found, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _strength(children: DataFrame) -> float:
    """The strength of the beta prior of these children (n, good, mean): one number.

    Moments: the children's spread about their parents' means, less what
    binomial outcomes spread by themselves, is the variance of the prior.
    """
    n, m = F.col("n").cast("double"), F.col("mean")
    s = children.filter("n > 0").agg(
        F.sum(n * (F.col("good") / n - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("alone"),
        F.sum(n).alias("all"), F.sum(n * m * (1 - m)).alias("unit"), F.sum(n * n).alias("squares"))
    unit = F.col("unit") / F.col("all")
    var = F.try_divide(F.col("spread") - F.col("alone"), F.col("all") - F.col("squares") / F.col("all"))  # a single child: null
    fitted = F.when(var > 0, unit / F.when(var > 0, var) - 1)
    return s.select(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(fitted, F.lit(STRONGEST))))).first()[0]


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children (…, key, n, good) with the posterior (a, b, mean) under the prior of their parent."""
    under = children.join(parents.select(key, F.col("post").alias("mean")), key)
    under = under.withColumn("strength", F.lit(_strength(under)))
    a = F.col("mean") * F.col("strength") + F.col("good")
    b = (1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("good")
    return under.withColumn("a", a).withColumn("b", b).withColumn("post", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, good, a, b, post, bound of every host of ``pages``(page_id, host)."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcome = (only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null")
               .groupBy(F.col("doc_id").alias("page_id"))
               .agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")))
    hosts = (pages.join(outcome, "page_id", "left").groupBy("host")
             .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
             .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))

    hosts = stage(hosts)  # one row per host, read on every level

    def level(children: DataFrame, *by: str) -> DataFrame:
        return children.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    domains = level(hosts, "domain", "suffix")
    suffixes = level(domains, "suffix").withColumn("root", F.lit(0))
    root = (level(suffixes, "root").withColumn("post", (F.col("good") + 1) / (F.col("n") + 2)))
    suffixes = _shrunk(suffixes, root, "root")
    domains = _shrunk(domains, suffixes, "suffix")
    hosts = _shrunk(hosts, domains, "domain")
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.withColumn("bound", F.col("post") - Z * sd)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]],
          least: float = LEAST_BOUND) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's n, good of every page."""
    hosted = only(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = host_reputation(hosted.select("page_id", "host"), labels).select(
        "host", "n", "good", F.when(F.col("bound") >= least, "allow").otherwise("block").alias("_own"))
    fixed = deciding_rule(F.col("host"), F.col("path"), rules)
    return (hosted.join(known, "host").withColumn("_rule", fixed)
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                    F.coalesce(F.col("_rule.verdict"), F.col("_own")).alias("verdict"), "n", "good"))
