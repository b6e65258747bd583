"""Empirical-Bayes host reputation in SQL functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix.  A
beta-binomial prior goes down the levels: the corpus rate shrinks each suffix, the suffix's posterior
mean shrinks each domain, the domain's each host.  The strength of a level's prior (its pseudo-count)
comes from the method of moments over that level's groups.  A host whose lower posterior bound
``mean - z * sd`` of the bad rate exceeds ``limit`` is blocked; longest matching rules come first.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by the corpus prior; hosts without outcomes get their domain's posterior; repeated page rows are judged
each; an empty table gives an empty result; outcomes of unknown pages are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basetrack.llm.common import join_hot, materialise, shared_dir


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query: (verdict, host, path).
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Second labels under which names are registered, by country.
_SECOND = {
    "ar": "com edu gob gov int mil net org tur", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "art blog com eco edu gov mil net org", "cn": "ac com edu gov mil net org",
    "co": "com edu gov net nom org", "ec": "com edu gob net org", "eg": "com edu gov net org", "es": "com edu gob nom org", "gr": "com edu gov net org", "hk": "com edu gov idv net org", "hu": "co org",
    "id": "ac co go my net or sch web", "il": "ac co gov muni net org", "in": "ac co edu firm gen gov ind mil net nic org res", "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go ne or", "kr": "ac co go ne or pe re",
    "mx": "com edu gob net org", "my": "com edu gov mil name net org", "ng": "com edu gov net org", "nz": "ac co geek gen govt iwi maori net org school", "pe": "com edu gob net nom org", "ph": "com edu gov net org",
    "pk": "com edu gov net org", "pl": "com edu gov net org", "pt": "com edu gov org", "sa": "com edu gov net org", "sg": "com edu gov net org per", "th": "ac co go in mi net or", "tr": "com edu gen gov net org web",
    "tw": "com edu game gov idv net org", "ua": "com edu gov in net org", "uk": "ac co gov ltd me net nhs org plc police", "uy": "com edu gub net org", "ve": "co com gob net org", "vn": "com edu gov net org", "za": "ac co gov law net nom org school web",
}
#: Suffixes of two labels; any other suffix is the last label.
SUFFIXES = tuple(f"{label}.{country}" for country, labels in _SECOND.items() for label in labels.split())


@dataclass(frozen=True)
class Reputation:
    limit: float = 0.5
    z: float = 1.6448536269514722
    #: The strength of a prior when its groups differ by no more than chance, and its bounds.
    weakest: float = 2.0
    strongest: float = 1000.0
    suffixes: tuple[str, ...] = SUFFIXES


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; then the path up to ? # or the end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  The rule list is a parameter, so this is one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # longer ones are laid over shorter ones
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a numeric host is both itself."""
    two, numeric = F.substring_index(host, ".", -2), host.rlike(r"^[0-9]+([.][0-9]+){3}(:[0-9]*)?$")
    suffix = F.when(numeric, host).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(numeric, host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(groups: DataFrame, mean: Column, r: Reputation) -> DataFrame:
    """One row: the pseudo-count of a level's prior by moments; groups: n, bad and the mean they are shrunk to."""
    s = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)).alias("q"),
        F.sum(mean * (1 - mean)).alias("v"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("nv"),
        F.count(F.lit(1)).alias("k"),
    )
    # E[q] = v * (1 - rho) + nv * rho, rho = 1 / (strength + 1): rho is the overdispersion
    rho = F.when((F.col("k") > 1) & (F.col("nv") > F.col("v")), (F.col("q") - F.col("v")) / (F.col("nv") - F.col("v")))
    rho = F.when(rho > 0, F.least(rho, F.lit(1.0)))
    return s.select(F.least(F.greatest(F.coalesce(1 / rho - 1, F.lit(r.strongest)), F.lit(r.weakest)), F.lit(r.strongest)).alias("m"))


def host_posteriors(pages: DataFrame, outcomes: DataFrame, r: Reputation = Reputation(), folder: str | None = None) -> DataFrame:
    """One row per host of ``pages`` (host, domain, suffix): n, bad, the posterior's a and b, mean and bound.

    ``pages``: page_id, host; ``outcomes``: page_id, bad (0 or 1).  The one shuffle that is as large as the input
    is the join by page; all groups are summed on the map side first, so a host with a third of the pages costs no more.
    """
    labelled = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    counted = pages.join(labelled, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    domain, suffix = levels(F.col("host"), r.suffixes)
    # written once: every level above is drawn from the table of hosts several times
    folder = folder or shared_dir(pages.sparkSession)
    hosts = materialise(counted.withColumns({"domain": domain, "suffix": suffix}), folder, "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), folder, "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), folder, "suffixes")
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).alias("p"))

    def shrink(groups: DataFrame, prior: str, out: str) -> DataFrame:
        m = _strength(groups.where("n > 0"), F.col(prior), r)  # one row: an aggregate without groups
        a, b = F.col(prior) * F.col("m") + F.col("bad"), (1 - F.col(prior)) * F.col("m") + F.col("n") - F.col("bad")
        return groups.join(F.broadcast(m)).withColumns({"a": a, "b": b}).withColumn(out, F.col("a") / (F.col("a") + F.col("b"))).drop("m")

    s = shrink(suffixes.join(F.broadcast(overall)), "p", "suffix_mean").select("suffix", "suffix_mean")
    s = materialise(s, folder, "suffix_means")
    d = materialise(shrink(domains.join(s, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean"), folder, "domain_means")
    h = shrink(hosts.join(d, "domain"), "domain_mean", "mean")
    a, b = F.col("a"), F.col("b")
    return h.withColumn("bound", F.col("mean") - r.z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, r: Reputation = Reputation(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the bound by which the method judged."""
    host, path = split_url(F.col("url"))
    rows = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    bound = host_posteriors(rows.select("page_id", "host"), outcomes, r).select("host", "n", "pages", "mean", "bound")
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > r.limit, "block").otherwise("allow")
    total = bound.agg(F.sum("pages")).first()[0] or 0
    return join_hot(rows, bound, ["host"], "pages", total, "page_id").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("n").cast("long").alias("n_outcomes"), F.round("mean", 6).alias("bad_mean"), F.round("bound", 6).alias("bad_bound"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from a label table whose doc_id is the page's id: a page is bad if its quality is 0 or it is toxic.

    The given labels are of documents that merely share their numbers with pages, so figures drawn from them say nothing of any host; they
    stand in until there are outcomes of pages, which go to ``judge`` as they are.
    """
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
