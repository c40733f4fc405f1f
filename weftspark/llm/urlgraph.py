"""Operator 3: url filters by rules and by trust that flows over the host graph.

Rules judge the pages that they fit.  Hosts of allowed pages are seeds of trust,
hosts of blocked pages seeds of distrust.  Trust follows links (personalised
PageRank); distrust goes against them: who links to a blocked host is suspect.
Pages without a rule are judged by their host's share of distrust.

Links are absolute addresses in any ``href`` of the page, those of ``<base>`` and
``<link rel=canonical>`` among them, and the tie of each host to its own domain.

Built of DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

#: Fixed values of the contract: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Share of blocked pages that ``lift`` is a multiple of: fixed, so that no host's verdict hangs on how much of the whole table is blocked.
USUAL = 0.25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A link to another site: its host.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: str) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


#: Links of a host that one task joins at most; more are dealt to several.
FAN = 256
#: Labels that a name in the domain system can have.
LABELS = 127


def _labels(host: str) -> F.Column:
    return F.size(F.split(host, r"\."))


def _ends(host: str, most: int, least: int = 1) -> F.Column:
    """Ends of a host of ``least`` to ``most`` of its labels."""
    n = F.least(_labels(host), F.lit(most))
    each = F.transform(F.sequence(F.lit(least), n), lambda i: F.call_function("substring_index", F.col(host), F.lit("."), -i))
    return F.when(n >= least, each).otherwise(F.array().cast("array<string>"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: for each distinct host that any rule (rule, verdict) fits, all of those, longest first."""
    cut = rules.select(F.substring_index("rule", "/", 1).alias("domain"), F.expr("substr(rule, 1 + length(substring_index(rule, '/', 1)))").alias("start"), "rule", "verdict")
    # No domain of more labels than any rule's needs to be tried.
    most = cut.agg(F.max(_labels("domain"))).first()[0] or 0
    each = hosts.select("host", F.explode(_ends("host", most)).alias("domain"))
    fits = each.join(cut, "domain").groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "start", "verdict")).alias("rules"))
    return fits.select("host", F.sort_array("rules", asc=False).alias("rules"))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host, path) and rule, verdict of the longest rule that fits, else null."""
    # Written first, so that the join of a host with many pages can be split (AQE).
    fits = materialise(rules_by_host(pages.select("host").distinct(), rules), "rules")
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    return pages.join(fits, "host", "left").withColumn("__hit", hit).drop("rules").withColumn("rule", F.col("__hit.rule")).withColumn("verdict", F.col("__hit.verdict")).drop("__hit")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, as absolute links in ``html`` tell."""
    there = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst")
    links = pages.select(host_of("url").alias("src"), there).filter("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """Links both ways between each host and the domain right above it, up to names of two labels."""
    # A name has 127 labels at most: a longer string is no name and under no domain.
    names = hosts.filter(_labels("host") <= LABELS).select(F.explode(_ends("host", LABELS, 3)).alias("src")).distinct()
    steps = names.select("src", F.expr("substr(src, instr(src, '.') + 1)").alias("dst")).filter("src <> dst")
    both = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.withColumn("weight", F.lit(1.0))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.005, scaled: bool = True) -> DataFrame:
    """host, trust, distrust, usual: personalised PageRank from ``seeds`` (host and the same columns), to a tolerance.

    Trust goes from src to dst; distrust, and what is usual where all pages are
    seeds, from dst to src; each is split by weight.  A host without a way on
    keeps what it has, so nothing is lost, and none of it goes to far hosts.  All
    move in one join and one sum a round.  Rounds go on until in four of them no
    host's value moves by more than ``tolerance`` of itself, wherever most of the
    mass is.  Seeds are scaled to sum to one if ``scaled``.

    Links of a host with many are dealt by their other end; its row goes to each share.
    """
    kinds = ("trust", "distrust", "usual")
    total = materialise(links.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
    out = total.groupBy("src").agg(F.sum("weight").alias("all_out"))
    into = total.groupBy("dst").agg(F.sum("weight").alias("all_in"))
    out, into = materialise(out, "out"), materialise(into, "into")
    shared = total.join(out, "src").join(into, "dst")
    flows = shared.select("src", "dst", (F.col("weight") / F.col("all_out")).alias("along"), F.lit(0.0).alias("against")).unionByName(
        shared.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("along"), (F.col("weight") / F.col("all_in")).alias("against"))
    )
    hosts = total.select(F.col("src").alias("host")).unionByName(total.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    ends = hosts.join(out, hosts.host == out.src, "left").join(into, hosts.host == into.dst, "left")
    held = ends.filter("all_out is null or all_in is null").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.when(F.col("all_out").isNull(), 1.0).otherwise(0.0).alias("along"), F.when(F.col("all_in").isNull(), 1.0).otherwise(0.0).alias("against"))
    flows = flows.unionByName(held).groupBy("src", "dst").agg(F.sum("along").alias("along"), F.sum("against").alias("against"))
    flows = materialise(flows, "flows")
    fans = flows.groupBy(F.col("src").alias("host")).agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
    sums = seeds.agg(*(F.sum(k).alias(k) for k in kinds)).first() if scaled else dict.fromkeys(kinds, 1.0)
    start = seeds.select("host", *((F.col(k) / F.lit(float(sums[k]) if sums[k] else 1.0)).alias(k) for k in kinds))
    start = materialise(fans.join(start, "host", "left").select("host", "fan", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in kinds)), "seeds")
    dealt = materialise(flows.join(start.select(F.col("host").alias("src"), "fan"), "src").select("src", "dst", "along", "against", F.pmod(F.xxhash64("dst"), "fan").cast("int").alias("share")), "flows")
    discard(total, out, into, flows)
    returned = start.select("host", "fan", *((F.col(k) * (1 - damping)).alias(k) for k in kinds))
    part = {"trust": F.col("along"), "distrust": F.col("against"), "usual": F.col("against")}
    now, drop = start, []
    while True:
        before = now
        for _ in range(4):
            each = now.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
            moved = dealt.join(each, (dealt.src == each.host) & (dealt.share == each.share)).select(F.col("dst").alias("host"), F.lit(0).alias("fan"), *((F.col(k) * part[k] * damping).alias(k) for k in kinds))
            now = moved.unionByName(returned).groupBy("host").agg(F.max("fan").alias("fan"), *(F.sum(k).alias(k) for k in kinds))
        now = materialise(now, "ranks")
        old = before.select("host", *(F.col(k).alias(f"old_{k}") for k in kinds))
        moves = F.greatest(*(F.coalesce(F.abs(F.col(k) - F.col(f"old_{k}")) / F.nullif(F.col(k), F.lit(0.0)), F.lit(0.0)) for k in kinds))
        most = now.join(old, "host").agg(F.max(moves)).first()[0] or 0.0
        discard(*drop)
        drop = [now]
        if most <= tolerance:
            discard(dealt)
            return now.drop("fan")


def filter_urls(pages: DataFrame, rules: DataFrame, lift: float = 2.0, links: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A rule ``host/path`` fits its host and all subdomains if the path starts
    alike; the longest wins, of equally long ones the last by text.  Other pages
    are blocked when their host's distrust is more than its trust and more than
    ``lift`` times ``USUAL``.  Both scores are told as shares of what would reach
    the host if every page were a seed, each page weighing the same: distrust is
    the share of blocked pages among those near the host, and pages far from it
    change nothing.  A host that no distrust reaches is allowed.  Null urls and urls
    without ``://`` have an empty host and path and, without a rule, the verdict
    allow.  Null html has no links; html of any length is read whole.  A host of
    more than 127 labels is no name: it has no domain.  Repeated rows stay; an
    empty table gives none.  Extra columns are ignored, whatever their names.

    The host table is joined twice to pages without their html; which side is
    broadcast is left to its measured size.
    """
    parsed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    judged = materialise(apply_rules(parsed, rules), "judged")
    votes = judged.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").cast("double").alias("trust"), F.count_if(F.col("verdict") == "block").cast("double").alias("distrust"), F.count(F.lit(1)).cast("double").alias("usual")
    )
    votes = materialise(votes, "votes")
    edges = (host_links(pages) if links is None else links).unionByName(domain_links(votes.select("host")))
    ranks = propagate(edges, votes, scaled=False)
    scores = ranks.select("host", *(F.round(F.col(k) / F.nullif(F.col("usual"), F.lit(0.0)), 6).alias(k) for k in ("trust", "distrust")))
    by_host = F.when((F.col("distrust") > lift * USUAL) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0))), "block").otherwise("allow")
    return judged.join(materialise(scores, "scores"), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), "trust", "distrust")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))
    return spark.range(1).select(F.inline(each))
