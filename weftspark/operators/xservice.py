"""Links between applications: hosts and environment variables against names, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import choice
from ..functions.text import before, name_prefixes, normal_name
from ..tables import materialise


def signals_of(apps: DataFrame) -> DataFrame:
    """(src, kind, hint, head) of the hosts and variables that ``apps`` (key, name, host_candidates, env_vars_read) list."""
    hosts = apps.select(F.col("key").alias("src"), F.lit("url").alias("kind"), F.explode("host_candidates").alias("hint"))
    envs = apps.select(F.col("key").alias("src"), F.lit("env").alias("kind"), F.explode("env_vars_read").alias("hint"))
    return hosts.unionByName(envs).distinct().withColumn("head", F.when(F.col("kind") == "url", before(F.col("hint"), ":")).otherwise(F.lower(before(F.col("hint"), "_"))))


def _named(apps: DataFrame, asked: DataFrame) -> DataFrame:
    """(src, kind, hint, target, score, why): applications that a signal's head names, its own among them.

    The name test is no loop over all pairs: two names match when one is among
    the other's beginnings up to a hyphen, which are equal joins.
    """
    names = apps.select(F.col("key").alias("target"), F.explode(F.array_distinct(F.array("key", F.coalesce("name", "key")))).alias("name")).filter("name <> ''")
    heads = asked.filter("head <> ''").withColumn("h", normal_name(F.col("head")))
    longer = names.select("target", F.explode(name_prefixes(F.col("name"))).alias("h")).distinct()
    exact = names.select("target", normal_name(F.col("name")).alias("n")).distinct()
    shorter = heads.select("src", "kind", "hint", F.explode(name_prefixes(F.col("head"))).alias("n"))
    by_name = heads.join(longer, "h").select("src", "kind", "hint", "target").unionByName(shorter.join(exact, "n").select("src", "kind", "hint", "target")).distinct()
    return by_name.select("src", "kind", "hint", "target", F.when(F.col("kind") == "url", 2).otherwise(1).alias("score"), F.concat_ws(" ", F.lit("named like"), "target").alias("why"))


def candidates(apps: DataFrame) -> DataFrame:
    """(src, kind, hint, target, score, why): applications that a signal may mean, never its own.

    Pairs of applications that list one signal are rows here: for a host that k
    of them list, k * (k - 1).  :func:`links` needs only the ambiguous signals' pairs.
    """
    asked = signals_of(apps)
    return _candidates(asked, asked, _named(apps, asked))


def _candidates(asked: DataFrame, listed: DataFrame, named: DataFrame) -> DataFrame:
    shared = asked.select("src", "kind", "hint").join(listed.select("kind", "hint", F.col("src").alias("target")), ["kind", "hint"]).select("src", "kind", "hint", "target", F.lit(2).alias("score"), F.concat_ws(" ", F.lit("listed also by"), "target").alias("why"))
    met = shared.unionByName(named).filter("src <> target")
    return met.groupBy("src", "kind", "hint", "target").agg(F.max("score").alias("score"), F.min("why").alias("why"))


def links(apps: DataFrame) -> DataFrame:
    """One row per signal: src, kind, hint, target, score, n_candidates, resolution, candidates (ranked); no target where nothing matches.

    A signal is judged by its two best candidates and their number.  Of those that
    list it too, the number and the three least keys are enough, summed up within
    tasks; all candidates are listed for ambiguous signals only, whose review
    shows them.
    """
    apps = materialise(apps, "applications")
    asked = materialise(signals_of(apps), "signals")
    named = materialise(_named(apps, asked).filter("src <> target"), "named")
    # Those that list a signal: how many, and the least three, of which two are others than the asking one.
    low = asked.groupBy("kind", "hint").agg(F.count(F.lit(1)).alias("listing"), F.min("src").alias("k1"))
    second = asked.join(low, ["kind", "hint"]).filter("src > k1").groupBy("kind", "hint").agg(F.min("src").alias("k2"))
    third = asked.join(second, ["kind", "hint"]).filter("src > k2").groupBy("kind", "hint").agg(F.min("src").alias("k3"))
    known = low.join(second, ["kind", "hint"], "left").join(third, ["kind", "hint"], "left")
    listed = asked.join(known, ["kind", "hint"]).withColumn("others", F.filter(F.array_compact(F.array("k1", "k2", "k3")), lambda k: k != F.col("src")))
    two = F.transform(F.slice("others", 1, 2), lambda k: F.struct(F.lit(-2).alias("low"), k.alias("target")))
    # Those that a name means but do not list it are counted beside them.
    is_listed = asked.select("kind", "hint", F.col("src").alias("target"), F.lit(True).alias("both"))
    apart = named.join(is_listed, ["kind", "hint", "target"], "left").filter("both is null")
    pair = F.struct((-F.col("score")).alias("low"), "target")
    first = apart.groupBy("src", "kind", "hint").agg(F.count(F.lit(1)).alias("naming"), F.min(pair).alias("n1"))
    rest = apart.join(first, ["src", "kind", "hint"]).filter((F.col("target") != F.col("n1.target"))).groupBy("src", "kind", "hint").agg(F.min(pair).alias("n2"))
    all_ = listed.join(first, ["src", "kind", "hint"], "left").join(rest, ["src", "kind", "hint"], "left")
    best = F.slice(F.array_sort(F.concat(two, F.array_compact(F.array("n1", "n2")))), 1, 2)
    judged = all_.select("src", "kind", "hint", (F.col("listing") - 1 + F.coalesce("naming", F.lit(0))).cast("int").alias("n_candidates"), best.alias("best"))
    top, next_ = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    told = judged.select("src", "kind", "hint", top["target"].alias("target"), (-top["low"]).alias("score"), "n_candidates", choice(F.col("n_candidates"), -top["low"], -next_["low"]).alias("resolution"))
    told = materialise(told, "judged")
    unsure = told.filter("resolution = 'ambiguous'").select("src", "kind", "hint")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "target", "score", "why"))), lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"), x["why"].alias("why")))
    lists = _candidates(asked.join(unsure, ["src", "kind", "hint"], "left_semi"), asked, named.join(unsure, ["src", "kind", "hint"], "left_semi")).groupBy("src", "kind", "hint").agg(ranked.alias("candidates"))
    return told.join(lists, ["src", "kind", "hint"], "left")


def request_edges(linked: DataFrame) -> DataFrame:
    return linked.filter("target is not null").select(F.lit("REQUESTS").alias("type"), F.concat(F.lit("app:"), "src").alias("src"), F.concat(F.lit("app:"), "target").alias("dst"), "kind", F.col("hint").alias("member"), "resolution")


def review_id(key: str, kind: str, hint: str) -> F.Column:
    digest = F.sha1(F.concat_ws("|", F.concat(F.lit("app:"), key), kind, hint).cast("binary"))
    return F.concat(key, F.lit(":review:"), F.substring(digest, 1, 12))


def reviews(linked: DataFrame) -> DataFrame:
    """Ambiguous links, for someone to decide."""
    some = linked.filter("resolution = 'ambiguous'")
    return some.select(
        review_id("src", "kind", "hint").alias("id"), F.concat(F.lit("app:"), "src").alias("call_id"), F.lit("REQUESTS").alias("edge_type"),
        F.concat(F.lit("app:"), "target").alias("chosen_id"), F.concat_ws(":", "kind", "hint").alias("hint"), F.lit("pending").alias("status"), "candidates",
    )


def report(linked: DataFrame) -> DataFrame:
    by = lambda r: F.count_if(F.col("resolution") == r).alias(r)
    return linked.agg(by("exact"), by("inferred"), by("ambiguous"), F.count_if(F.col("target").isNull()).alias("unmatched"))
