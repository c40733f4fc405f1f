"""What is handed down: each id has names of its own, and those of others in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import counted, joined_by_size, materialise

#: Ids that may be left to a search over whole ways: of so many, rounds would take longer.
FEW = 1000


def _firsts(held: str, ordered: str) -> Column:
    """Of ``held``, sorted as ``ordered`` is, the first entry of each name."""
    return F.filter(held, lambda x, i: (i == 0) | ~x["name"].eqNullSafe(F.get(ordered, i - 1)["name"]))


def handed_down(own: DataFrame, ways: DataFrame, but: tuple[str, ...] = (), few: int = FEW) -> tuple[DataFrame, DataFrame] | None:
    """(id, held) of the ids that are settled, and (id) of those left; None if there are at most ``few`` with ways at all.

    ``own``: id, held (array of name, rank, value), one row an id.  ``ways``: id,
    parent, every (rank, null: not every name), some (array of name, there, rank:
    the parent's name ``there`` alone), one row a pair.  Of a name the smallest
    rank wins; ``every`` leaves out the names in ``but``.

    An id is settled once, when all its parents are: it moves what it holds along
    its ways, so that work grows with the result and not with the ways there are
    to all ancestors.  A round settles one level.  Left are ids in circles and
    those above which one stands, or the last few.
    """
    spark = own.sparkSession
    with joined_by_size(spark):
        ways = materialise(ways, "ways")
        left = ways.select("id").distinct().count()
        if left <= few:
            return None
        own = materialise(own.withColumn("held", F.array_sort("held")).withColumn("held", _firsts("held", "held")), "own")
        need = ways.groupBy("id").agg(F.count(F.lit(1)).alias("need"))
        heirs = ways.select("id").distinct()
        roots = own.select("id").unionByName(ways.select(F.col("parent").alias("id"))).distinct().join(heirs, "id", "left_anti")
        none = F.array().cast(own.schema["held"].dataType)
        new = materialise(roots.join(own, "id", "left").withColumn("held", F.coalesce("held", none)), "handed")
        ways = materialise(ways.join(need, "id").join(own, "id", "left").withColumn("held", F.coalesce("held", none)), "ways")
        settled, waiting = new, None
        while left > few:
            there = new.select(F.col("id").alias("parent"), F.col("held").alias("given"))
            every = F.when(F.col("every").isNotNull(), F.transform(F.filter("given", lambda x: ~x["name"].isin(*but)) if but else F.col("given"), lambda x: F.struct(x["name"].alias("name"), F.col("every").alias("rank"), x["value"].alias("value"))))
            some = F.flatten(F.transform("some", lambda s: F.transform(F.filter("given", lambda x: x["name"] == s["there"]), lambda x: F.struct(s["name"].alias("name"), s["rank"].alias("rank"), x["value"].alias("value")))))
            got = ways.join(there, "parent").select("id", "need", F.lit(1).cast("long").alias("have"), F.concat("held", F.coalesce(every, none), F.coalesce(some, none)).alias("held"))
            both = got if waiting is None else waiting.unionByName(got)
            both = both.groupBy("id").agg(F.max("need").alias("need"), F.sum("have").alias("have"), F.flatten(F.collect_list("held")).alias("held"))
            state, n = counted(both.withColumn("held", F.array_sort("held")).withColumn("held", _firsts("held", "held")), "handed", "have = need")
            if not n:
                break
            new, waiting, left = state.filter("have = need").select("id", "held"), state.filter("have < need"), left - n
            settled = settled.unionByName(new)
        return settled, materialise(heirs.join(settled.select("id"), "id", "left_anti"), "left") if left else heirs.limit(0)
