"""A graph's history as intervals: a row for as long as it stays the same, opened and closed by revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialise
from .paths import ancestors

#: Nodes whose content is hashed, and what tells an edge from others.
EDGE_KEYS = ("type", "src", "dst", "member", "idx")


def fold(versions: DataFrame | None, snapshot: DataFrame, keys: list[str], at: int) -> DataFrame:
    """``versions`` (keys, hash, valid_from, valid_to) after one more revision ``at``, whose rows are ``snapshot`` (keys, hash).

    A row that stays as it was stays open; one that changed is closed and opened
    anew; one that is gone is closed, and opened again should it come back.  Null
    keys are equal; repeated rows of one key count once, the least hash.  Closed
    versions are never touched: only open ones are joined.
    """
    now = snapshot.groupBy(*keys).agg(F.min("hash").alias("__now"), F.lit(True).alias("__in"))
    if versions is None:
        return now.select(*keys, F.col("__now").alias("hash"), F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    opened = versions.filter("valid_to is null").withColumn("__was", F.lit(True))
    same = [opened[k].eqNullSafe(now[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    both = opened.join(now, condition, "full_outer")
    stays = F.coalesce(F.col("__was") & F.col("__in") & F.col("hash").eqNullSafe(F.col("__now")), F.lit(False))
    key = [F.coalesce(opened[k], now[k]).alias(k) for k in keys]
    both = both.select(*key, "hash", "valid_from", "__now", "__was", "__in", stays.alias("__stays"))
    kept = both.filter("__was").select(*keys, "hash", "valid_from", F.when(~F.col("__stays"), F.lit(at)).cast("long").alias("valid_to"))
    new = both.filter("__in and not __stays").select(*keys, F.col("__now").alias("hash"), F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return versions.filter("valid_to is not null").unionByName(kept).unionByName(new)


def fold_all(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The versions that folding all revisions of ``snapshots`` (at, keys, hash) one by one gives, in one go: islands of revisions that follow each other."""
    order = materialise(snapshots.select("at").distinct(), "revisions")
    # As many rows as there are revisions.
    placed = order.withColumn("place", F.row_number().over(W.orderBy("at"))).withColumn("next", F.lead("at").over(W.orderBy("at")))
    rows = snapshots.groupBy("at", *keys).agg(F.min("hash").alias("hash")).join(F.broadcast(placed), "at")
    w = W.partitionBy(*keys).orderBy("place")
    begins = F.coalesce((F.lag("place").over(w) != F.col("place") - 1) | ~F.lag("hash").over(w).eqNullSafe(F.col("hash")), F.lit(True))
    rows = rows.withColumn("__begins", begins).withColumn("__island", F.sum(F.col("__begins").cast("int")).over(w))
    return rows.groupBy(*keys, "hash", "__island").agg(F.min("at").cast("long").alias("valid_from"), F.max_by("next", "place").cast("long").alias("valid_to")).drop("__island")


def as_of(versions: DataFrame, at: int) -> DataFrame:
    """The rows (keys, hash) of revision ``at``."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).drop("valid_from", "valid_to")


def node_rows(nodes: DataFrame) -> DataFrame:
    """(id, hash): what a revision's nodes are told by, a hash of all their columns but seq."""
    told = [c for c in sorted(nodes.columns) if c not in ("id", "seq")]
    return nodes.select("id", F.sha2(F.to_json(F.struct(*told)), 256).alias("hash"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """(type, src, dst, member, idx, hash) of a revision's edges; the hash holds the rest."""
    return edges.select(*EDGE_KEYS, F.concat_ws("|", "operator", "resolution").alias("hash"))


def lineages(renames: DataFrame) -> DataFrame:
    """(id, origin, steps): each name that ``renames`` (at, old_id, new_id) tell, and the first name that it goes back to.

    Of several names that one got in turn, each goes back to the first.  A name
    that goes round (a to b, b to a) is told apart by the revision, so steps only go back in
    time: a rename follows the last one before it that gave its old name.
    """
    r = renames.select("at", "old_id", "new_id").distinct()
    step = r.select(F.concat_ws("\u0001", "new_id", "at").alias("id"), "at", "old_id", "new_id")
    before = r.select(F.col("new_id").alias("old_id"), F.col("at").alias("earlier"))
    last = step.join(before, "old_id", "left").filter("earlier is null or earlier < at").groupBy("id", "at", "old_id", "new_id").agg(F.max("earlier").alias("earlier"))
    # Those whose old name was only given later begin their line too.
    last = last.unionByName(step.join(last.select("id"), "id", "left_anti").withColumn("earlier", F.lit(None).cast(last.schema["earlier"].dataType)))
    last = materialise(last, "steps")
    parents = last.select("id", F.when(F.col("earlier").isNotNull(), F.concat_ws("\u0001", "old_id", "earlier")).alias("parent"))
    top = ancestors(parents).groupBy("id").agg(F.max_by("ancestor", "depth").alias("top"), F.max("depth").alias("depth"))
    first = last.select(F.col("id").alias("top"), F.col("old_id").alias("origin"))
    told = top.join(first, "top").join(last.select("id", "new_id", "at"), "id")
    newest = told.groupBy("new_id").agg(F.max_by(F.struct("origin", "depth"), "at").alias("o"))
    return newest.select(F.col("new_id").alias("id"), "o.origin", (F.col("o.depth") + 1).alias("steps"))
