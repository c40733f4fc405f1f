"""Reachability over edges by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import counted, discard, materialise


def reach(edges: DataFrame, starts: DataFrame, depth: int, stops: DataFrame | None = None) -> DataFrame:
    """(start, node, distance): nodes within ``depth`` steps over ``edges`` (src, dst), by the shortest way.

    Each round joins only what was new in the last.  Beyond ``stops`` (node) no
    way goes on.  Rounds and steps are written, so that plans stay short.  Rows
    are as many as pairs of a start and what it reaches: choose starts and depth
    by that.
    """
    steps = materialise(edges.select("src", "dst").distinct(), "steps")
    new = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    seen = materialise(new, "reach")
    new = seen
    for d in range(1, depth + 1):
        open_ = new if stops is None else new.join(stops, "node", "left_anti")
        found = open_.join(steps, open_.node == steps.src).select("start", F.col("dst").alias("node"), F.lit(d).alias("distance")).distinct()
        new, n = counted(found.join(seen, ["start", "node"], "left_anti"), "reach")
        if not n:
            break
        seen = seen.unionByName(new)
    return seen.filter("distance > 0")


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of ``parents`` (id, parent), each id its own ancestor at depth 0.

    Rounds double the reach: chains of n levels take log n joins, each of what is
    furthest so far with all that is known.  They end when nothing new is found.
    """
    own = parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    hop = parents.filter("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    closure = materialise(own.unionByName(hop).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
    reached = 1
    while True:
        far, near = closure.filter(F.col("depth") == reached).alias("a"), closure.filter("depth > 0").alias("b")
        further = far.join(near, F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        new = further.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).join(closure, ["id", "ancestor"], "left_anti")
        new, n = counted(new, "ancestors")
        if not n:
            return closure
        closure, reached = closure.unionByName(new), reached * 2


def first_ways(parents: DataFrame) -> DataFrame:
    """(id, ancestor, way) of ``parents`` (id, parent, seq): the way to each ancestor that a walk depth first, parents in order, takes first.

    ``way``: seq and node of each step.  Ways of one row come in order of that
    walk: an ancestor before what is above it.  No way meets a node twice, so
    circles end.  The beginning of a first way is itself one: so rounds double
    the length, joining only the ways of full length with all that is known, and
    end when there is none.
    """
    step = F.struct(F.col("seq").cast("long").alias("seq"), F.col("parent").alias("node"))
    known = parents.filter("id <> parent").groupBy("id", F.col("parent").alias("ancestor")).agg(F.min(F.array(step)).alias("way"))
    known, reached = materialise(known, "ways"), 1
    while True:
        a, b = known.filter(F.size("way") == reached).alias("a"), known.alias("b")
        way = F.concat("a.way", "b.way")
        further = a.join(b, F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", way.alias("way"))
        nodes = F.array_append(F.transform("way", lambda x: x["node"]), F.col("id"))
        further, n = counted(further.filter(F.size(F.array_distinct(nodes)) == F.size(nodes)).groupBy("id", "ancestor").agg(F.min("way").alias("way")), "ways")
        if not n:
            return known
        old, known = known, materialise(known.unionByName(further).groupBy("id", "ancestor").agg(F.min("way").alias("way")), "ways")
        discard(old, further)
        reached *= 2


def first_found(starts: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(start, value) of each of ``starts`` that reaches one of ``ends`` (node, rank, value) over ``edges`` (src, dst, rank): the end that comes first depth first.

    At a node, edges and ends are taken by rank; no way meets a node twice.  The
    first way to an end begins with first ways to the nodes on it, so of each
    start and node only the first way known so far is kept.  A round extends the
    ways that the last one found or bettered, unless an end comes before them.
    """
    step = lambda node: F.struct(F.col("rank").cast("long").alias("rank"), node.alias("node"))
    edges, ends = materialise(edges, "steps"), materialise(ends.select(F.col("node").alias("at"), F.col("rank").cast("long").alias("rank"), "value"), "ends")
    best = materialise(starts.select("start", F.col("start").alias("at"), F.array().cast("array<struct<rank:bigint,node:string>>").alias("way")).distinct(), "ways")
    new, hits = best, None
    while True:
        met = new.join(ends, "at").select("start", F.array_append("way", step(F.lit(""))).alias("way"), "value")
        old = hits
        hits = materialise((met if hits is None else hits.unionByName(met)).groupBy("start").agg(F.min("way").alias("way"), F.min_by("value", "way").alias("value")), "found")
        discard(old)
        longer = new.join(edges, new["at"] == edges["src"]).select("start", F.col("dst").alias("at"), "way", "rank")
        longer = longer.filter((F.col("at") != F.col("start")) & ~F.exists("way", lambda x: x["node"] == F.col("at")))
        longer = longer.select("start", "at", F.array_append("way", step(F.col("at"))).alias("way"))
        hit = hits.select("start", F.col("way").alias("ended"))
        longer = longer.join(hit, "start", "left").filter("ended is null or way < ended").groupBy("start", "at").agg(F.min("way").alias("way"))
        known = best.select("start", "at", F.col("way").alias("had"))
        new, n = counted(longer.join(known, ["start", "at"], "left").filter("had is null or way < had").select("start", "at", "way"), "ways")
        if not n:
            return hits.select("start", "value")
        old, best = best, materialise(best.unionByName(new).groupBy("start", "at").agg(F.min("way").alias("way")), "ways")
        discard(old)


def nearest(lookups: DataFrame, closure: DataFrame, names: DataFrame) -> DataFrame:
    """``lookups`` (scope, name, ...) with node of the nearest ancestor scope that ``names`` (scope, name, node, seq) declares the name in; null if none.

    Of several declarations in one scope the last wins.
    """
    declared = names.groupBy("scope", "name").agg(F.max_by("node", "seq").alias("node")).withColumnRenamed("scope", "ancestor")
    asked = lookups.select("scope", "name").distinct()
    met = asked.join(closure.withColumnRenamed("id", "scope"), "scope").join(declared, ["ancestor", "name"])
    best = met.groupBy("scope", "name").agg(F.min_by("node", "depth").alias("node"))
    return lookups.join(best, ["scope", "name"], "left")
