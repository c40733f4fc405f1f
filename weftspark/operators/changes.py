"""From two revisions to what changed: touched declarations, dependencies as bags of the declarations that have them, renames of symbols, one change set.

Identities of calls and statements hold their place in the text, so they say
nothing across revisions.  Their edges are lifted to the declaration around
them and compared as bags, whatever lines moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..tables import counted, discard, materialise
from .history import bag_difference, renamed, semantic_diff
from .spans import overlapping

#: Types of nodes that a report names; others belong to one of them.
DECLARATIONS = ("Function", "Class", "Interface", "Field", "Enum", "EnumMember")
#: Types of edges that say what a declaration depends on.
DEPENDENCIES = ("CALLS", "INSTANTIATES", "READS", "WRITES", "ARGUMENT", "HAS_TYPE", "HAS_TYPE_ARG", "RETURNS_TYPE", "EXTENDS", "IMPLEMENTS", "IMPORTS")


def is_declaration(nodes: DataFrame) -> Column:
    """Named declarations, and variables that a file holds itself."""
    named = F.col("type").isin(*DECLARATIONS) & ~F.coalesce(F.col("name").startswith("fn@"), F.lit(False))
    return named | ((F.col("type") == "Variable") & F.col("owner_id").eqNullSafe(F.col("file_id")))


def declared_owners(nodes: DataFrame) -> DataFrame:
    """(id, owner): each of ``nodes`` (id, type, name, owner_id, file_id) and the innermost declaration that it is or is in; its file where there is none.

    Pointers to owners jump twice as far each round, and stay where they meet a
    declaration or what is no node here: so log(depth) joins do.
    """
    stops = is_declaration(nodes) | F.col("owner_id").isNull()
    state = nodes.select("id", F.when(stops, F.col("id")).otherwise(F.col("owner_id")).alias("to"), F.coalesce(stops, F.lit(False)).alias("done"))
    state, waiting = counted(state, "owners", "not done")
    while waiting:
        there = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("ends"))
        joined = state.filter("not done").join(there, "to", "left")
        moved = joined.select("id", F.coalesce("next", "to").alias("to"), (F.col("next").isNull() | (F.col("ends") & (F.col("next") == F.col("to"))) | F.col("ends")).alias("done"))
        old = state
        state, waiting = counted(state.filter("done").unionByName(moved), "owners", "not done")
        discard(old)
    return state.select("id", F.col("to").alias("owner"))


def dependency_bags(graph: Graph) -> DataFrame:
    """(owner, type, target, member, idx) of a graph's DEPENDENCIES, a row an edge, the same wherever in its file a statement stands.

    A call's member is what it calls, as it is written; a target that has no name of its
    own is told by its owner, type and name.
    """
    nodes = graph.nodes.select("id", "type", "name", "owner_id", "file_id")
    owners = declared_owners(nodes)
    keys = nodes.join(owners, "id").select("id", "owner", F.when(F.col("id") == F.col("owner"), F.col("id")).otherwise(F.concat("owner", F.lit("/"), "type", F.lit(":"), F.coalesce("name", F.lit("")))).alias("key"), F.when(F.col("type") == "Call", F.col("name")).alias("callee"))
    keys = materialise(keys, "keys")
    some = graph.edges.filter(F.col("type").isin(*DEPENDENCIES)).select("type", "src", "dst", "member", "idx")
    told = some.join(keys.select(F.col("id").alias("src"), "owner", "callee"), "src", "left").join(keys.select(F.col("id").alias("dst"), "key"), "dst", "left")
    calls = F.col("type").isin("CALLS", "INSTANTIATES", "ARGUMENT")
    return told.select(F.coalesce("owner", "src").alias("owner"), "type", F.coalesce("key", "dst").alias("target"), F.when(calls, F.coalesce("callee", "member")).otherwise(F.col("member")).alias("member"), "idx")


def touched(hunks: DataFrame, base: DataFrame, head: DataFrame, app_key: str) -> DataFrame:
    """(id, side): the most specific declarations that hunks touch; files where lines lie outside of all.

    ``hunks`` has path, old_path, side, first_line, last_line: what was added is
    sought in ``head``, what was removed in ``base`` (nodes both).
    """
    numbered = hunks.filter("side is not null").withColumn("file_id", F.concat(F.lit(f"{app_key}:"), F.when(F.col("side") == "removed", F.col("old_path")).otherwise(F.col("path"))))
    numbered = materialise(numbered.select(F.concat_ws("|", "side", "file_id", "first_line").alias("range_id"), "side", "file_id", "first_line", "last_line").distinct(), "hunks")
    out = None
    for side, nodes in (("removed", base), ("added", head)):
        own = nodes.filter(is_declaration(nodes)).select(F.col("id").alias("span_id"), "file_id", "start_line", "end_line", F.col("start_line").cast("long").alias("seq"))
        ranges = numbered.filter(F.col("side") == side).drop("side")
        met = overlapping(ranges, own).select("range_id", F.col("span_id").alias("id"))
        rest = ranges.join(met.select("range_id").distinct(), "range_id", "left_anti").select(F.col("file_id").alias("id"))
        found = met.select("id").unionByName(rest).distinct().withColumn("side", F.lit(side))
        out = found if out is None else out.unionByName(found)
    return out


def symbol_renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old_id, new_id, sure): declarations (id, type, body) that went and came with the same type and body, one to one.

    Those of one file are matched first, then the rest, each by the order of their
    ids.  Where several could be meant on either side, the match is not sure.  What has no
    body is never matched.
    """
    place = lambda df, keys, name: df.withColumn(name, F.row_number().over(_window(keys)))
    old = removed.filter("body is not null").select(F.col("id").alias("old_id"), "type", "body", F.substring_index("id", "#", 1).alias("file"))
    new = added.filter("body is not null").select(F.col("id").alias("new_id"), "type", "body", F.substring_index("id", "#", 1).alias("file"))
    many = old.groupBy("type", "body").agg(F.count("*").alias("n0")).join(new.groupBy("type", "body").agg(F.count("*").alias("n1")), ["type", "body"]).select("type", "body", ((F.col("n0") == 1) & (F.col("n1") == 1)).alias("sure"))
    same = ["type", "body", "file"]
    near = materialise(place(old, [*same, "old_id"], "k").join(place(new, [*same, "new_id"], "k"), [*same, "k"]).select("old_id", "new_id", "type", "body"), "renames")
    same = ["type", "body"]
    far = place(old.join(near.select("old_id"), "old_id", "left_anti").drop("file"), [*same, "old_id"], "k").join(place(new.join(near.select("new_id"), "new_id", "left_anti").drop("file"), [*same, "new_id"], "k"), [*same, "k"])
    return near.unionByName(far.select(*near.columns)).join(many, ["type", "body"]).select("old_id", "new_id", "sure")


def _window(keys: list[str]):
    from pyspark.sql import Window as W

    return W.partitionBy(*keys[:-1]).orderBy(keys[-1])


def change_set(base: Graph, head: Graph, base_hashes: DataFrame, head_hashes: DataFrame, file_renames: DataFrame | None = None, moved: bool = False) -> DataFrame:
    """(id, type, change, old_id, sure, gained, lost) of declarations: what happened to each from ``base`` to ``head``.

    ``*_hashes`` has id, signature, body and whole of declarations: a new body is told,
    and whole finds what was renamed.  Files that were renamed (old_file, new_file)
    keep their identities.  ``gained`` and ``lost`` are dependencies (type,
    target, member, idx, n); a declaration with nothing else new has the change
    deps.  What only moved is left out unless ``moved``.
    """
    types = lambda g: g.nodes.filter(is_declaration(g.nodes)).select("id", "type", F.col("start_line").alias("place"))
    first = was = types(base).join(base_hashes, "id", "left")
    now = types(head).join(head_hashes, "id", "left")
    old_ids = was.withColumn("old_id", F.col("id"))
    if file_renames is not None:
        was, old_ids = renamed(was, file_renames), renamed(old_ids, file_renames)
    diff = materialise(semantic_diff(first, now, file_renames).filter(F.lit(moved) | (F.col("change") != "moved")), "diff")
    gone = diff.filter("change = 'removed'").join(was.select("id", "type", F.col("whole").alias("body")), "id")
    come = diff.filter("change = 'added'").join(now.select("id", "type", F.col("whole").alias("body")), "id")
    again = materialise(symbol_renames(gone, come), "renames")
    old_bags = dependency_bags(base)
    if file_renames is not None:
        old_bags = renamed(renamed(old_bags, file_renames, "owner"), file_renames, "target")
    # What was renamed keeps its dependencies, and those of others on it.
    for column in ("owner", "target"):
        r = again.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
        old_bags = old_bags.join(r, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
    deps = bag_difference(old_bags, dependency_bags(head))
    row = F.struct("type", "target", "member", "idx", F.abs("n").alias("n"))
    deps = deps.groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, row))).alias("gained"), F.array_sort(F.collect_list(F.when(F.col("n") < 0, row))).alias("lost"))
    pairs = again.select(F.col("new_id").alias("id"), F.col("old_id"), "sure")
    left = diff.join(again.select(F.col("old_id").alias("id")), "id", "left_anti").join(pairs, "id", "left")
    left = left.withColumn("change", F.when(F.col("old_id").isNotNull(), "renamed").otherwise(F.col("change")))
    # Dependencies of what came or went altogether are no news.
    every = left.join(deps, "id", "full_outer").withColumn("change", F.coalesce("change", F.lit("deps")))
    known = types(head).select("id", "type").unionByName(types(base).select("id", "type")).groupBy("id").agg(F.min("type").alias("type"))
    files = old_ids.filter("id <> old_id").select("id", F.col("old_id").alias("file_old"))
    told = every.join(known, "id", "left").join(files, "id", "left")
    fresh = F.col("change").isin("added", "removed")
    none = F.array().cast("array<struct<type:string,target:string,member:string,idx:int,n:bigint>>")
    return told.select("id", "type", "change", F.coalesce("old_id", F.when(~fresh, F.col("file_old"))).alias("old_id"), "sure", *(F.when(fresh, none).otherwise(F.coalesce(c, none)).alias(c) for c in ("gained", "lost")))
