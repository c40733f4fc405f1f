"""Edges that follow from others: who invokes whom, where values flow, what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.confidence import weaker
from .dedup import first_wins, last_wins


def _of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("type") == kind)


def flows_assign(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """FLOWS_TO from each value that an assignment reads to each that it writes; ``reads`` and ``writes``: assign, node, seq (writes: member).

    Of several equal (src, dst) the smallest seq of the write wins.
    """
    # Of an assignment each value once on either side, before they meet.
    reads = reads.select("assign", "node").distinct()
    writes = first_wins(writes.select("assign", "node", "member", "seq"), ["assign", "node"], ["seq"])
    met = reads.select("assign", F.col("node").alias("src")).join(writes.select("assign", F.col("node").alias("dst"), "member", "seq"), "assign").filter("src <> dst")
    return met.groupBy("src", "dst").agg(F.min_by("member", "seq").alias("member"))


def flows_args(arguments: DataFrame, calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """FLOWS_TO from the i-th argument of a call to the i-th parameter of what it calls.

    ``arguments``: call, idx, node, seq (the last of a call and index wins);
    ``calls``: call, target, seq (the last wins); ``parameters``: owner, idx, node, seq (the last wins).
    """
    a = last_wins(arguments.filter("idx is not null and node is not null"), ["call", "idx"], ["seq"])
    c = last_wins(calls, ["call"], ["seq"])
    p = last_wins(parameters, ["owner", "idx"], ["seq"])
    met = a.select("call", "idx", F.col("node").alias("src")).join(c.select("call", F.col("target").alias("owner")), "call").join(p.select("owner", "idx", F.col("node").alias("dst")), ["owner", "idx"])
    return met.filter("src <> dst").select("src", "dst").distinct()


def flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All FLOWS_TO edges of a graph: through assignments, returns, throws and arguments."""
    types = nodes.select("id", F.col("type").alias("node_type"))
    reads = _of(edges, "READS").join(types, F.col("src") == types.id).select("src", "dst", "node_type", "seq")
    at = lambda t: reads.filter(F.col("node_type") == t)
    writes = _of(edges, "WRITES").select(F.col("src").alias("assign"), F.col("dst").alias("node"), "member", "seq")
    through = flows_assign(at("Assignment").select(F.col("src").alias("assign"), F.col("dst").alias("node"), "seq"), writes)
    out = at("Return").unionByName(at("Throw")).filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    owners = nodes.select(F.col("id").alias("src"), F.col("owner_id").alias("dst"))
    functions = types.filter("node_type = 'Function'").select(F.col("id").alias("dst"))
    back = at("Return").select("src").distinct().join(owners, "src").join(functions, "dst", "left_semi")
    arguments = _of(edges, "ARGUMENT").select(F.col("src").alias("call"), "idx", F.col("dst").alias("node"), "seq")
    calls = _of(edges, "CALLS").select(F.col("src").alias("call"), F.col("dst").alias("target"), "seq")
    parameters = _of(edges, "HAS_PARAMETER").select(F.col("src").alias("owner"), "idx", F.col("dst").alias("node"), "seq")
    none = F.lit(None).cast("string").alias("member")
    rest = out.unionByName(back.select("src", "dst")).unionByName(flows_args(arguments, calls, parameters)).select("src", "dst", none)
    return through.unionByName(rest).groupBy("src", "dst").agg(F.min("member").alias("member")).select(F.lit("FLOWS_TO").alias("type"), "src", "dst", "member")


def invokes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """INVOKES from the function that owns a call to the function called, or handed over as an argument.

    A handed-over function is inferred at best.  Of equal edges the first wins,
    calls before arguments.
    """
    functions = nodes.filter("type = 'Function'").select(F.col("id").alias("fid"))
    owners = nodes.select(F.col("id").alias("call"), F.col("owner_id").alias("owner")).join(functions, F.col("owner") == F.col("fid"), "left_semi")
    some = edges.filter("type in ('CALLS', 'ARGUMENT')").join(functions, F.col("dst") == F.col("fid"), "left_semi")
    met = some.withColumnRenamed("src", "call").join(owners, "call")
    sure = F.when(F.col("type") == "ARGUMENT", weaker(F.col("resolution"), F.lit("inferred"))).otherwise(F.col("resolution"))
    told = met.select(F.lit("INVOKES").alias("type"), F.col("owner").alias("src"), "dst", sure.alias("resolution"), (F.col("type") == "ARGUMENT").alias("late"), "seq")
    return first_wins(told, ["type", "src", "dst"], ["late", "seq"]).select("type", "src", "dst", "resolution")


def next_statements(statements: DataFrame) -> DataFrame:
    """NEXT between neighbours of ``statements`` (block, position, node)."""
    after = F.lead("node").over(W.partitionBy("block").orderBy("position", "node"))
    return statements.select(F.col("node").alias("src"), after.alias("dst")).filter("dst is not null")
