"""What a request sets off: ways from an endpoint through functions, other applications' endpoints and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import counted, discard, materialise

#: Edges that a request goes along, and the one that it goes against (a topic hands on to those that consume it).
ALONG = ("HANDLED_BY", "INVOKES", "REQUESTS", "PRODUCES")
AGAINST = "CONSUMES"
STEP = "struct<node:string,type:string>"


def request_steps(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, type) of ``edges`` (type, src, dst), requests told by the function of ``owners`` (call, owner) whose call makes them.

    A source that no call of ``owners`` has is itself what requests.
    """
    own = owners.select(F.col("call").alias("src"), "owner").distinct()
    along = edges.filter(F.col("type").isin(*ALONG)).select("src", "dst", "type")
    lifted = along.filter("type = 'REQUESTS'").join(own, "src", "left").select(F.coalesce("owner", "src").alias("src"), "dst", "type")
    against = edges.filter(F.col("type") == AGAINST).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return along.filter("type <> 'REQUESTS'").unionByName(lifted).unionByName(against).distinct()


def request_chains(steps: DataFrame, endpoints: DataFrame, depth: int = 6, most: int = 5) -> DataFrame:
    """(endpoint, place, chain, ended) of ``endpoints`` (endpoint): the first ``most`` ways over ``steps`` (src, dst, type) in order of their nodes.

    ``chain``: node and type of each step, the first one a HANDLED_BY, then up to
    ``depth`` more; no way meets a node twice.  ``ended``: nothing new lies behind;
    else the way was cut at that length.  Endpoints without a handler have no row;
    several types between two nodes count as the first of them by name.

    No way goes on to fewer than one whole way, so the first ``most`` beginnings of
    a length hold the beginnings of the first ``most`` ways, and each round keeps
    no more.  A way excludes at most its own nodes, so of a node's steps the first
    ``most`` + ``depth`` + 2 are enough: a node is one row of bounded size, however
    many steps it has, and an endpoint never has more than ``most`` rows.
    """
    enough = most + depth + 2
    one = steps.filter("src <> dst").groupBy("src", "dst").agg(F.min("type").alias("type"))
    first = one.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("k") <= enough)
    step = F.struct(F.col("dst").alias("node"), "type")
    onward = materialise(first.groupBy("src").agg(F.array_sort(F.collect_list(step)).alias("onward")), "onward")
    order = W.partitionBy("endpoint").orderBy(F.transform("chain", lambda x: x["node"]))
    handled = steps.filter("type = 'HANDLED_BY' and src <> dst").select(F.col("src").alias("endpoint"), "dst").distinct()
    begun = handled.join(endpoints.select("endpoint").distinct(), "endpoint").select("endpoint", F.array(F.struct(F.col("dst").alias("node"), F.lit("HANDLED_BY").alias("type"))).cast(f"array<{STEP}>").alias("chain"), F.lit(False).alias("ended"))
    place = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    ways = materialise(place(begun), "chains")
    for _ in range(depth):
        seen = lambda x: F.exists("chain", lambda y: y["node"] == x["node"]) | (x["node"] == F.col("endpoint"))
        open_ = ways.filter("not ended").withColumn("at", F.element_at("chain", -1)["node"])
        met = open_.join(onward, F.col("at") == F.col("src"), "left")
        fresh = F.filter(F.coalesce("onward", F.array().cast(f"array<{STEP}>")), lambda x: ~seen(x))
        grown = met.select("endpoint", "chain", F.explode_outer(fresh).alias("step"))
        grown = grown.select("endpoint", F.when(F.col("step").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("step"))).alias("chain"), F.col("step").isNull().alias("ended"))
        old = ways
        ways, n = counted(place(ways.filter("ended").unionByName(grown)), "chains", "not ended")
        discard(old)
        if not n:
            break
    at = ways.withColumn("at", F.element_at("chain", -1)["node"]).join(onward, F.col("at") == F.col("src"), "left")
    visited = F.array_append(F.transform("chain", lambda x: x["node"]), F.col("endpoint"))
    none_left = F.col("onward").isNull() | F.forall("onward", lambda x: F.array_contains(visited, x["node"]))
    return at.select("endpoint", F.row_number().over(order).alias("place"), "chain", (F.col("ended") | none_left).alias("ended"))


def chain_text(chain: F.Column) -> F.Column:
    """A chain in words: types and nodes in turn."""
    return F.array_join(F.transform(chain, lambda x: F.concat_ws(" ", x["type"], x["node"])), " ")
