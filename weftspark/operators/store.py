"""Changes of the stored graph, as functions from old and new rows to merged ones.

Nothing is changed in place: results are the next version of the whole store
(:mod:`.manifest`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, stored_properties
from ..tables import materialise
from . import manifest
from .dedup import merge_properties

LINK_TYPES = ("REQUESTS", "PRODUCES", "CONSUMES")
#: The part of the nodes that belong to no one application.
SHARED = "*"


def without_app(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The graph less an application's nodes (ids under ``key:``, and its own) and all edges at them."""
    mine = lambda c: F.startswith(F.col(c), F.lit(f"{key}:")) | (F.col(c) == f"app:{key}")
    return nodes.filter(~mine("id")), edges.filter(~mine("src") & ~mine("dst"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by (type, id); new values win where they are not null.  Columns of either side stay."""
    mine, theirs = ([c for c in df.columns if c not in ("type", "id")] for df in (new, old))
    side = lambda df, cols, name: df.select("type", "id", (F.struct(*cols) if cols else F.struct(F.lit(None).alias("none"))).alias(name))
    both = side(old, theirs, "o").join(side(new, mine, "n"), ["type", "id"], "full_outer")
    value = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, cols in (("n", mine), ("o", theirs)) if c in cols))
    return both.select("type", "id", *(value(c).alias(c) for c in [*mine, *(c for c in theirs if c not in mine)]))


def upsert_edges(edges: DataFrame, nodes: DataFrame, properties: list[str]) -> DataFrame:
    """One edge per (src, type, dst) with the last non-null value of each property; edges without both ends are dropped."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")
    return merge_properties(kept, ["src", "type", "dst"], properties)


def replace_links(edges: DataFrame, reviews: DataFrame, new_edges: DataFrame, new_reviews: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and pending reviews of ``apps`` (key) give way to new ones; decided reviews keep their status."""
    ids = apps.select(F.concat(F.lit("app:"), "key").alias("__app")).distinct()
    kept = edges.filter(~F.col("type").isin(*LINK_TYPES)).unionByName(edges.filter(F.col("type").isin(*LINK_TYPES)).join(ids, F.col("src") == F.col("__app"), "left_anti")).unionByName(new_edges)
    open_ = reviews.filter("status = 'pending'").join(ids, F.col("call_id") == F.col("__app"), "left_semi")
    return kept, upsert_reviews(reviews.join(open_.select("id"), "id", "left_anti").select(*reviews.columns), new_reviews)


def upsert_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews by id; what is new replaces all but the status."""
    rest = [c for c in new.columns if c != "id"]
    both = old.select("id", F.struct(*rest).alias("o")).join(new.select("id", F.struct(*rest).alias("n")), "id", "full_outer")
    return both.select("id", *(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c == "status" else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))


def review_apps(reviews: DataFrame, apps: DataFrame) -> DataFrame:
    """``reviews`` (id, ..) with the ``app_key`` of the first of ``apps`` (key, seq) whose key and a colon begin the id, and something follows; null if none.

    The keys that an id may begin with are its parts before a colon: an equal join.
    """
    parts = F.split("id", ":", -1)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    asked = reviews.select("id").distinct().filter(F.size(parts) > 1).select("id", F.explode(begins).alias("key"))
    met = asked.filter(F.length("id") > F.length("key") + 1).join(apps.select("key", "seq"), "key")
    first = met.groupBy("id").agg(F.min_by("key", F.struct("seq", "key")).alias("app_key"))
    return reviews.join(first, "id", "left")


def set_status(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """``reviews`` with the status of ``decisions`` (id, status)."""
    d = decisions.select("id", F.col("status").alias("__s"))
    return reviews.join(d, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def retarget(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """REQUESTS of ``moves`` (src, dst, new_dst) go to the new target as ``overridden``, without kind and member."""
    m = moves.select("src", "dst", F.col("new_dst").alias("__to")).withColumn("type", F.lit("REQUESTS"))
    joined = edges.join(m, ["type", "src", "dst"], "left")
    moved = F.col("__to").isNotNull()
    lost = {c: F.when(~moved, F.col(c)) for c in ("kind", "member") if c in edges.columns}
    out = joined.withColumns(lost | {"resolution": F.when(moved, "overridden").otherwise(F.col("resolution")), "dst": F.coalesce("__to", "dst")})
    return out.select(*edges.columns)


def delete_requests(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.select("src", "dst").withColumn("type", F.lit("REQUESTS"))
    return edges.join(gone, ["type", "src", "dst"], "left_anti")


def pending(reviews: DataFrame, id_: str) -> DataFrame:
    """The review of that id; an error if there is none or it is decided already."""
    found = reviews.filter(F.col("id") == id_)
    row = found.select("status").first()
    if row is None or row["status"] != "pending":
        raise ValueError(f"review {id_} is {'unknown' if row is None else row['status']}")
    return found


def _merged(df: DataFrame, keys: list[str], first: list) -> DataFrame:
    """One row of each key, each column the last that is not null in order of ``first``; ties go by the whole row, so that a retry gives the same."""
    rest = [c for c in df.columns if c not in keys]
    ordered = df.withColumn("__order", F.struct(*first, F.xxhash64(*df.columns)))
    return merge_properties(ordered, keys, rest, "__order")


def app_parts(key: str, graph: Graph, shared: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a store holds of an application: its own nodes, the nodes that it shares with others (packages, topics, people), its edges.

    Shared nodes are merged with those that are ``shared`` already, by (type, id);
    an edge is one by (src, type, dst) with the last non-null value of each
    property, and dropped where an end is no node.
    """
    own = F.startswith("id", F.lit(f"{key}:")) | (F.col("id") == f"app:{key}")
    nodes = graph.nodes.withColumn("__new", F.lit(1))
    mine = materialise(_merged(nodes.filter(own).drop("__new"), ["type", "id"], []), "own-nodes")
    common = nodes.filter(~own)
    if shared is not None:
        common = shared.withColumn("__new", F.lit(0)).unionByName(common, allowMissingColumns=True)
    common = materialise(_merged(common, ["type", "id"], [F.col("__new")]).drop("__new"), "shared-nodes")
    edges = _merged(stored_properties(graph.edges), ["src", "type", "dst"], [F.coalesce("seq", F.lit(-1))])
    ids = mine.select("id").unionByName(common.select("id")).distinct()
    whole = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return mine, common, whole.select(*graph.edges.columns)


def save_app(spark: SparkSession, path: str, key: str, graph: Graph) -> manifest.Version:
    """Put an application's graph in place of what the store at ``path`` had of it; nodes and edges change together."""

    def change(base: manifest.Version) -> manifest.Changes:
        mine, common, edges = app_parts(key, graph, manifest.read(spark, path, "nodes", base, SHARED))
        return {"nodes": {key: mine, SHARED: common}, "edges": {key: edges}}

    return manifest.update(spark, path, change)


def read_graph(spark: SparkSession, path: str, app_key: str | None = None, version: manifest.Version | None = None) -> Graph:
    """The whole graph, or the nodes and edges of one application without the shared nodes."""
    version = version or manifest.latest(spark, path)
    nodes, edges = (manifest.read(spark, path, t, version, app_key) for t in ("nodes", "edges"))
    if nodes is None or edges is None:
        raise ValueError(f"nothing of {app_key or 'any application'} in {path}")
    return Graph(nodes, edges)
