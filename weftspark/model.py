"""The property graph: node and edge types, their columns, and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The closed set of node types.
NODE_TYPES = (
    "Repository", "Application", "Module", "File", "Package", "External",
    "Function", "Parameter", "Variable", "Class", "Interface", "Field", "Enum", "EnumMember",
    "Call", "Assignment", "Return", "Throw", "If", "Loop", "Switch", "Case", "Try", "Catch", "Jump",
    "Endpoint", "HttpParam", "Commit", "Person", "Team", "Topic", "LinkReview",
)

#: The closed set of edge types.
EDGE_TYPES = (
    "CONTAINS", "DECLARES", "HAS_PARAMETER", "HAS_FIELD", "HAS_METHOD", "HAS_MEMBER", "EXPORTS",
    "READS", "WRITES", "ARGUMENT", "IMPORTS", "CALLS", "INSTANTIATES", "HAS_TYPE", "HAS_TYPE_ARG", "RETURNS_TYPE",
    "EXTENDS", "IMPLEMENTS", "INVOKES", "FLOWS_TO", "NEXT", "THROWS", "EXPOSES", "HANDLED_BY", "HAS_PARAM", "BINDS",
    "DECORATES", "REQUESTS", "PRODUCES", "CONSUMES", "AUTHORED_BY", "COMMITTED_BY", "CHANGED", "OWNS", "CREATED",
    "LAST_MODIFIED", "MEMBER_OF",
)

LOCATION = "struct<file_id:string,start_line:int,start_col:int,end_line:int,end_col:int>"
EDGE_SCHEMA = f"type string, src string, dst string, idx int, loc {LOCATION}, member string, operator string, resolution string, kind string, share double, seq long"
EDGE_PROPERTIES = ("idx", "member", "operator", "resolution", "kind", "share")


@dataclass(frozen=True)
class Graph:
    """Two bags of rows; ``seq`` tells the order where order decides (first or last wins)."""

    nodes: DataFrame
    edges: DataFrame

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        return Graph(
            self.nodes if nodes is None else self.nodes.unionByName(nodes, allowMissingColumns=True),
            self.edges if edges is None else self.edges.unionByName(edges, allowMissingColumns=True),
        )

    def unknown_types(self) -> DataFrame:
        """Types outside the closed sets; empty when the graph may be stored."""
        nodes = self.nodes.select("type").filter(~F.col("type").isin(*NODE_TYPES))
        edges = self.edges.select("type").filter(~F.col("type").isin(*EDGE_TYPES))
        return nodes.unionByName(edges).distinct()


def flatten(df: DataFrame, column: str = "loc") -> DataFrame:
    """Fields of a struct column in its place."""
    return df.select(*(c for c in df.columns if c != column), f"{column}.*")


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Number of distinct (src, dst, type) by type."""
    return edges.groupBy("type").agg(F.countDistinct("src", "dst").alias("n"))


def stored_properties(edges: DataFrame) -> DataFrame:
    """Empty strings and shares that aren't positive are not stored."""
    text = [c for c in ("member", "operator", "resolution", "kind") if c in edges.columns]
    out = edges.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})
    return out.withColumn("share", F.when(F.col("share") > 0, F.col("share"))) if "share" in edges.columns else out


def node_json(nodes: DataFrame) -> DataFrame:
    """One JSON document a node, its location's fields at the root, absent ones left out."""
    flat = flatten(nodes) if "loc" in nodes.columns else nodes
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("value"))


def graph_document(graph: Graph) -> DataFrame:
    """Lines (value, in order) of one JSON document: ``nodes``, flat, and ``edges``; without any, empty arrays.

    Rows are sorted by range, so that part files written from this, one after the
    other, are the document: nothing is gathered in one place.
    """
    told = node_json(graph.nodes).select(F.lit(1).alias("section"), "value")
    told = told.unionByName(graph.edges.select(F.lit(3).alias("section"), F.to_json(F.struct(*graph.edges.columns)).alias("value")))
    counted = told.groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("section").agg(F.min("value").alias("first"))
    copies = counted.join(F.broadcast(first), "section").select("section", "value", "first", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    lines = copies.select("section", F.col("value").alias("key"), "copy", F.when((F.col("value") == F.col("first")) & (F.col("copy") == 1), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    frame = graph.nodes.sparkSession.createDataFrame([(0, "", 0, '{"nodes": ['), (2, "", 0, '], "edges": ['), (4, "", 0, "]}")], "section int, key string, copy long, value string")
    return lines.unionByName(frame).orderBy("section", "key", "copy").select("value")
