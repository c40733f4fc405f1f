"""Parsing, exports, heritage and questions about changes over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..operators import audit, history, link, spans
from .views import ident, table


def _parents(spark, sf_dir):
    """Each part has two parents, in order: half its number and a third of it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    halves = part.filter("id > 1").select("id", F.expr("id div 2").alias("parent"), F.lit(0).alias("seq"))
    thirds = part.filter("id div 3 >= 1 and id div 3 <> id div 2").select("id", F.expr("id div 3").alias("parent"), F.lit(1).alias("seq"))
    return part, halves.unionByName(thirds)


def x15_inherited(spark, sf_dir):
    """Every member of every class: its own, or what its parents give, depth first."""
    part, parents = _parents(spark, sf_dir)
    return link.inherited_members(part.select(F.col("id").alias("holder"), "name", F.col("id").alias("node")), parents).select("holder", "name", "member")


def x3_exports(spark, sf_dir):
    """Each part is a file that exports its brand, and all that two other files export."""
    part, parents = _parents(spark, sf_dir)
    file = lambda c: F.concat(F.lit("f:"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    files = part.select(file("id").alias("id"), F.lit("app").alias("app_key"), file("id").alias("path"), file("id").alias("scope"))
    own = part.select(file("id").alias("file_id"), F.lit("local").alias("kind"), "name", none.alias("local"), F.col("id").cast("string").alias("node"), none.alias("source"), F.lit(0).cast("long").alias("seq"))
    stars = parents.select(file("id").alias("file_id"), F.lit("reexport_all").alias("kind"), none.alias("name"), none.alias("local"), none.alias("node"), file("parent").alias("source"), F.col("seq").cast("long").alias("seq"))
    names = spark.createDataFrame([], "scope string, name string, node string, seq long")
    imports = spark.createDataFrame([], "file_id string, local string, imported string, source string, kind string, seq long")
    parts = link.Parts(files, None, names, None, None, None, imports, own.unionByName(stars))
    modules = stars.select("file_id", "source", F.col("source").alias("target_file"), none.alias("package"))
    found = link.resolve_exports(parts, modules)
    return found.select(F.expr("cast(substr(file_id, 3) as bigint)").alias("holder"), "name", F.col("node").cast("long").alias("member"))


def x25_parse(spark, sf_dir):
    """Each conversation as a source file of functions that call the one before: invocations and flows of arguments."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    one = lambda x, i: F.when(i == 0, F.concat(F.lit("function t"), x.cast("string"), F.lit("(a) {\n  return a;\n}\n"))).otherwise(F.concat(F.lit("function t"), x.cast("string"), F.lit("(a) {\n  // calls t0('x')\n  const v = t"), F.get("turns", i - 1).cast("string"), F.lit("(a);\n  return v;\n}\n")))
    text = F.array_join(F.transform("turns", one), "")
    files = t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.lit("").alias("hash"), text.cast("binary").alias("content"))
    graph = api.extract(spark, files, "app")
    return graph.edges.filter("type in ('INVOKES', 'FLOWS_TO') and not contains(src, '@') and not contains(dst, '@')").select("type", "src", "dst")


def x24_overlap(spark, sf_dir):
    """The most specific turns that lines 2 to 4 of each conversation touch."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    ranges = t.select("conv_id").distinct().select(F.col("conv_id").alias("range_id"), F.col("conv_id").cast("string").alias("file_id"), F.lit(2).alias("first_line"), F.lit(4).alias("last_line"))
    own = t.select(F.concat_ws("/", "conv_id", "turn").alias("span_id"), F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).alias("start_line"), F.expr("turn + 1 + 2 * (turn % 3)").alias("end_line"), F.col("turn").alias("seq"))
    return spans.overlapping(ranges, own).select("range_id", "span_id")


def x24_call_sites(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.lit("CALLS").alias("type"), ident("order", "l_orderkey").alias("src"), ident("part", "l_partkey").alias("dst"))
    some = table(spark, sf_dir, "part").filter("p_size < 10").select(ident("part", "p_partkey").alias("id"))
    return audit.call_sites(calls, some)


def x24_who_knows(spark, sf_dir):
    owns = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("share")).select(ident("part", "l_partkey").alias("dst"), ident("person", "l_suppkey").alias("src"), "share")
    return audit.who_knows(owns, table(spark, sf_dir, "part").select(ident("part", "p_partkey").alias("id"))).select("dst", "src", "place")


def x24_orphan_endpoints(spark, sf_dir):
    ends = table(spark, sf_dir, "customer").select(ident("app", "c_custkey").alias("app_id"), F.col("c_mktsegment").alias("path"))
    requests = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(ident("app", "o_custkey").alias("dst"))
    return audit.orphan_endpoints(ends, requests).select("app_id", "path")


def x24_suspects(spark, sf_dir):
    """Changes near a failing customer: orders one step away, parts two steps, the nearest and newest first."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    near = orders.select(ident("customer", "o_custkey").alias("start"), ident("order", "o_orderkey").alias("node"), F.lit(1).alias("distance"))
    far = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(ident("customer", "o_custkey").alias("start"), ident("part", "l_partkey").alias("node"), F.lit(2).alias("distance")).distinct()
    changes = orders.select(ident("order", "o_orderkey").alias("node"), F.col("o_orderdate").alias("changed")).unionByName(line.groupBy("l_partkey").agg(F.max("l_shipdate").alias("changed")).select(ident("part", "l_partkey").alias("node"), "changed"))
    return history.suspects(near.unionByName(far), changes, 3).select("start", "node", "distance", "place")


QUERIES = (x15_inherited, x3_exports, x25_parse, x24_overlap, x24_call_sites, x24_who_knows, x24_orphan_endpoints, x24_suspects)

_WAYS = """
WITH RECURSIVE up AS (
  SELECT p_partkey AS holder, p_partkey AS ancestor, []::INT[] AS way FROM part
  UNION ALL
  SELECT holder, CASE WHEN s = 0 THEN ancestor // 2 ELSE ancestor // 3 END, list_append(way, s)
  FROM up, (VALUES (0), (1)) AS steps(s) WHERE (s = 0 AND ancestor > 1) OR (s = 1 AND ancestor // 3 >= 1 AND ancestor // 3 <> ancestor // 2))
SELECT holder, p_brand AS name, arg_min(p_partkey, way) AS member FROM up JOIN part ON p_partkey = ancestor GROUP BY holder, p_brand"""

SQL = {
    "x15_inherited": _WAYS,
    "x3_exports": _WAYS,
    "x25_parse": """
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
p AS (SELECT 'app:c' || conv_id || '.js#t' AS f, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
SELECT 'INVOKES' AS type, f || turn AS src, f || prev AS dst FROM p WHERE prev IS NOT NULL
UNION ALL SELECT 'FLOWS_TO', f || turn || '(a)', f || prev || '(a)' FROM p WHERE prev IS NOT NULL""",
    "x24_overlap": """
WITH s AS (SELECT conv_id, turn, turn + 1 AS a, turn + 1 + 2 * (turn % 3) AS b FROM conversations),
m AS (SELECT DISTINCT *, greatest(a, 2) AS x, least(b, 4) AS y FROM s WHERE a <= 4 AND b >= 2)
SELECT conv_id AS range_id, conv_id || '/' || turn AS span_id FROM m
WHERE NOT EXISTS (SELECT 1 FROM m i WHERE i.conv_id = m.conv_id AND i.turn <> m.turn AND i.x <= m.x AND i.y >= m.y AND (i.b - i.a < m.b - m.a OR (i.b - i.a = m.b - m.a AND i.turn < m.turn)))""",
    "x24_call_sites": "SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "x24_who_knows": """
WITH o AS (SELECT 'part:' || l_partkey AS dst, 'person:' || l_suppkey AS src, sum(l_quantity) AS share FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey, l_suppkey)
SELECT dst, src, place FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY share DESC, src) AS place FROM o) WHERE place <= 3""",
    "x24_orphan_endpoints": "SELECT 'app:' || c_custkey AS app_id, c_mktsegment AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "x24_suspects": """
WITH n AS (
  SELECT 'customer:' || o_custkey AS start, 'order:' || o_orderkey AS node, 1 AS distance, o_orderdate AS changed FROM orders
  UNION ALL
  SELECT DISTINCT 'customer:' || o_custkey, 'part:' || l_partkey, 2, c FROM orders JOIN lineitem USING (o_orderkey) JOIN (SELECT l_partkey, max(l_shipdate) AS c FROM lineitem GROUP BY l_partkey) USING (l_partkey))
SELECT start, node, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, changed DESC, node) AS place FROM n) WHERE place <= 3""".replace("JOIN lineitem USING (o_orderkey)", "JOIN lineitem ON o_orderkey = l_orderkey"),
}
