"""Exports in circles, and what changed between two states of a graph, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, link, versions
from ..tables import materialise
from .views import ident, table


def x3_circles(spark, sf_dir):
    """Suppliers in rings of five files that star the next one and the one after; every third has a fallback behind that, a file of its own."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("s_suppkey div 5").alias("g"), F.expr("s_suppkey % 5").alias("j"))
    file = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    none = F.lit(None).cast("string")
    steps = s.withColumn("r", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("to_j", (F.col("j") + F.col("r")) % 5)
    ring = steps.join(s.select(F.col("k").alias("to"), "g", F.col("j").alias("to_j")), ["g", "to_j"]).select(file("f", "k").alias("file_id"), file("f", "to").alias("source"), F.col("r").alias("seq"))
    leaves = s.filter("k % 3 = 0")
    stars = ring.unionByName(leaves.select(file("f", "k").alias("file_id"), file("g", "k").alias("source"), F.lit(3).alias("seq")))
    exports = stars.select("file_id", F.lit("reexport_all").alias("kind"), none.alias("name"), none.alias("local"), none.alias("node"), "source", F.col("seq").cast("long").alias("seq"))
    exports = exports.unionByName(leaves.select(file("g", "k").alias("file_id"), F.lit("local").alias("kind"), F.lit("x").alias("name"), none.alias("local"), F.col("k").cast("string").alias("node"), none.alias("source"), F.lit(0).cast("long").alias("seq")))
    ids = s.select(file("f", "k").alias("id")).unionByName(leaves.select(file("g", "k").alias("id")))
    files = ids.select("id", F.lit("app").alias("app_key"), F.col("id").alias("path"), F.col("id").alias("scope"))
    parts = link.Parts(files, None, spark.createDataFrame([], "scope string, name string, node string, seq long"), None, None, None, spark.createDataFrame([], "file_id string, local string, imported string, source string, kind string, seq long"), exports)
    modules = stars.select("file_id", "source", F.col("source").alias("target_file"), none.alias("package"))
    found = link.resolve_exports(parts, modules)
    key = F.expr("cast(substr(file_id, 3) as bigint)")
    return found.select(F.when(F.col("file_id").startswith("g:"), -key).otherwise(key).alias("holder"), "name", F.col("node").cast("long").alias("member"))


def x27_declared_owners(spark, sf_dir):
    """Parts owned by the part of half their number; every fifth, and the first, is a declaration."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    named = (F.col("k") % 5 == 0) | (F.col("k") == 1)
    nodes = part.select(ident("part", "k").alias("id"), F.when(named, "Function").otherwise("Call").alias("type"), F.col("k").cast("string").alias("name"), F.when(F.col("k") > 1, F.concat(F.lit("part:"), F.expr("k div 2").cast("string"))).alias("owner_id"), F.lit("file").alias("file_id"))
    return changes.declared_owners(nodes)


def x27_touched(spark, sf_dir):
    """Lines 2 to 4 of each conversation were removed, lines 30 to 31 added: turns that they touch, or the file."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    file = F.concat(F.lit("k:"), F.col("conv_id").cast("string"))
    nodes = t.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.lit("Function").alias("type"), F.lit("f").alias("name"), file.alias("owner_id"), file.alias("file_id"), (F.col("turn") + 1).cast("int").alias("start_line"), F.expr("cast(turn + 1 + 2 * (turn % 3) as int)").alias("end_line"))
    one = t.select(F.col("conv_id").cast("string").alias("path")).distinct()
    hunk = lambda side, a, b: one.select("path", F.col("path").alias("old_path"), F.lit(side).alias("side"), F.lit(a).alias("first_line"), F.lit(b).alias("last_line"))
    return changes.touched(hunk("removed", 2, 4).unionByName(hunk("added", 30, 31)), nodes, nodes.filter("start_line < 30"), "k")


def x27_symbol_renames(spark, sf_dir):
    """Customers with an even number went, those with an odd one came; their bodies are few."""
    c = table(spark, sf_dir, "customer")
    body = F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 7).cast("string"))
    one = lambda odd, nation: c.filter(F.col("c_custkey") % 2 == odd).select(F.concat(F.lit("k:f"), nation.cast("string"), F.lit("#c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Function").alias("type"), F.when(F.col("c_acctbal") > 0, body).alias("body"))
    return changes.symbol_renames(one(0, F.col("c_nationkey")), one(1, (F.col("c_nationkey") + F.col("c_custkey") % 3) % 25))


def _years(spark, sf_dir):
    """Each year's customers with orders, and the least priority of these, as revisions."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("at"), F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("hash"))


def x28_fold(spark, sf_dir):
    """Revisions, a handful, folded one by one."""
    years = materialise(_years(spark, sf_dir), "years")
    held = None
    for (at,) in years.select("at").distinct().orderBy("at").collect():
        held = materialise(versions.fold(held, years.filter(F.col("at") == at).drop("at"), ["id"], at), "versions")
    return held


def x28_fold_all(spark, sf_dir):
    """The same in one go."""
    return versions.fold_all(_years(spark, sf_dir), ["id"])


def x28_lineages(spark, sf_dir):
    """Parts renamed to the part of twice their number, the year being how far they are from the first."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).filter("k > 0 and k % 2 = 0")
    return versions.lineages(part.select(F.length(F.bin("k")).alias("at"), F.concat(F.lit("part:"), F.expr("k div 2").cast("string")).alias("old_id"), ident("part", "k").alias("new_id")))


QUERIES = (x3_circles, x27_declared_owners, x27_touched, x27_symbol_renames, x28_fold, x28_fold_all, x28_lineages)

_FOLD = """
WITH y AS (SELECT year(o_orderdate) AS y, o_custkey AS id, min(o_orderpriority) AS hash FROM orders GROUP BY ALL),
g AS (SELECT *, lag(y) OVER w IS DISTINCT FROM y - 1 OR lag(hash) OVER w IS DISTINCT FROM hash AS begins FROM y WINDOW w AS (PARTITION BY id ORDER BY y)),
i AS (SELECT *, sum(begins::INT) OVER (PARTITION BY id ORDER BY y) AS island FROM g)
SELECT id, hash, min(y)::BIGINT AS valid_from, CASE WHEN max(y) < (SELECT max(y) FROM y) THEN max(y)::BIGINT + 1 END AS valid_to FROM i GROUP BY id, hash, island"""
_BODY = "CASE WHEN c_acctbal > 0 THEN c_mktsegment || '-' || (c_custkey % 7) END"

SQL = {
    "x3_circles": """
WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS g, s_suppkey % 5 AS j FROM supplier),
e AS (SELECT a.k AS src, b.k AS dst, r FROM s a CROSS JOIN (VALUES (1), (2)) AS t(r) JOIN s b ON b.g = a.g AND b.j = (a.j + r) % 5),
walk AS (
  SELECT k AS start, k AS spot, [k] AS seen, []::INT[] AS way FROM s
  UNION ALL
  SELECT start, dst, list_append(seen, dst), list_append(way, r) FROM walk JOIN e ON src = spot WHERE NOT list_contains(seen, dst)),
ends AS (SELECT start, spot AS leaf, list_append(way, 3) AS way FROM walk WHERE spot % 3 = 0)
SELECT start AS holder, 'x' AS name, arg_min(leaf, way) AS member FROM ends GROUP BY start
UNION ALL SELECT -k, 'x', k FROM s WHERE k % 3 = 0""",
    "x27_declared_owners": """
WITH RECURSIVE up AS (
  SELECT p_partkey AS k, p_partkey AS spot FROM part
  UNION ALL SELECT k, spot // 2 FROM up WHERE spot % 5 <> 0 AND spot > 1)
SELECT 'part:' || k AS id, 'part:' || spot AS owner FROM up WHERE spot % 5 = 0 OR spot = 1""",
    "x27_touched": """
WITH s AS (SELECT DISTINCT conv_id, turn, turn + 1 AS a, turn + 1 + 2 * (turn % 3) AS b FROM conversations),
r AS (SELECT DISTINCT conv_id, 'removed' AS side, 2 AS x, 4 AS y FROM conversations UNION ALL SELECT DISTINCT conv_id, 'added', 30, 31 FROM conversations),
m AS (SELECT r.*, turn, a, b, greatest(a, x) AS p, least(b, y) AS q FROM r JOIN s ON s.conv_id = r.conv_id AND a <= y AND b >= x AND (side = 'removed' OR a < 30))
SELECT conv_id || '/' || turn AS id, side FROM m
WHERE NOT EXISTS (SELECT 1 FROM m i WHERE i.conv_id = m.conv_id AND i.side = m.side AND i.turn <> m.turn AND i.p <= m.p AND i.q >= m.q AND (i.b - i.a < m.b - m.a OR (i.b - i.a = m.b - m.a AND i.a < m.a)))
UNION ALL SELECT 'k:' || conv_id, side FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = r.conv_id AND m.side = r.side)""",
    "x28_fold": _FOLD,
    "x28_fold_all": _FOLD,
    "x28_lineages": """
WITH RECURSIVE up AS (
  SELECT p_partkey AS k, p_partkey // 2 AS spot, 1 AS steps FROM part WHERE p_partkey > 0 AND p_partkey % 2 = 0
  UNION ALL SELECT k, spot // 2, steps + 1 FROM up WHERE spot % 2 = 0)
SELECT 'part:' || k AS id, 'part:' || spot AS origin, steps FROM up WHERE spot % 2 = 1""",
    "x27_symbol_renames": f"""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, {_BODY} AS body FROM customer WHERE c_acctbal > 0),
o AS (SELECT 'k:f' || n || '#c' || k AS old_id, body, n AS f FROM c WHERE k % 2 = 0),
w AS (SELECT 'k:f' || ((n + k % 3) % 25) || '#c' || k AS new_id, body, (n + k % 3) % 25 AS f FROM c WHERE k % 2 = 1),
near AS (
  SELECT old_id, new_id, body FROM (SELECT *, row_number() OVER (PARTITION BY body, f ORDER BY old_id) AS i FROM o)
  JOIN (SELECT *, row_number() OVER (PARTITION BY body, f ORDER BY new_id) AS i FROM w) USING (body, f, i)),
far AS (
  SELECT old_id, new_id, body FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY old_id) AS i FROM o WHERE old_id NOT IN (SELECT old_id FROM near))
  JOIN (SELECT *, row_number() OVER (PARTITION BY body ORDER BY new_id) AS i FROM w WHERE new_id NOT IN (SELECT new_id FROM near)) USING (body, i)),
many AS (SELECT body, (SELECT count(*) FROM o WHERE o.body = b.body) = 1 AND (SELECT count(*) FROM w WHERE w.body = b.body) = 1 AS sure FROM (SELECT DISTINCT body FROM c) b)
SELECT old_id, new_id, sure FROM (SELECT * FROM near UNION ALL SELECT * FROM far) JOIN many USING (body)""",
}
