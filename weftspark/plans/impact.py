"""What changes reach, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, impact
from ..parse.tokens import tokens
from .views import ident, table

_SURE = "case {0} when 'A' then 'exact' when 'R' then 'inferred' else 'name_only' end"
_STATUS = "case o_orderstatus when 'F' then 'exact' when 'O' then 'inferred' else 'name_only' end"


def _uses(spark, sf_dir):
    """Customers invoke their orders, orders read from suppliers."""
    invokes = table(spark, sf_dir, "orders").select(F.lit("INVOKES").alias("type"), ident("customer", "o_custkey").alias("src"), ident("order", "o_orderkey").alias("dst"), F.expr(_STATUS).alias("resolution"))
    return invokes.unionByName(table(spark, sf_dir, "lineitem").select(F.lit("READS").alias("type"), ident("order", "l_orderkey").alias("src"), ident("supplier", "l_suppkey").alias("dst"), F.expr(_SURE.format("l_returnflag")).alias("resolution")))


def x26_sure_impact(spark, sf_dir):
    """Who is hit when a supplier changes, and how surely."""
    starts = table(spark, sf_dir, "supplier").select(ident("supplier", "s_suppkey").alias("start"))
    return impact.sure_reach(impact.backwards(_uses(spark, sf_dir)), starts)


def x26_consumers(spark, sf_dir):
    """Suppliers are functions behind endpoints (their parts), lines request those, orders send them, customers invoke orders."""
    line, uses = table(spark, sf_dir, "lineitem"), _uses(spark, sf_dir)
    call = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("call")
    handled = line.select(ident("part", "l_partkey").alias("endpoint"), ident("supplier", "l_suppkey").alias("id")).distinct()
    requests = line.select(call, ident("part", "l_partkey").alias("endpoint"), F.expr(_SURE.format("l_returnflag")).alias("resolution"))
    callers = line.select(call, ident("order", "l_orderkey").alias("owner")).distinct()
    changed = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(ident("supplier", "s_suppkey").alias("id"))
    return impact.consumers(changed, handled, requests, callers, uses.filter("type = 'INVOKES'"))


def x26_affected_tests(spark, sf_dir):
    """Orders are files, those of status P tests, and call parts; small parts have changed."""
    path = F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.expr("if(o_orderstatus = 'P', '.test.js', '.js')"))
    order, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    files = order.select(F.concat(F.lit("app:"), path).alias("id"), path.alias("path"), "o_orderkey")
    at = lambda c: F.concat(F.lit("app:p/"), F.col(c).cast("string"), F.lit(".js#f"))
    calls = table(spark, sf_dir, "lineitem").join(files, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("CALLS").alias("type"), F.concat("id", F.lit("#f")).alias("src"), at("l_partkey").alias("dst"), F.lit("exact").alias("resolution"))
    changed_paths = order.filter("o_orderkey % 50 = 7").select(path.alias("path"))
    return impact.affected_tests(part.filter("p_size = 1").select(at("p_partkey").alias("id")), changed_paths, files, calls)


def x26_gates(spark, sf_dir):
    """Orders as declarations: filled ones are removed, open ones have a new signature; lines are uses."""
    order, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    one = order.select(F.col("o_orderkey").alias("id"), F.expr("case o_orderstatus when 'F' then 'removed' when 'O' then 'signature' else 'body' end").alias("change"), "o_orderpriority", "o_totalprice")
    values = impact.gate_values(
        one, one.filter("o_orderpriority like '1%'"), one.filter("o_totalprice > 200000"), line.filter("l_quantity < 5").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")),
        line.filter("l_suppkey = 1").select(F.col("l_orderkey").alias("node")), line.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")), line.filter("l_returnflag <> 'A'").select(F.col("l_partkey").alias("id")),
    )
    return impact.gates(values)


def x26_trace_nodes(spark, sf_dir):
    """Events as spans: errors tell a line, clicks a route, views a qualified name, purchases a bare one, sign-ups have frames."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = lambda *names: F.col("event_type").isin(*names)
    file = F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string"))
    name = F.when(kind("view"), F.concat(file, F.lit(".inner"))).when(kind("purchase"), F.lit("Other.outer"))
    traces = e.select(
        F.col("event_id").alias("trace"), F.when(kind("error", "purchase"), file).alias("file_id"), F.when(kind("error"), F.col("k")).alias("line"), F.lit("app").alias("app_key"),
        F.when(kind("click"), F.lit("get")).alias("method"), F.when(kind("click"), F.concat(F.lit("/r/"), F.col("k").cast("string"))).alias("route"), name.alias("name"),
    )
    frames = e.filter("event_type = 'signup'").select(F.col("event_id").alias("trace"), file.alias("file_id"), F.posexplode(F.array(F.lit(200), F.col("k"))).alias("pos", "line"))
    ten = spark.range(10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_id"))
    spans = F.expr("inline(array(struct('outer' as name, 1 as start_line, 80 as end_line, 0 as seq), struct('inner' as name, 20 as start_line, 39 as end_line, 1 as seq)))")
    decls = ten.select("file_id", spans).withColumns({"id": F.concat_ws("#", "file_id", "name"), "qualified": F.concat_ws(".", "file_id", "name")})
    ends = spark.range(50).select(F.concat(F.lit("end"), F.col("id").cast("string")).alias("id"), F.lit("app").alias("app_key"), F.lit("GET").alias("method"), F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("path"))
    return impact.trace_nodes(traces, frames, decls, ends)


def x26_body_hash(spark, sf_dir):
    """Each part as a file of one function: comments and blank lines tell nothing."""
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    text = F.concat(F.repeat(F.lit("\n"), F.col("p_size") % 3), F.lit("function f(a) {\n  // "), "p_name", F.lit("\n\n  return a + "), F.col("p_size").cast("string"), F.lit(";\n}\n"))
    part = table(spark, sf_dir, "part")
    files = part.select(name.alias("file_id"), text.alias("content"))
    decls = part.select(name.alias("id"), name.alias("file_id"), (F.col("p_size") % 3 + 1).alias("start_line"), F.lit(1).alias("start_col"), (F.col("p_size") % 3 + 5).alias("end_line"))
    return impact.body_hashes(tokens(files), decls)


def x26_ranked_suspects(spark, sf_dir):
    """Orders of a customer as changes in one cone: by distance, kind, how sure, and newest."""
    order = table(spark, sf_dir, "orders")
    cone = order.select(ident("customer", "o_custkey").alias("start"), ident("order", "o_orderkey").alias("node"), (F.col("o_orderkey") % 2 + 1).alias("distance"), F.expr(_STATUS).alias("resolution"))
    kind = F.expr("case substr(o_orderpriority, 1, 1) when '1' then 'deps' when '2' then 'signature' when '3' then 'body' when '4' then 'added' else 'moved' end")
    changes = order.select(ident("order", "o_orderkey").alias("node"), kind.alias("kind"), F.col("o_orderdate").alias("changed"))
    return history.suspects(cone, changes, 5).select("start", "node", "distance", "kind", "resolution", "place")


def x26_moved(spark, sf_dir):
    """Customers as declarations of their nation's file; the files of one region are renamed, some customers move or change."""
    c = table(spark, sf_dir, "customer")
    ident_ = lambda file: F.concat(file, F.lit("#"), "c_name")
    old_file, new_file = (F.concat(F.lit(f"app:{x}"), F.col("c_nationkey").cast("string")) for x in ("f", "g"))
    old = c.select(ident_(old_file).alias("id"), F.col("c_mktsegment").alias("signature"), F.lit(1).alias("body"), F.lit(1).alias("place"))
    there = F.when(F.col("c_nationkey") < 5, new_file).otherwise(old_file)
    new = c.select(ident_(there).alias("id"), F.col("c_mktsegment").alias("signature"), F.expr("if(c_custkey % 7 = 0, 2, 1)").alias("body"), F.expr("if(c_custkey % 3 = 0, 2, 1)").alias("place"))
    renames = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(*(F.concat(F.lit(f"app:{x}"), F.col("n_nationkey").cast("string")).alias(y) for x, y in (("f", "old_file"), ("g", "new_file"))))
    return history.semantic_diff(old, new, renames)


QUERIES = (x26_sure_impact, x26_consumers, x26_affected_tests, x26_gates, x26_trace_nodes, x26_body_hash, x26_ranked_suspects, x26_moved)

_RANK = "CASE {0} WHEN '{1}' THEN 0 WHEN '{2}' THEN 1 ELSE 2 END"
_LINE, _ORDER = _RANK.format("l_returnflag", "A", "R"), _RANK.format("o_orderstatus", "F", "O")
_NAME = "CASE {0} WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'name_only' END"

SQL = {
    "x26_sure_impact": f"""
WITH a AS (SELECT l_suppkey, l_orderkey, min({_LINE}) AS s FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL),
b AS (SELECT l_suppkey, o_custkey, min(greatest(s, {_ORDER})) AS s FROM a JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT 'supplier:' || l_suppkey AS start, 'order:' || l_orderkey AS node, 1 AS distance, {_NAME.format("s")} AS resolution FROM a
UNION ALL SELECT 'supplier:' || l_suppkey, 'customer:' || o_custkey, 2, {_NAME.format("s")} FROM b""",
    "x26_consumers": f"""
WITH h AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)),
f AS (SELECT h.l_suppkey, l.l_orderkey, min({_LINE.replace("l_returnflag", "l.l_returnflag")}) AS s FROM lineitem l JOIN h ON h.l_partkey = l.l_partkey GROUP BY ALL),
u AS (SELECT l_suppkey, o_custkey, min(greatest(s, {_ORDER})) AS s FROM f JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT 'supplier:' || l_suppkey AS id, 'order:' || l_orderkey AS node, 0 AS distance, {_NAME.format("s")} AS resolution FROM f
UNION ALL SELECT 'supplier:' || l_suppkey, 'customer:' || o_custkey, 1, {_NAME.format("s")} FROM u""",
    "x26_affected_tests": """
SELECT 'o/' || o_orderkey || '.test.js' AS path, CASE WHEN o_orderkey % 50 = 7 THEN 'changed' ELSE 'reached' END AS reason FROM orders
WHERE o_orderstatus = 'P' AND (o_orderkey % 50 = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1))""",
    "x26_gates": """
WITH v AS (
  SELECT 'contract_breaking' AS rule, 'error' AS level, count(*) AS value, 0 AS most FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'
  UNION ALL SELECT 'exported_signature_changed', 'warning', count(*), 0 FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 5)
  UNION ALL SELECT 'blast_radius', 'warning', count(*), 5 FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)
  UNION ALL SELECT 'unresolved_increase', 'warning', (count(*) FILTER (WHERE l_returnflag <> 'A') - count(*) FILTER (WHERE l_returnflag = 'A')), 10 FROM lineitem)
SELECT rule, level, value, most::BIGINT AS most FROM v WHERE value > most""",
    "x26_trace_nodes": """
WITH e AS (SELECT event_id, event_type AS t, 'f' || (user_id % 10) AS f, json_extract_string(props, '$.k')::INT AS k FROM events),
n AS (
  SELECT event_id AS trace, CASE
    WHEN t IN ('error', 'signup') AND k BETWEEN 20 AND 39 THEN f || '#inner' WHEN t IN ('error', 'signup') AND k BETWEEN 1 AND 80 THEN f || '#outer'
    WHEN t = 'click' AND k < 50 THEN 'end' || k WHEN t = 'view' THEN f || '#inner' WHEN t = 'purchase' THEN f || '#outer' END AS node, t FROM e)
SELECT trace, node, CASE WHEN node IS NULL THEN NULL WHEN t = 'view' THEN 'inferred' WHEN t = 'purchase' THEN 'name_only' ELSE 'exact' END AS resolution FROM n""",
    "x26_body_hash": "SELECT 'p' || p_partkey AS id, sha256(array_to_string(['function', 'f', '(', 'a', ')', '{', 'return', 'a', '+', p_size::VARCHAR, ';', '}'], chr(10))) AS body_hash FROM part",
    "x26_ranked_suspects": f"""
WITH s AS (
  SELECT 'customer:' || o_custkey AS start, 'order:' || o_orderkey AS node, o_orderkey % 2 + 1 AS distance, substr(o_orderpriority, 1, 1) AS p, {_ORDER} AS r, o_orderdate FROM orders),
k AS (SELECT *, CASE p WHEN '1' THEN 'deps' WHEN '2' THEN 'signature' WHEN '3' THEN 'body' WHEN '4' THEN 'added' ELSE 'moved' END AS kind,
  row_number() OVER (PARTITION BY start ORDER BY distance, greatest(p::INT - 2, 0), r, o_orderdate DESC, node) AS place FROM s)
SELECT start, node, distance, kind, {_NAME.format("r")} AS resolution, place FROM k WHERE place <= 5""",
    "x26_moved": """
SELECT 'app:' || CASE WHEN c_nationkey < 5 THEN 'g' ELSE 'f' END || c_nationkey || '#' || c_name AS id, CASE WHEN c_custkey % 7 = 0 THEN 'body' WHEN c_nationkey < 5 THEN 'renamed' ELSE 'moved' END AS change
FROM customer WHERE c_custkey % 7 = 0 OR c_nationkey < 5 OR c_custkey % 3 = 0""",
}
