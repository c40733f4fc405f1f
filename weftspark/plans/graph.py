"""Counts, dedup, merging and derived edges over the graph view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions.confidence import rank
from ..operators import audit, dedup, derive, paths, store
from .views import EDGES_SQL, NODES_SQL, edges, ident, nodes, table


def x5_node_type_counts(spark, sf_dir):
    return model.type_counts(nodes(spark, sf_dir))


def x5_edge_type_counts(spark, sf_dir):
    return model.type_counts(edges(spark, sf_dir))


def x5_distinct_edges(spark, sf_dir):
    return model.distinct_edges(edges(spark, sf_dir))


def x6_flatten_props(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        ident("order", "l_orderkey").alias("src"), F.col("l_partkey"), F.col("l_suppkey"),
        F.struct(F.col("l_linenumber").alias("start_line"), F.col("l_quantity").alias("start_col")).alias("loc"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("kind"), F.col("l_discount").alias("share"), F.lit("").alias("member"),
    )
    return model.flatten(model.stored_properties(line))


def x7_dedup_first(spark, sf_dir):
    some = edges(spark, sf_dir).filter("type = 'ARGUMENT'").select("type", "src", "dst", "idx")
    return dedup.first_wins(some, ["type", "src", "dst"], ["idx"])


def x7_dedup_last(spark, sf_dir):
    some = edges(spark, sf_dir).filter("type = 'ARGUMENT'").select("src", "idx", "dst")
    return dedup.last_wins(some, ["src", "idx"], ["dst"])


def x8_edge_merge(spark, sf_dir):
    """READS edges with some suppliers missing: one edge each, the last non-null properties."""
    seq = "(((l_partkey * 8 + l_linenumber) * 128 + ascii(l_returnflag)) * 128 + ascii(l_linestatus)) * 128 + cast(round(l_discount * 100) as bigint)"
    e = table(spark, sf_dir, "lineitem").select(
        F.lit("READS").alias("type"), ident("order", "l_orderkey").alias("src"), ident("supplier", "l_suppkey").alias("dst"),
        F.expr("case when l_returnflag <> 'N' then l_returnflag end").alias("member"), F.expr("case when l_linestatus = 'F' then l_linestatus end").alias("kind"),
        F.expr("case when l_discount > 0.02 then l_discount end").alias("share"), F.expr(seq).alias("seq"),
    )
    there = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(ident("supplier", "s_suppkey").alias("id")).unionByName(table(spark, sf_dir, "orders").select(ident("order", "o_orderkey").alias("id")))
    return store.upsert_edges(e, there, ["member", "kind", "share"])


def x12_flows_assign(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    seq = F.expr("(l_orderkey * 8 + l_linenumber) * 128 + ascii(l_returnflag)").alias("seq")
    reads = line.select(F.col("l_orderkey").alias("assign"), ident("part", "l_partkey").alias("node"), seq)
    writes = line.select(F.col("l_orderkey").alias("assign"), ident("supplier", "l_suppkey").alias("node"), F.col("l_returnflag").alias("member"), seq)
    return derive.flows_assign(reads, writes)


def x12_flows_args(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    arguments = line.select(F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("idx"), ident("part", "l_partkey").alias("node"), F.col("l_partkey").alias("seq"))
    calls = orders.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("target"), F.col("o_custkey").alias("seq"))
    parameters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.explode(F.expr("array(1, 2, 3)")).alias("idx")).select("owner", "idx", F.concat_ws(":", F.lit("param"), "owner", "idx").alias("node"), F.col("owner").alias("seq"))
    return derive.flows_args(arguments, calls, parameters)


def x13_invokes_derive(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sure = F.expr("case l_returnflag when 'A' then 'exact' when 'R' then 'inferred' else 'name_only' end")
    told = line.select(ident("order", "l_orderkey").alias("src"), "l_partkey", "l_suppkey", sure.alias("resolution"), "l_orderkey", "l_linenumber")
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + rank(F.col("resolution"))).alias("seq")
    calls = told.select(F.lit("CALLS").alias("type"), "src", ident("customer", "l_partkey").alias("dst"), "resolution", seq)
    args = told.select(F.lit("ARGUMENT").alias("type"), "src", ident("customer", "l_suppkey").alias("dst"), "resolution", seq)
    functions = table(spark, sf_dir, "customer").select(F.lit("Function").alias("type"), ident("customer", "c_custkey").alias("id"), F.lit(None).cast("string").alias("owner_id"))
    callers = orders.select(F.lit("Call").alias("type"), ident("order", "o_orderkey").alias("id"), ident("customer", "o_custkey").alias("owner_id"))
    return derive.invokes(functions.unionByName(callers), calls.unionByName(args))


def x14_scope_lookup(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    scopes = (
        table(spark, sf_dir, "region").select(ident("region", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
        .unionByName(nation.select(ident("nation", "n_nationkey").alias("id"), ident("region", "n_regionkey").alias("parent")))
        .unionByName(customer.select(ident("customer", "c_custkey").alias("id"), ident("nation", "c_nationkey").alias("parent")))
    )
    name = lambda df, who, n: df.select(who.alias("scope"), F.lit(n).alias("name"), F.concat(who, F.lit("#"), F.lit(n)).alias("node"), F.lit(0).alias("seq"))
    names = (
        name(table(spark, sf_dir, "region"), ident("region", "r_regionkey"), "tax")
        .unionByName(name(nation.filter("n_name < 'J'"), ident("nation", "n_nationkey"), "tax"))
        .unionByName(name(nation, ident("nation", "n_nationkey"), "rate"))
        .unionByName(name(customer.filter("c_acctbal > 0"), ident("customer", "c_custkey"), "rate"))
    )
    asked = customer.select(ident("customer", "c_custkey").alias("scope"), F.explode(F.expr("array('tax', 'rate', 'none')")).alias("name"))
    return paths.nearest(asked, paths.ancestors(scopes), names).select("scope", "name", "node")


def _parents(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part, part.select(F.col("p_partkey").alias("id"), F.expr("case when p_partkey > 1 then p_partkey div 2 end").alias("parent"))


def x15_member_inherit(spark, sf_dir):
    """Each class asks for the member that its grandparent declares: its own or the nearest ancestor's."""
    part, parents = _parents(spark, sf_dir)
    names = part.select(F.col("p_partkey").alias("scope"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("node"), F.lit(0).alias("seq"))
    grand = part.select((F.col("p_partkey")).alias("g"), F.col("p_brand").alias("name"))
    asked = part.select(F.col("p_partkey").alias("scope"), F.expr("p_partkey div 4").alias("g")).join(grand, "g").select("scope", "name")
    return paths.nearest(asked, paths.ancestors(parents), names).select("scope", "name", "node")


def x16_impact_bfs(spark, sf_dir):
    """Who is hit when a supplier changes: backwards over READS and INVOKES."""
    back = edges(spark, sf_dir).filter("type in ('READS', 'INVOKES')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = table(spark, sf_dir, "supplier").select(ident("supplier", "s_suppkey").alias("start"))
    return paths.reach(back, starts, 6)


def x16_flow_reach(spark, sf_dir):
    part, parents = _parents(spark, sf_dir)
    steps = parents.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return paths.reach(steps, part.select(F.col("p_partkey").alias("start")), 8)


def x16_reach_stops(spark, sf_dir):
    down = edges(spark, sf_dir).filter("type in ('CONTAINS', 'INVOKES')")
    stops = table(spark, sf_dir, "nation").filter("n_name >= 'M'").select(ident("nation", "n_nationkey").alias("node"))
    return paths.reach(down, table(spark, sf_dir, "region").select(ident("region", "r_regionkey").alias("start")), 5, stops)


def x17_audit_unlinked(spark, sf_dir):
    customer, nation, supplier = (table(spark, sf_dir, n) for n in ("customer", "nation", "supplier"))
    contains = customer.select(ident("nation", "c_nationkey").alias("app_id"), ident("customer", "c_custkey").alias("file_id"))
    declares = table(spark, sf_dir, "orders").select(ident("customer", "o_custkey").alias("file_id"), ident("order", "o_orderkey").alias("owner_id"))
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("call_id"), ident("order", "l_orderkey").alias("owner_id"), ident("supplier", "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("callee"), ident("part", "l_partkey").alias("call_file"), F.col("l_linenumber").alias("start_line"))
    externals = supplier.select(ident("supplier", "s_suppkey").alias("target_id"), F.expr("case when s_acctbal > 5000 then 'fetch' else s_name end").alias("name"))
    requests = nation.filter("n_regionkey < 2").select(ident("nation", "n_nationkey").alias("app_id"))
    return audit.unlinked_calls(contains, declares, calls, externals, requests)


QUERIES = (x5_node_type_counts, x5_edge_type_counts, x5_distinct_edges, x6_flatten_props, x7_dedup_first, x7_dedup_last, x8_edge_merge, x12_flows_assign, x12_flows_args, x13_invokes_derive, x14_scope_lookup, x15_member_inherit, x16_impact_bfs, x16_flow_reach, x16_reach_stops, x17_audit_unlinked)

_SEQ = "(((l_partkey * 8 + l_linenumber) * 128 + ascii(l_returnflag)) * 128 + ascii(l_linestatus)) * 128 + round(l_discount * 100)::BIGINT"

SQL = {
    "x5_node_type_counts": f"SELECT type, count(*) AS n FROM ({NODES_SQL}) GROUP BY type",
    "x5_edge_type_counts": f"SELECT type, count(*) AS n FROM ({EDGES_SQL}) GROUP BY type",
    "x5_distinct_edges": f"SELECT type, count(DISTINCT (src, dst)) AS n FROM ({EDGES_SQL}) GROUP BY type",
    "x6_flatten_props": "SELECT 'order:' || l_orderkey AS src, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS kind, CASE WHEN l_discount > 0 THEN l_discount END AS share, NULL::VARCHAR AS member, l_linenumber AS start_line, l_quantity AS start_col FROM lineitem",
    "x7_dedup_first": f"SELECT type, src, dst, min(idx) AS idx FROM ({EDGES_SQL}) WHERE type = 'ARGUMENT' GROUP BY type, src, dst",
    "x7_dedup_last": f"SELECT src, idx, max(dst) AS dst FROM ({EDGES_SQL}) WHERE type = 'ARGUMENT' GROUP BY src, idx",
    "x8_edge_merge": f"""
WITH e AS (SELECT *, {_SEQ} AS seq FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) AND l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'order:' || l_orderkey AS src, 'READS' AS type, 'supplier:' || l_suppkey AS dst,
       arg_max(l_returnflag, seq) FILTER (WHERE l_returnflag <> 'N') AS member, arg_max(l_linestatus, seq) FILTER (WHERE l_linestatus = 'F') AS kind,
       arg_max(l_discount, seq) FILTER (WHERE l_discount > 0.02) AS share
FROM e GROUP BY l_orderkey, l_suppkey""",
    "x12_flows_assign": """
SELECT 'part:' || r.l_partkey AS src, 'supplier:' || w.l_suppkey AS dst, arg_min(w.l_returnflag, (w.l_orderkey * 8 + w.l_linenumber) * 128 + ascii(w.l_returnflag)) AS member
FROM lineitem r JOIN lineitem w ON r.l_orderkey = w.l_orderkey GROUP BY r.l_partkey, w.l_suppkey""",
    "x12_flows_args": """
WITH a AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT DISTINCT 'part:' || p AS src, 'param:' || c_custkey || ':' || l_linenumber AS dst
FROM a JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linenumber <= 3""",
    "x13_invokes_derive": """
WITH e AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS callee, false AS late, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS r FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, true, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END FROM lineitem),
m AS (
  SELECT 'customer:' || o.o_custkey AS src, 'customer:' || callee AS dst, late, l_orderkey, l_linenumber, r, CASE WHEN late THEN greatest(r, 1) ELSE r END AS sure
  FROM e JOIN orders o ON o.o_orderkey = l_orderkey JOIN customer c ON c.c_custkey = callee JOIN customer k ON k.c_custkey = o.o_custkey),
f AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY late, l_orderkey * 8 + l_linenumber, r) AS place FROM m)
SELECT 'INVOKES' AS type, src, dst, CASE sure WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'name_only' END AS resolution FROM f WHERE place = 1""",
    "x14_scope_lookup": """
WITH RECURSIVE scopes AS (
  SELECT 'region:' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
up AS (SELECT id, id AS ancestor, 0 AS depth FROM scopes UNION ALL SELECT up.id, s.parent, depth + 1 FROM up JOIN scopes s ON s.id = up.ancestor WHERE s.parent IS NOT NULL),
names AS (
  SELECT 'region:' || r_regionkey AS scope, 'tax' AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'tax' FROM nation WHERE n_name < 'J'
  UNION ALL SELECT 'nation:' || n_nationkey, 'rate' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'rate' FROM customer WHERE c_acctbal > 0),
asked AS (SELECT 'customer:' || c_custkey AS scope, unnest(['tax', 'rate', 'none']) AS name FROM customer)
SELECT a.scope, a.name, arg_min(n.scope || '#' || n.name, depth) AS node
FROM asked a LEFT JOIN up ON up.id = a.scope LEFT JOIN names n ON n.scope = up.ancestor AND n.name = a.name GROUP BY a.scope, a.name""",
    "x15_member_inherit": """
WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey AS ancestor, 0 AS depth FROM part UNION ALL SELECT id, ancestor // 2, depth + 1 FROM up WHERE ancestor > 1),
asked AS (SELECT p.p_partkey AS scope, g.p_brand AS name FROM part p JOIN part g ON g.p_partkey = p.p_partkey // 4)
SELECT scope, name, arg_min(p_partkey, depth) AS node FROM asked LEFT JOIN (SELECT id, p_brand, p_partkey, depth FROM up JOIN part ON p_partkey = ancestor) ON id = scope AND p_brand = name GROUP BY scope, name""",
    "x16_impact_bfs": """
WITH a AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'supplier:' || l_suppkey AS start, 'order:' || l_orderkey AS node, 1 AS distance FROM a
UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'customer:' || o_custkey, 2 FROM a JOIN orders ON o_orderkey = l_orderkey""",
    "x16_flow_reach": """
WITH RECURSIVE up AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS distance FROM part UNION ALL SELECT start, node // 2, distance + 1 FROM up WHERE node > 1 AND distance < 8)
SELECT start, node, distance FROM up WHERE distance > 0""",
    "x16_reach_stops": """
WITH n AS (SELECT 'region:' || n_regionkey AS start, n_nationkey, n_name FROM nation),
c AS (SELECT start, 'customer:' || c_custkey AS node, c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey WHERE n_name < 'M')
SELECT start, 'nation:' || n_nationkey AS node, 1 AS distance FROM n
UNION ALL SELECT start, node, 2 FROM c
UNION ALL SELECT start, 'supplier:' || s_suppkey, 2 FROM n JOIN supplier ON s_nationkey = n_nationkey WHERE n_name < 'M'
UNION ALL SELECT start, 'order:' || o_orderkey, 3 FROM c JOIN orders ON o_custkey = c_custkey""",
    "x17_audit_unlinked": """
SELECT 'nation:' || c_nationkey AS app_id, l_orderkey || '/' || l_linenumber AS call_id,
       l_returnflag AS callee, 'part:' || l_partkey AS file_id, l_linenumber AS start_line
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE s_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 2)
ORDER BY 1, 2 LIMIT 500""",
}
