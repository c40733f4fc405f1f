"""Request chains, contracts, critical areas and reviewers, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, contracts, impact
from ..sources.config import Gates
from .views import ident, table


def x29_request_chains(spark, sf_dir):
    """Parts are endpoints, handled by suppliers; these request parts by their smallest lines, invoke each other, and pass messages over months of shipping."""
    line, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    call = F.concat_ws("/", F.lit("call"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    supplier, part, mode = ident("supplier", "l_suppkey"), ident("part", "l_partkey"), F.concat(F.lit("topic:"), F.month("l_shipdate").cast("string"))
    edges = edge(line.filter("l_linenumber = 1 and l_returnflag = 'A'"), "HANDLED_BY", part, supplier)
    edges = edges.unionByName(edge(line.filter("l_linenumber = 2 and l_quantity = 1"), "REQUESTS", call, part))
    edges = edges.unionByName(edge(s, "INVOKES", ident("supplier", "s_suppkey"), F.expr("concat('supplier:', s_suppkey div 2 + s_nationkey)")))
    edges = edges.unionByName(edge(line.filter("l_linenumber = 3 and l_quantity = 2"), "PRODUCES", supplier, mode))
    edges = edges.unionByName(edge(line.filter("l_linenumber = 4 and l_quantity = 3"), "CONSUMES", supplier, mode))
    owners = line.select(call.alias("call"), supplier.alias("owner"))
    ends = table(spark, sf_dir, "part").select(ident("part", "p_partkey").alias("endpoint"))
    found = chains.request_chains(chains.request_steps(edges, owners), ends, 4)
    return found.select("endpoint", "place", chains.chain_text(F.col("chain")).alias("chain"), "ended")


def _side(spark, sf_dir, new: bool):
    """Parts as endpoints with a variable in their path, lines as what they are asked with, brands as what they answer."""
    part = table(spark, sf_dir, "part").filter("p_size > 2" if new else "p_size < 48")
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 30" if new else "l_quantity <= 45")
    name, own, none = ("new", "old")[not new], F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    end, variable, handler = F.concat(F.lit("app:"), own), F.concat(F.lit("v:"), own), F.concat(F.lit("f:"), own)
    asked = F.concat_ws("/", F.lit("q"), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    node = lambda df, kind, id_, method=none, path=none, name_=none, place=none, type_=none, required=F.lit(None).cast("boolean"): df.select(id_.alias("id"), F.lit(kind).alias("type"), method.alias("method"), path.alias("path"), name_.alias("name"), place.alias("in"), type_.alias("type_name"), required.alias("required"))
    answer = F.expr("case when p_size % 7 = 0 then null when p_size % 5 = 0 then p_type else p_brand end") if new else F.col("p_brand")
    nodes = node(part, "Endpoint", end, F.lit("GET"), F.concat(F.lit("/p/{%s}/" % name), own))
    nodes = nodes.unionByName(node(part, "HttpParam", variable, name_=F.lit(name), place=F.lit("path"), type_=F.expr("if(p_size % 3 = 0, 'number', 'string')") if new else F.lit("string"), required=F.lit(True)))
    nodes = nodes.unionByName(node(part, "Function", handler, type_=answer))
    nodes = nodes.unionByName(node(line, "HttpParam", asked, name_=F.concat(F.lit("q"), F.col("l_linenumber").cast("string")), place=F.lit("query"), type_=F.col("l_returnflag"), required=F.col("l_linestatus") == "F"))
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    edges = edge(part, "HAS_PARAM", end, variable).unionByName(edge(part, "HANDLED_BY", end, handler)).unionByName(edge(line, "HAS_PARAM", F.concat(F.lit("app:"), F.col("l_partkey").cast("string")), asked))
    return contracts.contract(nodes, edges)


def x30_contract_diff(spark, sf_dir):
    return contracts.contract_diff(_side(spark, sf_dir, False), _side(spark, sf_dir, True))


_RULES = Gates.of({"critical": [
    {"name": "auth", "match": ["src/building/**", "src/*/Customer?0000*7.ts"], "require_reviewers": 2000},
    {"name": "billing", "match": ["src/machinery/*.ts", "endpoint:POST /c/?"], "require_reviewers": 12},
]}, impact.RULES)


def _hits(spark, sf_dir):
    """Customers as files in a folder of their segment, those of the smallest balances as endpoints too."""
    c = table(spark, sf_dir, "customer")
    one = lambda df, kind, text: df.select(ident("customer", "c_custkey").alias("id"), F.lit(kind).alias("kind"), text.alias("text"))
    files = one(c, "path", F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".ts")))
    ends = one(c.filter("c_acctbal < 2000"), "endpoint", F.concat(F.lit("POST /c/"), F.col("c_custkey").cast("string")))
    return contracts.in_areas(files.unionByName(ends), spark.createDataFrame(_RULES.patterns(), "area string, kind string, prefix string, pattern string"))


def x30_critical_areas(spark, sf_dir):
    return _hits(spark, sf_dir)


def x30_area_gates(spark, sf_dir):
    """Users of errors approve; a customer belongs to the user of its number and the next."""
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    owns = c.select(ident("customer", "c_custkey").alias("id"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("person"))
    needed = spark.createDataFrame([(name, n) for name, _, n in _RULES.critical], "area string, required long")
    return contracts.area_gates(_hits(spark, sf_dir), needed, owns, e.filter("event_type = 'error'").select(F.col("user_id").alias("person")))


def x30_reviewers(spark, sf_dir):
    """Suppliers own parts by quantities; small parts are touched; suppliers of one nation wrote the change, some have long been away."""
    line = table(spark, sf_dir, "lineitem")
    part, person = ident("part", "l_partkey").alias("id"), ident("supplier", "l_suppkey").alias("person")
    authors = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(ident("supplier", "s_suppkey").alias("person"))
    touched = table(spark, sf_dir, "part").filter("p_size < 10").select(ident("part", "p_partkey").alias("id"))
    times = line.filter("l_quantity = 50").select(part, person, F.col("l_shipdate").cast("date").alias("time"))
    return contracts.reviewers(touched, line.select(part, person, F.col("l_quantity").alias("share")), times, authors, F.lit("2001-08-01").cast("date"), 20)


QUERIES = (x29_request_chains, x30_contract_diff, x30_critical_areas, x30_area_gates, x30_reviewers)

_SIDE = """
  SELECT '/p/{{}}/' || p_partkey AS route, 'endpoint' AS part, '' AS place, '' AS name, NULL AS type, false AS required FROM part WHERE {parts}
  UNION ALL SELECT '/p/{{}}/' || p_partkey, 'parameter', 'path', '{{1}}', {variable}, true FROM part WHERE {parts}
  UNION ALL SELECT '/p/{{}}/' || p_partkey, 'response', '', '', {answer}, false FROM part WHERE {parts}
  UNION ALL SELECT '/p/{{}}/' || l_partkey, 'parameter', 'query', 'q' || l_linenumber, arg_min(l_returnflag, told), arg_min(l_linestatus, told) = 'F'
  FROM (SELECT *, concat_ws('/', 'q', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS told FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {lines} AND {parts}) GROUP BY l_partkey, l_linenumber"""
_OLD = _SIDE.format(parts="p_size < 48", variable="'string'", answer="p_brand", lines="l_quantity <= 45")
_NEW = _SIDE.format(parts="p_size > 2", variable="CASE WHEN p_size % 3 = 0 THEN 'number' ELSE 'string' END", answer="CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN p_type ELSE p_brand END", lines="l_quantity > 30")
_HITS = """h AS (
  SELECT 'auth' AS area, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR regexp_matches(c_name, '^Customer.0000.*7$')
  UNION SELECT 'billing', c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' OR (c_acctbal < 2000 AND c_custkey < 10))"""

SQL = {
    "x29_request_chains": """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'HANDLED_BY' AS type FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'
  UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'REQUESTS' FROM lineitem WHERE l_linenumber = 2 AND l_quantity = 1
  UNION SELECT 'supplier:' || s_suppkey, 'supplier:' || (s_suppkey // 2 + s_nationkey), 'INVOKES' FROM supplier WHERE s_suppkey <> s_suppkey // 2 + s_nationkey
  UNION SELECT 'supplier:' || l_suppkey, 'topic:' || month(l_shipdate), 'PRODUCES' FROM lineitem WHERE l_linenumber = 3 AND l_quantity = 2
  UNION SELECT 'topic:' || month(l_shipdate), 'supplier:' || l_suppkey, 'CONSUMES' FROM lineitem WHERE l_linenumber = 4 AND l_quantity = 3),
w AS (
  SELECT src AS endpoint, [dst] AS nodes, type || ' ' || dst AS chain FROM e WHERE type = 'HANDLED_BY'
  UNION ALL
  SELECT endpoint, list_append(nodes, dst), chain || ' ' || type || ' ' || dst FROM w JOIN e ON src = nodes[-1] AND dst <> endpoint AND NOT list_contains(nodes, dst) WHERE len(nodes) <= 4),
x AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE src = nodes[-1] AND dst <> endpoint AND NOT list_contains(nodes, dst)) AS more FROM w)
SELECT * FROM (SELECT endpoint, row_number() OVER (PARTITION BY endpoint ORDER BY nodes) AS place, chain, NOT more AS ended FROM x WHERE NOT more OR len(nodes) = 5) WHERE place <= 5""",
    "x30_contract_diff": f"""
WITH o AS ({_OLD}), n AS ({_NEW}),
b AS (
  SELECT coalesce(o.route, n.route) AS route, coalesce(o.part, n.part) AS part, coalesce(o.place, n.place) AS place, coalesce(o.name, n.name) AS name,
         o.route IS NOT NULL AS had, n.route IS NOT NULL AS has, o.type AS ot, n.type AS nt, coalesce(o.required, false) AS oq, n.required AS nq
  FROM o FULL JOIN n ON o.route = n.route AND o.part = n.part AND o.place = n.place AND o.name = n.name),
k AS (SELECT route FROM b WHERE part = 'endpoint' AND had AND has),
d AS (SELECT b.*, t.d FROM b, (VALUES (true), (false)) AS t(d)),
c AS (
  SELECT route, part, place, name, CASE
    WHEN part = 'endpoint' THEN CASE WHEN NOT d THEN NULL WHEN NOT has THEN 'endpoint_removed' WHEN NOT had THEN 'endpoint_added' END
    WHEN d AND part = 'parameter' THEN CASE WHEN has AND nq AND NOT oq THEN 'parameter_required' WHEN has AND NOT had THEN 'parameter_added' WHEN NOT has THEN 'parameter_removed' WHEN oq AND NOT nq THEN 'parameter_optional' END
    WHEN NOT d AND had AND has AND ot IS DISTINCT FROM nt THEN part || CASE WHEN ot IS NULL OR nt IS NULL THEN '_type_untold' ELSE '_type' END END AS change
  FROM d WHERE part = 'endpoint' OR route IN (SELECT route FROM k))
SELECT 'app' AS app_key, 'GET' AS method, route, place, name, change, change IN ('endpoint_removed', 'parameter_required', 'parameter_type', 'response_type') AS breaking FROM c WHERE change IS NOT NULL""",
    "x30_critical_areas": f"WITH {_HITS} SELECT area, 'customer:' || c_custkey AS id FROM h",
    "x30_area_gates": f"""
WITH {_HITS}, a AS (SELECT DISTINCT user_id AS p FROM events WHERE event_type = 'error'),
n AS (SELECT area, count(DISTINCT p) AS approved FROM h LEFT JOIN a ON p = c_custkey OR p = c_custkey + 1 GROUP BY area)
SELECT area, required::BIGINT AS required, approved FROM n JOIN (VALUES ('auth', 2000), ('billing', 12)) AS r(area, required) USING (area) WHERE approved < required""",
    "x30_reviewers": """
WITH t AS (SELECT l_suppkey, l_partkey, l_shipdate::DATE AS told FROM lineitem WHERE l_quantity = 50),
p AS (SELECT p_partkey FROM part WHERE p_size < 10),
s AS (SELECT l_suppkey, sum(l_quantity) AS share FROM lineitem WHERE l_partkey IN (FROM p) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
      AND l_suppkey IN (SELECT l_suppkey FROM t WHERE told >= DATE '2001-08-01') GROUP BY ALL),
r AS (SELECT 'supplier:' || s.l_suppkey AS person, share, row_number() OVER (ORDER BY share DESC, m DESC NULLS LAST, 'supplier:' || s.l_suppkey) AS place
      FROM s LEFT JOIN (SELECT l_suppkey, max(told) AS m FROM t WHERE l_partkey IN (FROM p) GROUP BY ALL) x ON x.l_suppkey = s.l_suppkey)
SELECT * FROM r WHERE place <= 20""",
}
