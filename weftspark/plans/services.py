"""Applications linked by signals, reviews and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals, store, xservice
from .views import APPS_SQL, EDGES_SQL, NODES_SQL, applications, edges, ident, nodes, table


def x1_link_services(spark, sf_dir):
    return xservice.links(applications(spark, sf_dir)).select("src", "kind", "hint", "target", "score", "n_candidates", "resolution")


def x1_link_report(spark, sf_dir):
    return xservice.report(xservice.links(applications(spark, sf_dir)))


def x2_review_ids(spark, sf_dir):
    r = xservice.reviews(xservice.links(applications(spark, sf_dir)))
    return r.select("id", "call_id", "edge_type", "chosen_id", "hint", "status", F.size("candidates").alias("n_candidates"))


def x2_candidates(spark, sf_dir):
    return xservice.candidates(applications(spark, sf_dir)).select("src", "kind", "hint", "target", "score")


def x3_signals_topn(spark, sf_dir):
    a = applications(spark, sf_dir)
    return a.select("key", F.array_join("host_candidates", " ").alias("hosts"), F.array_join("env_vars_read", " ").alias("envs"))


def x3_endpoint_signals(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("app_key"), F.when(F.col("url").startswith("https"), "post").otherwise("get").alias("method"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    s = signals.listed(signals.endpoint_values(p), "endpoints")
    return s.select("app_key", F.size("endpoints").cast("long").alias("n"), F.array_join("endpoints", ",").alias("endpoints"))


def x18_review_upsert(spark, sf_dir):
    new = xservice.reviews(xservice.links(applications(spark, sf_dir))).select("id", "chosen_id", "hint", "status")
    decided = new.filter(F.substring("id", -1, 1) < "8").select("id", F.lit("confirmed").alias("status"))
    old = store.set_status(new, decided).withColumn("hint", F.lit("old"))
    gone = spark.range(1).select(F.lit("gone:review:0").alias("id"), F.lit("app:gone").alias("chosen_id"), F.lit("url:gone").alias("hint"), F.lit("rejected").alias("status"))
    return store.upsert_reviews(old.unionByName(gone), new).select("id", "chosen_id", "hint", "status")


def x18_review_apps(spark, sf_dir):
    """Orders as reviews of applications that nations are, some of these keys the beginning of others."""
    n = table(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey % 8, if(n_nationkey < 8, '', concat(':', cast(n_nationkey as string))))").alias("key"), (F.lit(50) - F.col("n_nationkey")).alias("seq"))
    o = table(spark, sf_dir, "orders").select(F.expr("concat('n', o_custkey % 11, ':', o_orderkey % 40, if(o_orderkey % 3 = 0, '', ':review:'), if(o_orderkey % 3 = 2, cast(o_orderkey as string), ''))").alias("id"))
    return store.review_apps(o.distinct(), n)


def x18_retarget(spark, sf_dir):
    linked = xservice.links(applications(spark, sf_dir))
    second = linked.filter("resolution = 'ambiguous' and kind = 'url'").select(F.concat(F.lit("app:"), "src").alias("src"), F.concat(F.lit("app:"), "target").alias("dst"), F.concat(F.lit("app:"), F.get("candidates", F.lit(1))["target"]).alias("new_dst"))
    moves = second.groupBy("src", "dst").agg(F.min("new_dst").alias("new_dst"))
    all_ = xservice.request_edges(linked).filter("kind = 'url'").select("type", "src", "dst", "kind", "member", "resolution")
    return store.retarget(all_, moves)


def x18_delete_requests(spark, sf_dir):
    linked = xservice.links(applications(spark, sf_dir))
    all_ = xservice.request_edges(linked).select("type", "src", "dst", "kind", "member", "resolution")
    return store.delete_requests(all_, all_.filter("resolution = 'inferred'").select("src", "dst").distinct())


def x18_replace_app(spark, sf_dir):
    """All of a customer segment's nodes seen as one application's, and dropped."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    kept_nodes, kept_edges = store.without_app(n, e, "customer")
    return kept_nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(kept_edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def x18_node_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.lit("Customer").alias("type"), ident("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    new = table(spark, sf_dir, "supplier").select(F.lit("Customer").alias("type"), ident("customer", "s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("kind"))
    return store.upsert_nodes(old, new)


QUERIES = (x1_link_services, x1_link_report, x2_review_ids, x2_candidates, x3_signals_topn, x3_endpoint_signals, x18_review_upsert, x18_review_apps, x18_retarget, x18_delete_requests, x18_replace_app, x18_node_upsert)

_REVIEWS = "reviews AS (SELECT src || ':review:' || substr(sha1('app:' || src || '|' || kind || '|' || hint), 1, 12) AS id, 'app:' || src AS call_id, 'REQUESTS' AS edge_type, 'app:' || target AS chosen_id, kind || ':' || hint AS hint, 'pending' AS status, n_candidates FROM linked WHERE resolution = 'ambiguous')"

SQL = {
    "x18_review_apps": """
WITH n AS (SELECT 'n' || (n_nationkey % 8) || CASE WHEN n_nationkey < 8 THEN '' ELSE ':' || n_nationkey END AS key, 50 - n_nationkey AS seq FROM nation),
o AS (SELECT DISTINCT 'n' || (o_custkey % 11) || ':' || (o_orderkey % 40) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ':review:' ELSE ':review:' || o_orderkey END AS id FROM orders)
SELECT id, arg_min(key, seq) AS app_key FROM o LEFT JOIN n ON starts_with(id, key || ':') AND length(id) > length(key) + 1 GROUP BY id""",
    "x1_link_services": f"WITH {APPS_SQL} SELECT src, kind, hint, target, score, n_candidates, resolution FROM linked",
    "x1_link_report": f"WITH {APPS_SQL} SELECT count(*) FILTER (WHERE resolution = 'exact') AS exact, count(*) FILTER (WHERE resolution = 'inferred') AS inferred, count(*) FILTER (WHERE resolution = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE target IS NULL) AS unmatched FROM linked",
    "x2_review_ids": f"WITH {APPS_SQL}, {_REVIEWS} SELECT * FROM reviews",
    "x2_candidates": f"WITH {APPS_SQL} SELECT src, kind, hint, target, score FROM scored WHERE score > 0",
    "x3_signals_topn": f"WITH {APPS_SQL} SELECT target AS key, coalesce(array_to_string(hs, ' '), '') AS hosts, coalesce(array_to_string(es, ' '), '') AS envs FROM targets",
    "x3_endpoint_signals": r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS app_key, CASE WHEN starts_with(url, 'https') THEN 'POST' ELSE 'GET' END || ' ' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS v FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY app_key ORDER BY v) AS place FROM p)
SELECT app_key, count(*) AS n, string_agg(v, ',' ORDER BY v) AS endpoints FROM r WHERE place <= 50 GROUP BY app_key""",
    "x18_review_upsert": f"WITH {APPS_SQL}, {_REVIEWS} SELECT id, chosen_id, hint, CASE WHEN substr(id, length(id), 1) < '8' THEN 'confirmed' ELSE status END AS status FROM reviews UNION ALL SELECT 'gone:review:0', 'app:gone', 'url:gone', 'rejected'",
    "x18_retarget": f"""
WITH {APPS_SQL},
moves AS (SELECT src, target, min(second_target) AS new_target FROM linked WHERE resolution = 'ambiguous' AND kind = 'url' GROUP BY src, target)
SELECT 'REQUESTS' AS type, 'app:' || l.src AS src, 'app:' || coalesce(m.new_target, l.target) AS dst, CASE WHEN m.src IS NULL THEN l.kind END AS kind,
       CASE WHEN m.src IS NULL THEN l.hint END AS member, CASE WHEN m.src IS NULL THEN l.resolution ELSE 'overridden' END AS resolution
FROM linked l LEFT JOIN moves m ON l.src = m.src AND l.target = m.target WHERE l.target IS NOT NULL AND l.kind = 'url'""",
    "x18_delete_requests": f"""
WITH {APPS_SQL},
gone AS (SELECT DISTINCT src, target FROM linked WHERE resolution = 'inferred')
SELECT 'REQUESTS' AS type, 'app:' || src AS src, 'app:' || target AS dst, kind, hint AS member, resolution
FROM linked l WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = l.src AND g.target = l.target)""",
    "x18_replace_app": f"""
WITH nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})
SELECT type, count(*) AS n FROM nodes WHERE NOT starts_with(id, 'customer:') GROUP BY type
UNION ALL SELECT type, count(*) FROM edges WHERE NOT starts_with(src, 'customer:') AND NOT starts_with(dst, 'customer:') GROUP BY type""",
    "x18_node_upsert": """
SELECT 'Customer' AS type, 'customer:' || coalesce(c_custkey, s_suppkey) AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS name, c_mktsegment AS kind
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
}
