"""The star-schema tables seen as graphs: one definition for Spark, the same in the queries' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signals import listed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    out = None
    for name, kind, key, label in (("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderstatus")):
        one = t(name).select(F.lit(kind).alias("type"), ident(kind.lower(), key).alias("id"), F.col(label).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, src, dst, idx: a bag."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, kind, a, b, idx=None: df.select(F.lit(kind).alias("type"), ident(*a).alias("src"), ident(*b).alias("dst"), (F.col(idx) if idx else F.lit(None)).cast("int").alias("idx"))
    line = t("lineitem")
    return (
        row(t("nation"), "CONTAINS", ("region", "n_regionkey"), ("nation", "n_nationkey"))
        .unionByName(row(t("customer"), "CONTAINS", ("nation", "c_nationkey"), ("customer", "c_custkey")))
        .unionByName(row(t("supplier"), "CONTAINS", ("nation", "s_nationkey"), ("supplier", "s_suppkey")))
        .unionByName(row(t("orders"), "INVOKES", ("customer", "o_custkey"), ("order", "o_orderkey")))
        .unionByName(row(line, "ARGUMENT", ("order", "l_orderkey"), ("part", "l_partkey"), "l_linenumber"))
        .unionByName(row(line, "READS", ("order", "l_orderkey"), ("supplier", "l_suppkey")))
        .unionByName(row(line, "OWNS", ("supplier", "l_suppkey"), ("part", "l_partkey")))
    )


NODES_SQL = """
SELECT 'Region' AS type, 'region:' || r_regionkey AS id, r_name AS name FROM region
UNION ALL SELECT 'Nation', 'nation:' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'Customer', 'customer:' || c_custkey, c_name FROM customer
UNION ALL SELECT 'Supplier', 'supplier:' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 'Part', 'part:' || p_partkey, p_name FROM part
UNION ALL SELECT 'Order', 'order:' || o_orderkey, o_orderstatus FROM orders
"""

EDGES_SQL = """
SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, NULL::INT AS idx FROM nation
UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey, NULL FROM customer
UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 'INVOKES', 'customer:' || o_custkey, 'order:' || o_orderkey, NULL FROM orders
UNION ALL SELECT 'ARGUMENT', 'order:' || l_orderkey, 'part:' || l_partkey, l_linenumber FROM lineitem
UNION ALL SELECT 'READS', 'order:' || l_orderkey, 'supplier:' || l_suppkey, NULL FROM lineitem
UNION ALL SELECT 'OWNS', 'supplier:' || l_suppkey, 'part:' || l_partkey, NULL FROM lineitem
"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, name, host_candidates, env_vars_read: an application for each host label; it calls the one of the page behind."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)\.example\.", 1).alias("label"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("label").alias("next"))
    n = p.join(after, "page_id")
    named = p.filter("label <> ''").select("label").distinct()
    keys = named.select(F.col("label").alias("key")).unionByName(named.filter("length(label) < 6").select(F.concat("label", F.lit("-admin")).alias("key"))).distinct()
    hosts = n.select(F.col("label").alias("app_key"), F.concat("next", F.lit(":8080")).alias("value")).unionByName(keys.select(F.col("key").alias("app_key"), F.concat(F.lit("ext-"), "key", F.lit(":443")).alias("value")))
    envs = n.select(F.col("label").alias("app_key"), F.concat(F.upper("next"), F.lit("_URL")).alias("value"))
    none = F.array().cast("array<string>")
    out = keys.join(listed(hosts, "host_candidates").withColumnRenamed("app_key", "key"), "key", "left").join(listed(envs, "env_vars_read").withColumnRenamed("app_key", "key"), "key", "left")
    return out.select("key", F.col("key").alias("name"), F.coalesce("host_candidates", none).alias("host_candidates"), F.coalesce("env_vars_read", none).alias("env_vars_read"))


APPS_SQL = r"""
p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)\.example\.', 1) AS label FROM pages),
n AS (SELECT a.label, b.label AS nxt FROM p a JOIN p b ON b.page_id = a.page_id + 1),
keys AS (SELECT label AS key FROM p WHERE label <> '' UNION SELECT label || '-admin' FROM p WHERE label <> '' AND length(label) < 6),
hosts AS (SELECT label AS key, nxt || ':8080' AS h FROM n UNION SELECT key, 'ext-' || key || ':443' FROM keys),
hc AS (SELECT key, list_slice(list_sort(list(DISTINCT h)), 1, 20) AS hs FROM hosts WHERE key IN (SELECT key FROM keys) GROUP BY key),
ec AS (SELECT label AS key, list_slice(list_sort(list(DISTINCT upper(nxt) || '_URL')), 1, 20) AS es FROM n WHERE label IN (SELECT key FROM keys) GROUP BY label),
signals AS (
  SELECT key AS src, 'url' AS kind, hint, CASE WHEN instr(hint, ':') > 1 THEN split_part(hint, ':', 1) ELSE hint END AS head FROM (SELECT key, unnest(hs) AS hint FROM hc)
  UNION ALL
  SELECT key, 'env', hint, lower(CASE WHEN instr(hint, '_') > 1 THEN split_part(hint, '_', 1) ELSE hint END) FROM (SELECT key, unnest(es) AS hint FROM ec)),
norm AS (SELECT *, replace(lower(head), '_', '-') AS h FROM signals),
targets AS (SELECT keys.key AS target, replace(lower(keys.key), '_', '-') AS t, coalesce(hs, []) AS hs, coalesce(es, []) AS es FROM keys LEFT JOIN hc USING (key) LEFT JOIN ec USING (key)),
scored AS (
  SELECT src, kind, hint, target,
         CASE WHEN kind = 'url' AND list_contains(hs, hint) THEN 2 WHEN kind = 'env' AND list_contains(es, hint) THEN 2
              WHEN h <> '' AND (h = t OR starts_with(t, h || '-') OR starts_with(h, t || '-')) THEN CASE WHEN kind = 'url' THEN 2 ELSE 1 END ELSE 0 END AS score
  FROM norm JOIN targets ON src <> target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, kind, hint ORDER BY score DESC, target) AS place, count(*) OVER (PARTITION BY src, kind, hint) AS n FROM scored WHERE score > 0),
best AS (SELECT src, kind, hint, max(CASE WHEN place = 1 THEN target END) AS target, max(CASE WHEN place = 1 THEN score END) AS score, max(n) AS n,
         max(CASE WHEN place = 2 THEN score END) AS second, max(CASE WHEN place = 2 THEN target END) AS second_target FROM ranked GROUP BY src, kind, hint),
linked AS (
  SELECT s.src, s.kind, s.hint, b.target, b.score, coalesce(b.n, 0) AS n_candidates, b.second_target,
         CASE WHEN b.n IS NULL THEN NULL WHEN b.n > 1 AND b.second = b.score THEN 'ambiguous' WHEN b.n = 1 AND b.score >= 2 THEN 'exact' ELSE 'inferred' END AS resolution
  FROM signals s LEFT JOIN best b ON s.src = b.src AND s.kind = b.kind AND s.hint = b.hint)
"""
