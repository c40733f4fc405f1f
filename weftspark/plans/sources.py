"""Topics, spans, text functions, people and history over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import authorship, derive, history, spans, topics
from .views import ident, table


def x4_topics(spark, sf_dir):
    """Each event as a source line of its user's file, in functions of ten lines with one inside."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    call = F.when(F.col("event_id") % 2 == 0, "kafka.send('").otherwise("consumer.subscribe('")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_id"), place.alias("line"), F.concat(call, "event_type", F.lit("')")).alias("content"))
    blocks = lines.groupBy("file_id").agg(F.max("line").alias("n")).select("file_id", F.explode(F.expr("sequence(0, (n - 1) div 10)")).alias("k"))
    each = F.explode(F.expr("array(struct('outer' as part, 1 as a, 10 as b), struct('inner' as part, 3 as a, 7 as b))")).alias("f")
    functions = blocks.select("file_id", "k", each).select(F.concat_ws(":", "file_id", "f.part", "k").alias("span_id"), "file_id", (F.col("f.a") + 10 * F.col("k")).alias("start_line"), (F.col("f.b") + 10 * F.col("k")).alias("end_line"), F.col("k").alias("seq"))
    return topics.topic_edges(topics.line_calls(lines), functions).withColumn("line", F.col("line").cast("long"))


def x4_topic_nodes(spark, sf_dir):
    return topics.topic_nodes(x4_topics(spark, sf_dir))


def x9_ownership_share(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(ident("part", "l_partkey").alias("decl"), ident("person", "l_suppkey").alias("person"))
    return authorship.shares(line)


def x9_created_last_modified(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(ident("part", "l_partkey").alias("decl"), ident("person", "l_suppkey").alias("person"), F.expr("(l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey").alias("line"), F.col("l_shipdate").alias("time"))
    return authorship.created_modified(line)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn")


def x10_innermost_span(spark, sf_dir):
    t = _turns(spark, sf_dir)
    points = t.select(F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).alias("line"))
    ranges = t.select(F.concat_ws("/", "conv_id", "turn").alias("span_id"), F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).alias("start_line"), F.expr("turn + 1 + 2 * (turn % 3)").alias("end_line"), F.col("turn").alias("seq"))
    return spans.innermost(points, ranges)


def x11_next_edges(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return derive.next_statements(t.select(F.col("conv_id").alias("block"), F.col("turn").alias("position"), F.concat_ws("/", "conv_id", "turn").alias("node")))


def x19_person_identity(spark, sf_dir):
    mail = F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com ")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("n"), mail.alias("e"))
    return c.select("c_custkey", fn.person_id(F.col("n"), F.col("e")).alias("id"))


def x19_email_policy(spark, sf_dir):
    mail = F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", *(fn.stored_email(mail, p).alias(p) for p in ("plain", "hash", "none")))


def x20_status_kind(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.change_kind(F.substring("c_mktsegment", 1, 1)).alias("kind"))


def x20_commit_edges(spark, sf_dir):
    """Orders as commits by customers of their clerk's nation, that change suppliers' files."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    log = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("sha"), F.col("c_name").alias("author_name"), F.concat(F.col("c_custkey").cast("string"), F.lit("@a")).alias("author_email"),
        F.lit("bot").alias("committer_name"), F.expr("concat(case when c_acctbal > 0 then cast(c_custkey as string) else 'bot' end, '@a')").alias("committer_email"),
    )
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.expr("case l_returnflag when 'N' then 'M' else l_returnflag end").alias("status"), F.col("l_suppkey").cast("string").alias("path"), F.expr("case when l_returnflag = 'R' then 'old' else '' end").alias("renamed_from"))
    files = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(ident("file", "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("path"))
    return authorship.commit_edges(log, changes, files)


_PATH = r"://[^/?#]*/?([^?#]*)"


def x21_package_name(spark, sf_dir):
    spec = F.regexp_extract("url", _PATH, 1)
    p = table(spark, sf_dir, "pages").select("page_id", spec.alias("s"))
    return p.select("page_id", fn.package_name(F.col("s")).alias("plain"), fn.package_name(F.concat(F.lit("@"), "s")).alias("scoped"))


def x21_alias_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("s"))
    return p.select("page_id", fn.alias_capture(F.col("s"), F.lit("en/"), F.lit(".html"), F.lit(True)).alias("held"), fn.alias_capture(F.col("s"), F.lit("fr/"), F.lit(""), F.lit(True)).alias("rest"))


def x21_candidates(spark, sf_dir):
    """The first file that each path may mean, of those that there are."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("s"))
    asked = p.select("page_id", F.posexplode(fn.candidate_files(F.regexp_replace("s", "html$", "js"))).alias("rank", "path"))
    there = p.select(F.concat(F.regexp_replace("s", r"[./]?(html)?$", ""), F.lit(".ts")).alias("path")).distinct()
    return asked.join(there, "path").groupBy("page_id").agg(F.min_by("path", "rank").alias("path"))


def x22_http_path_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("s"))
    return p.select("page_id", fn.http_path(F.substring_index("s", "/", 1), F.expr("substr(s, 2 + length(substring_index(s, '/', 1)))")).alias("path"), fn.http_path(F.lit(" "), F.lit("")).alias("root"))


def x22_range_text(spark, sf_dir):
    """Orders as readings of a history: some have a range, some a limit, some lack one of both."""
    o = table(spark, sf_dir, "orders")
    commits, limit, rev = F.expr("case o_orderkey % 3 when 0 then concat(o_orderstatus, '..HEAD') when 1 then '' end"), F.expr("case when o_custkey % 4 > 0 then o_custkey % 4 - 1 end"), F.expr("if(o_orderkey % 5 > 0, o_orderpriority, null)")
    return o.select("o_orderkey", fn.range_text(commits, limit, rev).alias("told"))


def x22_host_names(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fn.hosts_in(u), ",").alias("hosts"), fn.before(F.regexp_extract(u, "://([^/?#]*)", 1), ".").alias("head"), fn.names_match(fn.before(F.regexp_extract(u, "://([^/?#]*)", 1), "."), F.lit("Blog")).alias("blog"))


def x23_hotspots(spark, sf_dir):
    return history.hotspots(table(spark, sf_dir, "lineitem").select(ident("part", "l_partkey").alias("decl"), F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("author")))


def x23_semantic_diff(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(ident("part", "l_partkey").alias("id"), "l_shipdate", "l_returnflag", "l_suppkey")
    version = lambda df: df.groupBy("id").agg(F.max("l_returnflag").alias("signature"), F.max("l_suppkey").alias("body"))
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    return history.semantic_diff(version(line.filter(F.col("l_shipdate") < cut)), version(line.filter(F.col("l_shipdate") >= cut)))


def x23_dependency_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    year = lambda y: orders.filter(F.year("o_orderdate") == y).select("o_custkey", "o_orderpriority")
    return history.dependency_diff(year(1996), year(1997))


def x23_as_of_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return history.as_of(history.validity(orders, ["o_custkey"], "o_orderkey"), F.lit(5000)).select("o_custkey", "o_orderkey", "o_totalprice", "valid_to")


def x23_renamed(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    ids = customer.select(F.concat(F.lit("app:f"), F.col("c_nationkey").cast("string"), F.lit("#"), "c_name").alias("id"))
    renames = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("app:f"), F.col("n_nationkey").cast("string")).alias("old_file"), F.concat(F.lit("app:"), "n_name").alias("new_file"))
    return history.renamed(ids, renames)


QUERIES = (x4_topics, x4_topic_nodes, x9_ownership_share, x9_created_last_modified, x10_innermost_span, x11_next_edges, x19_person_identity, x19_email_policy, x20_status_kind, x20_commit_edges, x21_package_name, x21_alias_match, x21_candidates, x22_http_path_join, x22_range_text, x22_host_names, x23_hotspots, x23_semantic_diff, x23_dependency_diff, x23_as_of_version, x23_renamed)

_TOPICS = """
WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_type, event_id % 2 AS odd FROM events),
t AS (
  SELECT DISTINCT CASE WHEN odd = 0 THEN 'PRODUCES' ELSE 'CONSUMES' END AS type,
         user_id || CASE WHEN (line - 1) % 10 BETWEEN 2 AND 6 THEN ':inner:' ELSE ':outer:' END || ((line - 1) // 10) AS src,
         'topic:kafka:' || event_type AS dst, line, 'inferred' AS resolution FROM l)
"""
_S = "regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)"
_MAIL = "CASE WHEN c_acctbal < 0 THEN '' ELSE lower(replace(c_name, '#', '.')) || '@example.com' END"

SQL = {
    "x4_topics": f"{_TOPICS} SELECT * FROM t",
    "x4_topic_nodes": f"{_TOPICS} SELECT DISTINCT dst AS id, 'Topic' AS type, 'kafka' AS broker, substr(dst, 13) AS name FROM t",
    "x9_ownership_share": "SELECT 'part:' || l_partkey AS decl, 'person:' || l_suppkey AS person, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY l_partkey) AS share FROM lineitem GROUP BY l_partkey, l_suppkey",
    "x9_created_last_modified": """
WITH l AS (SELECT *, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS line FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, line) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, line) AS b FROM l)
SELECT 'part:' || l_partkey AS decl, max(CASE WHEN a = 1 THEN 'person:' || l_suppkey END) AS created_by, max(CASE WHEN b = 1 THEN 'person:' || l_suppkey END) AS modified_by FROM r GROUP BY l_partkey""",
    "x10_innermost_span": """
SELECT DISTINCT file_id, line, span_id FROM (
  SELECT p.conv_id::VARCHAR AS file_id, p.turn + 1 AS line, s.conv_id || '/' || s.turn AS span_id, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY 2 * (s.turn % 3), s.turn) AS place
  FROM conversations p JOIN conversations s ON s.conv_id = p.conv_id AND p.turn BETWEEN s.turn AND s.turn + 2 * (s.turn % 3)) WHERE place = 1""",
    "x11_next_edges": "SELECT src, dst FROM (SELECT conv_id || '/' || turn AS src, lead(conv_id || '/' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL",
    "x19_person_identity": f"SELECT c_custkey, 'person:' || sha1(CASE WHEN c_acctbal < 0 THEN 'anon-' || c_name ELSE {_MAIL} END) AS id FROM customer",
    "x19_email_policy": f"SELECT c_custkey, {_MAIL} AS plain, CASE WHEN c_acctbal < 0 THEN '' ELSE 'sha256:' || sha256({_MAIL}) END AS hash, '' AS none FROM customer",
    "x20_status_kind": "SELECT c_custkey, CASE substr(c_mktsegment, 1, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' WHEN 'T' THEN 'type_changed' ELSE 'touched' END AS kind FROM customer",
    "x20_commit_edges": """
WITH o AS (SELECT o_orderkey, c_custkey, c_acctbal, c_name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'AUTHORED_BY' AS type, 'commit:' || o_orderkey AS src, 'person:' || sha1(c_custkey || '@a') AS dst, NULL::VARCHAR AS kind, NULL::VARCHAR AS member FROM o
UNION ALL SELECT 'COMMITTED_BY', 'commit:' || o_orderkey, 'person:' || sha1('bot@a'), NULL, NULL FROM o WHERE c_acctbal <= 0
UNION ALL SELECT 'CHANGED', 'commit:' || l_orderkey, 'file:' || l_suppkey, CASE l_returnflag WHEN 'N' THEN 'modified' WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' ELSE 'touched' END, CASE WHEN l_returnflag = 'R' THEN 'old' END
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND l_orderkey IN (SELECT o_orderkey FROM o)""",
    "x21_package_name": f"SELECT page_id, split_part({_S}, '/', 1) AS plain, '@' || split_part({_S}, '/', 1) || CASE WHEN instr({_S}, '/') > 0 THEN '/' || split_part({_S}, '/', 2) ELSE '' END AS scoped FROM pages",
    "x21_alias_match": f"SELECT page_id, CASE WHEN starts_with({_S}, 'en/') AND ends_with({_S}, '.html') AND length({_S}) >= 8 THEN substr({_S}, 4, length({_S}) - 8) END AS held, CASE WHEN starts_with({_S}, 'fr/') THEN substr({_S}, 4) END AS rest FROM pages",
    "x21_candidates": rf"""
WITH p AS (SELECT page_id, regexp_replace({_S}, 'html$', 'js') AS s FROM pages),
there AS (SELECT DISTINCT regexp_replace({_S}, '[./]?(html)?$', '') || '.ts' AS path FROM pages),
c AS (
  SELECT page_id, s AS path, 0 AS rank FROM p
  UNION ALL SELECT page_id, regexp_replace(s, '\.(jsx?|mjs|cjs)$', '') || e.x, e.i FROM p, (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs']) AS x, unnest([1, 2, 3, 4, 5, 6]) AS i) e WHERE regexp_matches(s, '\.(jsx?|mjs|cjs)$')
  UNION ALL SELECT page_id, s || e.x, e.i FROM p, (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs']) AS x, unnest([11, 12, 13, 14, 15, 16]) AS i) e
  UNION ALL SELECT page_id, s || '/index' || e.x, e.i FROM p, (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs']) AS x, unnest([21, 22, 23, 24, 25, 26]) AS i) e)
SELECT page_id, arg_min(path, rank) AS path FROM c JOIN there USING (path) GROUP BY page_id""",
    "x22_http_path_join": f"""
WITH p AS (SELECT page_id, split_part({_S}, '/', 1) AS a, substr({_S}, length(split_part({_S}, '/', 1)) + 2) AS b FROM pages)
SELECT page_id, coalesce(nullif(CASE WHEN a = '' THEN '' ELSE '/' || a END || CASE WHEN b = '' THEN '' WHEN starts_with(b, '/') THEN b ELSE '/' || b END, ''), '/') AS path, '/' AS root FROM p""",
    "x22_range_text": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '..HEAD' || CASE WHEN o_custkey % 4 > 1 THEN ' (limit ' || (o_custkey % 4 - 1) || ')' ELSE '' END
  ELSE 'rev=' || CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END || CASE WHEN o_custkey % 4 > 1 THEN ' limit=' || (o_custkey % 4 - 1) ELSE '' END END AS told FROM orders""",
    "x22_host_names": "SELECT page_id, array_to_string(regexp_extract_all(url, '(?i)(?:https?|wss|ws)://([a-z0-9][a-z0-9.-]*(?::\\d{2,5})?)', 1), ',') AS hosts, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS head, lower(split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1)) = 'blog' OR starts_with(split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1), 'blog-') AS blog FROM pages".replace("\\\\", "\\"),
    "x23_hotspots": "SELECT 'part:' || l_partkey AS decl, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY l_partkey ORDER BY commits DESC, authors DESC, decl LIMIT 20",
    "x23_semantic_diff": """
WITH o AS (SELECT l_partkey, max(l_returnflag) AS s, max(l_suppkey) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17' GROUP BY l_partkey),
n AS (SELECT l_partkey, max(l_returnflag) AS s, max(l_suppkey) AS b FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17' GROUP BY l_partkey),
j AS (SELECT 'part:' || coalesce(o.l_partkey, n.l_partkey) AS id, CASE WHEN o.l_partkey IS NULL THEN 'added' WHEN n.l_partkey IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'signature' WHEN o.b <> n.b THEN 'body' END AS change FROM o FULL JOIN n ON o.l_partkey = n.l_partkey)
SELECT * FROM j WHERE change IS NOT NULL""",
    "x23_dependency_diff": """
WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1997)
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "x23_as_of_version": "SELECT o_custkey, o_orderkey, o_totalprice, valid_to FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_to FROM orders) WHERE o_orderkey <= 5000 AND (valid_to IS NULL OR valid_to > 5000)",
    "x23_renamed": "SELECT CASE WHEN n_nationkey IS NULL THEN 'app:f' || c_nationkey ELSE 'app:' || n_name END || '#' || c_name AS id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1",
}
