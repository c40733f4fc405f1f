"""From source files to a stored graph, and from applications to their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .model import Graph
from .operators import authorship, derive, impact, signals, topics, xservice
from .operators import changes as changed
from .operators.link import link
from .parse.facts import parse
from .parse.tokens import tokens, unbalanced
from .sources.files import texts
from .tables import joined_by_size, materialise


def extract(spark: SparkSession, files: DataFrame, app_key: str, aliases: list[tuple] | None = None) -> Graph:
    """The graph of one application from ``files`` (path, language, hash, content in bytes).

    Files are taken in order of their path wherever the first or last of them wins.
    """
    with joined_by_size(spark):
        return _extracted(spark, files, app_key, aliases)


def _extracted(spark: SparkSession, files: DataFrame, app_key: str, aliases: list[tuple] | None) -> Graph:
    source = materialise(texts(files), "files")
    parts, own = parse(source, app_key)
    table = spark.createDataFrame([(app_key, *a) for a in aliases], "app_key string, prefix string, suffix string, wildcard boolean, target string, base_url string") if aliases else None
    more_nodes, linked = link(parts, app_key, table)
    nodes = materialise(parts.nodes.unionByName(more_nodes, allowMissingColumns=True), "nodes")
    edges = materialise(own.unionByName(linked, allowMissingColumns=True), "edges")
    calls = topics.scan_calls(source.select(F.concat(F.lit(f"{app_key}:"), "path").alias("file_id"), "content"))
    functions = nodes.filter("type = 'Function'").select(F.col("id").alias("span_id"), "file_id", "start_line", "end_line", F.lit(0).cast("long").alias("seq"))
    told = materialise(topics.topic_edges(calls, functions), "topics")
    app = nodes.filter("type = 'Application'").select("id", F.lit(app_key).alias("app_key"))
    shown = nodes.filter("type = 'Endpoint'").select(F.lit(app_key).alias("app_key"), "method", "path")
    reads = edges.filter("type = 'READS'").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("target_name")), "dst").select(F.lit(app_key).alias("app_key"), "target_name", "member")
    signalled = signals.with_signals(app, shown, reads, source.select(F.lit(app_key).alias("app_key"), "content"))
    nodes = nodes.join(signalled.drop("app_key"), "id", "left")
    graph = Graph(nodes, edges).add(topics.topic_nodes(told), told.select("type", "src", "dst", "resolution"))
    derived = [materialise(derived, "derived") for derived in (derive.invokes(graph.nodes, graph.edges), derive.flows(graph.nodes, graph.edges))]
    return graph.add(edges=derived[0]).add(edges=derived[1])


def failures(files: DataFrame) -> DataFrame:
    """(path, reason) of ``files`` (path, content in bytes) that parsing tells little or nothing of: no valid UTF-8, or brackets that don't close."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    broken = files.filter(~valid).select("path", F.lit("not UTF-8").alias("reason"))
    return broken.unionByName(unbalanced(texts(files.filter(valid))).select("path", F.lit("brackets do not close").alias("reason")))


def report(graph: Graph, files: DataFrame) -> DataFrame:
    """One row: files, failed (see :func:`failures`), nodes and edges of an extraction."""
    failed = failures(files).agg(F.countDistinct("path").alias("failed"))
    each = [files.agg(F.count(F.lit(1)).alias("files")), failed, *(df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("nodes", graph.nodes), ("edges", graph.edges)))]
    row = each[0].withColumn("one", F.lit(1))
    for other in each[1:]:
        row = row.join(other.withColumn("one", F.lit(1)), "one")
    return row.drop("one")


def declaration_hashes(graph: Graph, files: DataFrame, app_key: str) -> DataFrame:
    """(id, signature, body, whole) of a graph's declarations, from the ``files`` (path, content in bytes) that it was extracted from.

    ``whole`` hashes all that a declaration holds but its own name; ``body`` is the
    same, null where members are declarations of their own and tell what changed.
    """
    named = materialise(texts(files).withColumn("file_id", F.concat(F.lit(f"{app_key}:"), "path")), "files")
    declared = graph.nodes.filter(changed.is_declaration(graph.nodes))
    bodies = impact.body_hashes(tokens(named), declared.select("id", "name", "file_id", "start_line", "start_col", "end_line"), nameless=True)
    plain = F.sha2(F.concat_ws("|", "type", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("type_name", "exported", "static", "abstract", "readonly"))), 256)
    signatures = declared.select("id", "type", plain.alias("plain")).join(impact.signature_hashes(graph.nodes), "id", "left")
    own = F.when(~F.col("type").isin("Class", "Interface", "Enum"), F.col("body_hash"))
    return signatures.join(bodies, "id", "left").select("id", F.coalesce("signature_hash", "plain").alias("signature"), own.alias("body"), F.col("body_hash").alias("whole"))


def changes(spark: SparkSession, base: tuple[Graph, DataFrame], head: tuple[Graph, DataFrame], app_key: str, hunks: DataFrame) -> DataFrame:
    """What happened to each declaration between two extractions (graph and files each; see :func:`operators.changes.change_set`), with the files that ``hunks`` tell as renamed."""
    names = hunks.filter("status = 'R'").select(*(F.concat(F.lit(f"{app_key}:"), c).alias(n) for c, n in (("old_path", "old_file"), ("path", "new_file")))).distinct()
    hashes = [materialise(declaration_hashes(g, f, app_key), "hashes") for g, f in (base, head)]
    return changed.change_set(base[0], head[0], *hashes, names)


def with_history(graph: Graph, log: DataFrame, changes: DataFrame, policy: str = "plain") -> Graph:
    """Commits, people and changes of the files that are in the graph."""
    files = graph.nodes.filter("type = 'File'").select("id", "path")
    return graph.add(authorship.commit_nodes(log), authorship.commit_edges(log, changes, files)).add(authorship.people(log, policy))


def with_owners(graph: Graph, blame: DataFrame, app_key: str) -> Graph:
    """OWNS, CREATED and LAST_MODIFIED of declarations, by ``blame`` (path, line, author_name, author_email, author_time)."""
    lines = blame.select(F.concat(F.lit(f"{app_key}:"), "path").alias("file_id"), "line", fn.person_id(F.col("author_name"), F.col("author_email")).alias("person"), F.col("author_time").alias("time"))
    spans = authorship.ownable(graph.nodes).select(F.col("id").alias("span_id"), "file_id", "start_line", "end_line", F.lit(0).cast("long").alias("seq"))
    return graph.add(edges=authorship.ownership_edges(authorship.owned_lines(lines, spans)))


def link_services(applications: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """REQUESTS edges, reviews and the report for applications (key, name, host_candidates, env_vars_read)."""
    linked = materialise(xservice.links(applications), "linked")
    return xservice.request_edges(linked), xservice.reviews(linked), xservice.report(linked)
