"""Questions about the stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of outside functions that send requests.
CLIENTS = ("fetch", "axios", "request", "got", "http")
#: Fixed value: the most rows that the audit tells.
MOST = 500


def unlinked_calls(contains: DataFrame, declares: DataFrame, calls: DataFrame, externals: DataFrame, requests: DataFrame, clients: tuple[str, ...] = CLIENTS, most: int | None = MOST) -> DataFrame:
    """(app_id, call_id, callee, file_id, start_line) of calls of clients by what a file of an application without any request declares.

    ``contains``: app_id, file_id; ``declares``: file_id, owner_id; ``calls``:
    call_id, owner_id, target_id, callee, call_file, start_line; ``externals``:
    target_id, name; ``requests``: app_id.  One row per way, the first ``most`` in
    order of app and call: a report.
    """
    silent = contains.join(requests.select("app_id").distinct(), "app_id", "left_anti")
    out = externals.filter(F.col("name").isin(*clients)).select("target_id")
    met = calls.join(out, "target_id").join(declares, "owner_id").join(silent, "file_id").select("app_id", "call_id", "callee", F.col("call_file").alias("file_id"), "start_line")
    return met if most is None else met.orderBy("app_id", "call_id").limit(most)


def audit(nodes: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """The same over a stored graph and the links of its applications."""
    of = lambda kind, src, dst: edges.filter(F.col("type") == kind).select(F.col("src").alias(src), F.col("dst").alias(dst))
    apps, files = (nodes.filter(F.col("type") == t).select("id") for t in ("Application", "File"))
    contains = of("CONTAINS", "app_id", "file_id").join(apps.withColumnRenamed("id", "app_id"), "app_id", "left_semi").join(files.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    told = nodes.filter("type = 'Call'").select(F.col("id").alias("call_id"), "owner_id", F.col("callee_text").alias("callee"), F.col("file_id").alias("call_file"), "start_line")
    calls = told.join(of("CALLS", "call_id", "target_id"), "call_id")
    externals = nodes.filter("type = 'External'").select(F.col("id").alias("target_id"), "name").distinct()
    return unlinked_calls(contains, of("DECLARES", "file_id", "owner_id"), calls, externals, requests.filter("type = 'REQUESTS'").select(F.col("src").alias("app_id")))


def call_sites(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS edges of ``functions`` (id)."""
    return edges.filter("type = 'CALLS'").join(functions.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def who_knows(owns: DataFrame, declarations: DataFrame, most: int = 3) -> DataFrame:
    """For each declaration the people of the largest shares."""
    w = W.partitionBy("dst").orderBy(F.desc("share"), "src")
    return owns.join(declarations.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def orphan_endpoints(endpoints: DataFrame, requests: DataFrame) -> DataFrame:
    """Endpoints of applications that nobody requests."""
    return endpoints.join(requests.select(F.col("dst").alias("app_id")).distinct(), "app_id", "left_anti")
