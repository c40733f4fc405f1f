"""python -m weftspark.cli extract|link|review|confirm|override|reject|audit|scratch-link: the engine over paths."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.text import language_of
from .model import node_json
from .operators import audit, manifest, store
from .sources import git
from .sources.config import load_authorship, tsconfig_aliases
from .sources.files import read_graph_json, source_files
from .tables import materialise

REQUESTS = "type string, src string, dst string, kind string, member string, resolution string"
REVIEWS = "id string, call_id string, edge_type string, chosen_id string, hint string, status string, candidates array<struct<target:string,score:int,why:string>>"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftspark")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="one application's graph, as two Parquet tables")
    e.add_argument("--path", required=True)
    e.add_argument("--key", help="by default the last part of the subdir or path")
    e.add_argument("--out", required=True)
    e.add_argument("--rev", help="read a git revision instead of the folder")
    e.add_argument("--subdir", default="")
    e.add_argument("--config", help="YAML file with a section authorship")
    e.add_argument("--authorship", action=argparse.BooleanOptionalAction, default=None)
    e.add_argument("--store-email", choices=("plain", "hash", "none"))
    e.add_argument("--commits-limit", type=int)
    e.add_argument("--commits-range")
    e.add_argument("--json", help="a folder for the nodes as JSON lines too")
    for name, text in (("link", "link the applications of a graph"), ("review", "list the pending reviews"), ("audit", "calls of clients in applications without links"), ("confirm", "confirm a review"), ("override", "give a pending review's link another target"), ("reject", "reject a pending review and its link")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--graph", required=True)
        if name in ("confirm", "override", "reject"):
            c.add_argument("id")
        if name == "override":
            c.add_argument("target")
    s = sub.add_parser("scratch-link", help="link applications of graphs in JSON documents, without a store")
    s.add_argument("files", nargs="+")
    return p


def _read_text(a: argparse.Namespace, path: str) -> str | None:
    """A small file beside the sources, of the folder or the revision; None if it isn't there."""
    if a.rev:
        try:
            return git.git(a.path, "show", f"{a.rev}:{'/'.join(x for x in (a.subdir.strip('/'), path) if x)}").decode()
        except OSError:
            return None
    full = os.path.join(a.path, a.subdir, path)
    if not os.path.exists(full):
        return None
    with open(full, encoding="utf-8") as f:
        return f.read()


def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Write the graph; the report is returned."""
    key = a.key or (a.subdir or a.path).rstrip("/").rsplit("/", 1)[-1]
    how = load_authorship(os.path.join(a.path, a.config) if a.config else None, enabled=a.authorship, store_email=a.store_email, commits_limit=a.commits_limit, commits_range=a.commits_range)
    git.register(spark)
    load = lambda name, **o: spark.read.format(name).options(repo=a.path, subdir=a.subdir, **o).load()
    if a.rev:
        files = load("git_files", rev=a.rev).withColumn("language", language_of(F.col("path")))
    else:
        files = source_files(spark, f"{a.path}/{a.subdir}".rstrip("/"))
    files = materialise(files, "sources")
    graph = api.extract(spark, files, key, tsconfig_aliases(lambda path: _read_text(a, path)))
    told = api.report(graph, files)
    if how.enabled:
        options = {"rev": a.rev or "HEAD", "limit": str(how.commits_limit), "range": how.commits_range}
        graph = api.with_owners(api.with_history(graph, load("git_log", **options), load("git_changes", **options), how.store_email), load("git_blame", rev=a.rev or "HEAD"), key)
    unknown = [r.type for r in graph.unknown_types().limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown types {unknown}")
    if a.json:
        node_json(graph.nodes).write.mode("overwrite").text(a.json)
    store.save_app(spark, a.out, key, graph)
    return told


def _stored(spark: SparkSession, graph: str, version: manifest.Version | None = None) -> tuple[DataFrame, DataFrame]:
    """REQUESTS edges and reviews of a graph, empty where nothing was linked yet."""
    version = version or manifest.latest(spark, graph)
    tables = [(manifest.read(spark, graph, name, version), schema) for name, schema in (("requests", REQUESTS), ("reviews", REVIEWS))]
    return tuple(spark.createDataFrame([], schema) if df is None else df for df, schema in tables)


def link(spark: SparkSession, graph: str) -> DataFrame:
    """Link all applications anew; decided reviews keep their status.  Links and reviews change together.  The report is returned."""
    reports = []

    def change(base: manifest.Version) -> manifest.Changes:
        nodes = store.read_graph(spark, graph, version=base).nodes.filter("type = 'Application'")
        apps = materialise(nodes.select(F.substr("id", F.lit(len("app:") + 1)).alias("key"), "name", "host_candidates", "env_vars_read"), "applications")
        new_edges, new_reviews, told = api.link_services(apps)
        reports.append(told)
        edges, reviews = store.replace_links(*_stored(spark, graph, base), new_edges, new_reviews, apps)
        return {"requests": {"": edges}, "reviews": {"": reviews}}

    manifest.update(spark, graph, change)
    return reports[-1]


def decide(spark: SparkSession, graph: str, id_: str, status: str, target: str | None = None) -> None:
    """Confirm any review; override and reject pending ones only, with their link.  Link and review change together."""

    def change(base: manifest.Version) -> manifest.Changes:
        edges, reviews = _stored(spark, graph, base)
        decided = store.set_status(reviews, spark.createDataFrame([(id_, status)], "id string, status string"))
        if status == "confirmed":
            return {"reviews": {"": decided}}
        pair = store.pending(reviews, id_).select(F.col("call_id").alias("src"), F.col("chosen_id").alias("dst"))
        if status == "overridden":
            to = target if target.startswith("app:") else f"app:{target}"
            edges = store.retarget(edges, pair.withColumn("new_dst", F.lit(to)))
        else:
            edges = store.delete_requests(edges, pair)
        return {"requests": {"": edges.select(*(f.split()[0] for f in REQUESTS.split(", ")))}, "reviews": {"": decided}}

    manifest.update(spark, graph, change)


def find_unlinked(spark: SparkSession, graph: str) -> DataFrame:
    version = manifest.latest(spark, graph)
    found = store.read_graph(spark, graph, version=version)
    return audit.audit(found.nodes, found.edges, _stored(spark, graph, version)[0])


def scratch_link(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, reviews and report of applications that JSON documents tell."""
    none = F.array().cast("array<string>")
    apps = None
    for path in paths:
        rows = read_graph_json(spark, path)
        lists = (F.coalesce(F.col(c).cast("array<string>"), none) if c in rows.columns else none for c in ("hostCandidates", "envVarsRead"))
        one = rows.select("key", F.coalesce("name", "key").alias("name"), *(x.alias(n) for x, n in zip(lists, ("host_candidates", "env_vars_read"), strict=True)))
        apps = one if apps is None else apps.unionByName(one)
    return api.link_services(apps)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "extract":
        extract(spark, a).show()
    elif a.command == "link":
        link(spark, a.graph).show()
    elif a.command == "review":
        _stored(spark, a.graph)[1].filter("status = 'pending'").select("id", "hint", "chosen_id", "candidates").orderBy("id").show(truncate=False)
    elif a.command == "audit":
        find_unlinked(spark, a.graph).show(truncate=False)
    elif a.command == "scratch-link":
        for df in scratch_link(spark, a.files):
            df.show(truncate=False)
    else:
        decide(spark, a.graph, a.id, {"confirm": "confirmed", "override": "overridden", "reject": "rejected"}[a.command], getattr(a, "target", None))


if __name__ == "__main__":
    main()
