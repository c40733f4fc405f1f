"""Small cases of the graph engine's operators."""

import subprocess

import pytest
from pyspark.sql import functions as F

from weftspark.functions import confidence
from weftspark.functions import text as fn
from weftspark import cli
from weftspark.operators import authorship, dedup, history, link, manifest, paths, spans, store, xservice
from weftspark.operators.link import resolve_modules
from weftspark.sources import config, git
from weftspark.sources.files import source_files
from weftspark.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_paths_and_names(spark):
    assert value(spark, fn.clean_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert value(spark, fn.http_path(F.lit("users/"), F.lit("/:id"))) == "/users/:id"
    assert value(spark, fn.http_path(F.lit(""), F.lit(""))) == "/"
    assert value(spark, fn.package_name(F.lit("@a/b/c"))) == "@a/b" and value(spark, fn.package_name(F.lit("x/y"))) == "x"
    assert value(spark, fn.topic_name(F.lit("https://q/1/mine"), F.lit("sqs"))) == "mine" and value(spark, fn.topic_name(F.lit("end/"), F.lit("sqs"))) == "end/"
    assert value(spark, fn.names_match(F.lit("Users_api"), F.lit("users"))) is True
    assert value(spark, fn.env_name(F.lit("env.DB.url"))) == "DB" and value(spark, fn.env_name(F.lit("env."))) is None
    assert value(spark, fn.readable(F.lit("src/.hidden.ts"))) and not value(spark, fn.readable(F.lit("node_modules/a.js"))) and not value(spark, fn.readable(F.lit("a.d.ts")))
    assert value(spark, confidence.weaker(F.lit("exact"), F.lit("ambiguous"))) == "exact"


def apps(spark, *rows):
    return spark.createDataFrame([(k, k, h, e) for k, h, e in rows], "key string, name string, host_candidates array<string>, env_vars_read array<string>")


def test_application_links(spark):
    exact = xservice.links(apps(spark, ("web", ["users:8080"], []), ("users", [], []))).collect()
    assert [(r.src, r.target, r.resolution) for r in exact] == [("web", "users", "exact")]
    tied = xservice.links(apps(spark, ("gw", ["users:1"], []), ("users", [], []), ("users-admin", [], [])))
    assert [(r.target, r.resolution) for r in tied.collect()] == [("users", "ambiguous")] and xservice.reviews(tied).first().status == "pending"
    none = xservice.report(xservice.links(apps(spark, ("a", ["stripe.com"], [])))).first()
    assert none.unmatched == 1
    env = xservice.links(apps(spark, ("a", [], ["USERS_URL"]), ("users", [], []))).first()
    assert (env.kind, env.score, env.resolution) == ("env", 1, "inferred")
    assert xservice.links(apps(spark, ("users", ["users:1"], []))).first().target is None


def test_innermost_and_ties(spark):
    s = spark.createDataFrame([("big", "f", 1, 200, 0), ("small", "f", 90, 100, 1), ("same", "f", 90, 100, 2), ("bad", "f", 5, 2, 3), ("none", "", 1, 9, 4)], "span_id string, file_id string, start_line int, end_line int, seq int")
    p = spark.createDataFrame([("f", 95), ("f", 150), ("f", 500)], "file_id string, line int")
    assert {(r.line, r.span_id) for r in spans.innermost(p, s).collect()} == {(95, "small"), (150, "big")}
    assert spans.innermost(p.unionByName(p), s).count() == 4  # repeated points stay
    r = spark.createDataFrame([(1, "f", 95, 97), (2, "f", 80, 120)], "range_id int, file_id string, first_line int, last_line int")
    assert {(x.range_id, x.span_id) for x in spans.overlapping(r, s).collect()} == {(1, "small"), (2, "small"), (2, "big")}


def test_ordered_dedup(spark):
    e = spark.createDataFrame([("READS", "a", "b", None, 2, "y"), ("READS", "a", "b", None, 1, "x"), ("READS", "a", "b", 7, 3, "z")], "type string, src string, dst string, loc int, seq int, member string")
    assert sorted(r.member for r in dedup.edge_set(e).collect()) == ["x", "z"]
    assert dedup.merge_properties(e, ["src"], ["loc", "member"]).first().asDict() == {"src": "a", "loc": 7, "member": "z"}


def test_ancestors_of_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id int, parent int")
    found = paths.ancestors(chain)
    assert found.filter("id = 299").count() == 300 and found.filter("id = 299 and ancestor = 0 and depth = 299").count() == 1


def test_heritage_is_depth_first_of_any_height(spark):
    members = spark.createDataFrame([("A2", "m", "A2.m"), ("B", "m", "B.m"), ("top", "far", "top.far"), ("C", "own", "C.own"), ("A1", "own", "A1.own")], "holder string, name string, node string")
    parents = [("C", "A1", 1), ("C", "B", 2), ("A1", "A2", 3), ("A2", "l0", 4)] + [(f"l{i}", f"l{i + 1}" if i < 59 else "top", 5) for i in range(60)] + [("B", "C", 6), ("l7", "l3", 7)]  # with two circles
    got = {(r.holder, r.name): r.member for r in link.inherited_members(members, spark.createDataFrame(parents, "id string, parent string, seq int")).collect()}
    assert got["C", "m"] == "A2.m" and got["C", "far"] == "top.far" and got["C", "own"] == "C.own" and got["B", "own"] == "C.own"


def test_exports_through_many_files(spark):
    n = 40
    files = spark.createDataFrame([(f"f{i}", "a", f"f{i}", f"s{i}") for i in range(n + 2)], "id string, app_key string, path string, scope string")
    exports = [(f"f{i}", "reexport", f"x{i}", f"x{i + 1}", None, f"f{i + 1}", 1) for i in range(n)] + [(f"f{n}", "local", f"x{n}", None, "found", None, 1), (f"f{n}", "reexport_all", None, None, None, f"f{n + 1}", 2), (f"f{n + 1}", "reexport_all", None, None, None, f"f{n}", 2)]
    exports = spark.createDataFrame(exports, "file_id string, kind string, name string, local string, node string, source string, seq long")
    modules = exports.filter("source is not null").select("file_id", "source", F.col("source").alias("target_file"), F.lit(None).cast("string").alias("package"))
    empty = lambda s: spark.createDataFrame([], s)
    parts = link.Parts(files, None, empty("scope string, name string, node string, seq long"), None, None, None, empty("file_id string, local string, imported string, source string, kind string, seq long"), exports)
    got = {(r.file_id, r.name): r.node for r in link.resolve_exports(parts, modules).collect()}
    assert got["f0", "x0"] == "found" and got[f"f{n + 1}", f"x{n}"] == "found" and len(got) == n + 2


def test_ownership_shares_and_ties(spark):
    lines = spark.createDataFrame([("d", "p", 1, 5), ("d", "p", 2, 5), ("d", "q", 3, 5)], "decl string, person string, line int, time int")
    assert {(r.person, round(r.share, 3)) for r in authorship.shares(lines).collect()} == {("p", 0.667), ("q", 0.333)}
    assert authorship.created_modified(lines).first()[1:] == ("p", "p")


def test_store_upserts(spark):
    old = spark.createDataFrame([("r1", "confirmed", "a")], "id string, status string, hint string")
    new = spark.createDataFrame([("r1", "pending", "b"), ("r2", "pending", "c")], "id string, status string, hint string")
    assert {tuple(r) for r in store.upsert_reviews(old, new).collect()} == {("r1", "confirmed", "b"), ("r2", "pending", "c")}
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "READS", "gone", "m", 1)], "src string, type string, dst string, member string, seq int")
    assert store.upsert_edges(edges, nodes, ["member"]).count() == 0


def test_versions(spark):
    v = history.validity(spark.createDataFrame([("k", 1), ("k", 5)], "k string, at int"), ["k"], "at")
    assert [(r["at"], r.valid_to) for r in history.as_of(v, F.lit(4)).collect()] == [(1, 5)]


def test_modules_and_aliases(spark):
    files = spark.createDataFrame([(f"a:{p}", "a", p) for p in ("src/x.ts", "src/lib/index.ts", "src/shared/log.ts")], "id string, app_key string, path string")
    asked = spark.createDataFrame([("a:src/x.ts", s) for s in ("./lib", "./x.js", "./none", "@shared/log", "react/dom")], "file_id string, source string")
    alias = spark.createDataFrame([("a", "@shared/", "", True, "shared/*", "src")], "app_key string, prefix string, suffix string, wildcard boolean, target string, base_url string")
    got = {r.source: (r.target_file, r.package) for r in resolve_modules(asked, files, alias).collect()}
    assert got == {"./lib": ("a:src/lib/index.ts", None), "./x.js": ("a:src/x.ts", None), "./none": (None, None), "@shared/log": ("a:src/shared/log.ts", None), "react/dom": (None, "react")}


def test_tsconfig():
    texts = {"tsconfig.json": '{ "extends": "./base", // own\n "compilerOptions": { "baseUrl": "lib", }, }', "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@s/*": ["shared/*"]}}}'}
    assert config.tsconfig_aliases(texts.get) == [("@s/", "", True, "shared/*", "src"), ("", "", True, "*", "lib")]
    with pytest.raises(ValueError):
        config.Authorship.of({"store_email": "what"})


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=Ann@x.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export function f() {\n  return 1;\n}\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "src/b.js").write_text("f();\n")
    run("add", "."), run("commit", "-qm", "two")
    return tmp_path


def test_git_sources(spark, repo):
    git.register(spark)
    load = lambda name, **o: spark.read.format(name).options(repo=str(repo), **o).load()
    local = {r.path: bytes(r.content) for r in source_files(spark, str(repo)).collect()}
    assert local == {r.path: bytes(r.content) for r in load("git_files").collect()}
    assert [r.path for r in load("git_files", rev="HEAD~1", subdir="src").collect()] == ["a.ts"]
    log = load("git_log").orderBy("pos").collect()
    assert [r.subject for r in log] == ["two", "one"]
    changes = load("git_changes")
    assert {(r.status, r.path) for r in changes.collect()} == {("A", "src/a.ts"), ("A", "src/b.js")}
    people = authorship.people(load("git_log"), "hash").collect()
    assert len(people) == 1 and people[0].email.startswith("sha256:")
    assert load("git_blame").count() == 4


def test_stream_parses_each_version_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ts").write_text("x")
    files = incremental.changed_files(spark, str(tmp_path / "in"))
    for _ in range(2):
        incremental.keep_parsed(files, lambda df: df.select("path", "hash"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_leaves_out_folders_and_known_versions(spark, tmp_path):
    for name in ("a.ts", "node_modules/b.ts"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    run = lambda: incremental.keep_parsed(incremental.changed_files(spark, str(tmp_path / "in")), lambda df: df.select("path", "hash"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    run()
    # The same version once more, under a new time: the source tells it, the cache knows it.
    (tmp_path / "in/c.ts").write_text("y")
    run()
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.ts", "c.ts"]


def test_yaml_section():
    text = "other:\n  enabled: false\nauthorship:  # who\n  enabled: true\n  store_email: 'hash'\n  commits_limit: 20 # last\n\nmore: 1\n"
    assert config.yaml_section(text, "authorship") == {"enabled": True, "store_email": "hash", "commits_limit": 20}
    assert config.load_authorship("/nowhere.yaml") == config.Authorship() and not config.Authorship().enabled


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three small applications, of which two tie for the host that the third calls."""
    base = tmp_path_factory.mktemp("apps")
    texts = {"web/src/a.ts": "import { base } from '@lib/base';\nexport function go() { return fetch('http://users:8080/x'); }\n", "web/src/lib/base.ts": "export const base = 1;\n", "web/tsconfig.json": '{ "compilerOptions": { "baseUrl": "src", "paths": { "@lib/*": ["lib/*"] } } } // own', "users/a.js": "function one() {}\n", "users-admin/a.js": "function two() {}\n", "quiet/a.js": "function ask() { axios.get('/x'); fetch('/y'); }\n"}
    for name, text in texts.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    graph = str(base / "graph")
    for app in ("web", "users", "users-admin", "quiet"):
        told = cli.extract(spark, cli.parser().parse_args(["extract", "--path", str(base / app), "--out", graph])).first()
        assert told.failed == 0 and told.files == (2 if app == "web" else 1)
    return graph


def test_commands(spark, stored, capsys):
    edges = store.read_graph(spark, stored, "web").edges
    assert edges.filter("type = 'IMPORTS' and dst = 'web:src/lib/base.ts'").count() == 1  # by tsconfig's alias
    told = cli.link(spark, stored).first()
    assert (told.ambiguous, told.exact) == (1, 0)
    requests, reviews = cli._stored(spark, stored)
    review = reviews.first()
    assert [(r.dst, r.resolution) for r in requests.collect()] == [("app:users", "ambiguous")] and review.status == "pending" and len(review.candidates) == 2
    cli.decide(spark, stored, review.id, "overridden", "users-admin")
    requests, reviews = cli._stored(spark, stored)
    assert [(r.dst, r.resolution) for r in requests.collect()] == [("app:users-admin", "overridden")] and reviews.first().status == "overridden"
    with pytest.raises(ValueError):
        cli.decide(spark, stored, review.id, "rejected")  # decided already
    with pytest.raises(ValueError):
        cli.decide(spark, stored, "nothing", "rejected")
    cli.link(spark, stored)
    requests, reviews = cli._stored(spark, stored)
    assert reviews.first().status == "overridden" and requests.count() == 1  # decisions outlive a new link
    found = {(r.app_id, r.callee, r.start_line) for r in cli.find_unlinked(spark, stored).collect()}
    assert found == {("app:quiet", "axios.get", 1), ("app:quiet", "fetch", 1)}


def test_reject_and_confirm(spark, stored, tmp_path):
    graph = f"{tmp_path}/graph"
    review = spark.createDataFrame([("a:review:1", "app:a", "REQUESTS", "app:b", "url:b:1", "pending", [])], cli.REVIEWS)
    request = spark.createDataFrame([("REQUESTS", "app:a", "app:b", "url", "b:1", "ambiguous")], cli.REQUESTS)
    manifest.update(spark, graph, lambda base: {"requests": {"": request}, "reviews": {"": review}})
    cli.decide(spark, graph, "a:review:1", "confirmed")
    assert cli._stored(spark, graph)[1].first().status == "confirmed"
    manifest.update(spark, graph, lambda base: {"reviews": {"": review}})
    cli.decide(spark, graph, "a:review:1", "rejected")
    requests, reviews = cli._stored(spark, graph)
    assert requests.count() == 0 and reviews.first().status == "rejected"


def test_scratch_link(spark, tmp_path):
    import json

    for key, hosts, envs in (("web", ["users:8080"], []), ("users", [], []), ("job", [], ["USERS_URL"])):
        (tmp_path / f"{key}.json").write_text(json.dumps({"nodes": [{"type": "File", "id": "x"}, {"type": "Application", "id": f"app:{key}", "key": key, "name": key, "hostCandidates": hosts, "envVarsRead": envs}], "edges": []}))
    edges, reviews, told = cli.scratch_link(spark, [str(tmp_path / f"{k}.json") for k in ("web", "users", "job")])
    assert {(r.src, r.dst, r.kind, r.resolution) for r in edges.collect()} == {("app:web", "app:users", "url", "exact"), ("app:job", "app:users", "env", "inferred")} and reviews.count() == 0


def test_pruned_before_reading(spark, tmp_path):
    for name in ("a.ts", "node_modules/x/b.js", ".hidden/c.js", "notes.txt", "d.d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = source_files(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["a.ts"]
    assert [git.is_source(x) for x in ("a/b.ts", "dist/b.ts", ".x/b.js", ".b.js", "b.d.ts", "b", "b.py")] == [True, False, False, True, False, False, False]
