"""Versions of a whole store, and applications put into it."""

import json
from pathlib import Path

import pytest

from weftspark.functions.text import range_text
from weftspark.model import EDGE_SCHEMA, Graph, graph_document
from weftspark.operators import manifest, store

NODE = "type string, id string, name string, kind string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def graph(spark, key, functions, edges=(), package="lodash", more=""):
    nodes = [("Application", f"app:{key}", key, None), *(("Function", f"{key}:a.js#{f}", f, "1") for f in functions), ("Package", "pkg:lodash", package, None)]
    df = spark.createDataFrame(nodes, NODE)
    if more:
        df = df.selectExpr("*", f"'{more}' as {more}")
    row = lambda kind, src, dst, idx, member, seq: (kind, src, dst, idx, None, member, None, None, None, None, seq)
    return Graph(df, spark.createDataFrame([row(*e) for e in edges], EDGE_SCHEMA))


def test_parts_and_columns_of_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert manifest.latest(spark, path) == manifest.Version() and manifest.read(spark, path, "t") is None
    one = manifest.commit(spark, path, manifest.Version(), {"t": {"a": spark.range(2), "b": spark.range(5, 6).selectExpr("id", "'x' as more")}, "u": {"": spark.range(1)}})
    assert manifest.latest(spark, path) == one
    assert rows(manifest.read(spark, path, "t")) == [(0, None), (1, None), (5, "x")] and rows(manifest.read(spark, path, "t", part="a")) == [(0, None), (1, None)]
    two = manifest.commit(spark, path, one, {"t": {"a": spark.range(0), "b": None}})
    assert rows(manifest.read(spark, path, "t")) == [] and rows(manifest.read(spark, path, "u")) == [(0,)]
    assert manifest.read(spark, path, "t", part="b") is None and len(rows(manifest.read(spark, path, "t", one))) == 3
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, path, one, {"u": {"": spark.range(9)}})
    with pytest.raises(ValueError, match="column id of t"):
        manifest.commit(spark, path, two, {"t": {"c": spark.range(1).selectExpr("cast(id as string) as id")}})
    assert manifest.latest(spark, path) == two


@pytest.mark.parametrize("at", range(4))
def test_a_failure_between_any_two_writes_leaves_the_old_whole(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "s")
    old = manifest.update(spark, path, lambda base: {t: {"": spark.range(1)} for t in ("nodes", "edges", "reviews")})
    steps, write, name = iter(range(9)), manifest._write, manifest._name

    def failing(real):
        def step(*args):
            if next(steps) == at:
                raise RuntimeError("lost")
            return real(*args)

        return step

    monkeypatch.setattr(manifest, "_write", failing(write))
    monkeypatch.setattr(manifest, "_name", failing(name))
    change = lambda base: {t: {"": spark.range(7)} for t in ("nodes", "edges", "reviews")}
    with pytest.raises(RuntimeError):
        manifest.update(spark, path, change)
    assert manifest.latest(spark, path) == old
    assert [manifest.read(spark, path, t).count() for t in ("nodes", "edges", "reviews")] == [1, 1, 1]
    manifest.update(spark, path, change)
    assert [manifest.read(spark, path, t).count() for t in ("nodes", "edges", "reviews")] == [7, 7, 7]


def test_a_writer_that_was_second_begins_anew(spark, tmp_path):
    path, seen = str(tmp_path / "s"), []

    def change(base):
        seen.append(base.number)
        if len(seen) == 1:
            manifest.update(spark, path, lambda other: {"t": {"": spark.range(3)}})
        had = manifest.read(spark, path, "t", base)
        return {"t": {"": spark.range(10, 11) if had is None else had.union(spark.range(10, 11))}}

    manifest.update(spark, path, change)
    assert seen == [0, 1] and rows(manifest.read(spark, path, "t")) == [(0,), (1,), (10,), (2,)]


def test_applications_share_nodes_and_keep_no_loose_edges(spark, tmp_path):
    path = str(tmp_path / "s")
    uses = [("CALLS", "a:a.js#f", "pkg:lodash", 1, "map", 1), ("CALLS", "a:a.js#f", "pkg:lodash", None, "", 2), ("CALLS", "a:a.js#f", "a:gone.js#g", None, None, 3), ("CALLS", "a:none", "a:a.js#f", None, None, 4)]
    store.save_app(spark, path, "a", graph(spark, "a", ["f"], uses))
    store.save_app(spark, path, "ab", graph(spark, "ab", ["f", "g", "g"], [("CALLS", "ab:a.js#g", "pkg:lodash", 2, "each", None)], None, "version"))
    whole = store.read_graph(spark, path)
    assert rows(whole.nodes.select("id", "name", "version")) == sorted([("a:a.js#f", "f", None), ("ab:a.js#f", "f", "version"), ("ab:a.js#g", "g", "version"), ("app:a", "a", None), ("app:ab", "ab", "version"), ("pkg:lodash", "lodash", "version")], key=str)
    assert rows(whole.edges.select("src", "dst", "idx", "member")) == [("a:a.js#f", "pkg:lodash", 1, "map"), ("ab:a.js#g", "pkg:lodash", 2, "each")]
    store.save_app(spark, path, "a", graph(spark, "a", ["h"], [("CALLS", "a:a.js#h", "pkg:lodash", None, None, 1)]))
    again = store.read_graph(spark, path)
    assert rows(again.nodes.select("id")) == [("a:a.js#h",), ("ab:a.js#f",), ("ab:a.js#g",), ("app:a",), ("app:ab",), ("pkg:lodash",)]
    assert rows(again.edges.select("src")) == [("a:a.js#h",), ("ab:a.js#g",)] and rows(store.read_graph(spark, path, "a").nodes.select("id")) == [("a:a.js#h",), ("app:a",)]
    with pytest.raises(ValueError):
        store.read_graph(spark, path, "b")


def test_a_graph_is_one_json_document(spark, tmp_path):
    g = graph(spark, "a", [f"f{i}" for i in range(40)], [("CALLS", f"a:a.js#f{i % 9}", "pkg:lodash", None, 'm"\n', 1) for i in range(30)])
    for i, told in enumerate((g, Graph(g.nodes.limit(0), g.edges.limit(0)))):
        graph_document(told).write.text(str(tmp_path / str(i)))
        parts = sorted(Path(tmp_path / str(i)).glob("part-*"))
        document = json.loads("".join(p.read_text() for p in parts))
        assert sorted(n["id"] for n in document["nodes"]) == sorted(r.id for r in told.nodes.collect())
        assert sorted((e["src"], e["member"]) for e in document["edges"]) == sorted((r.src, r.member) for r in told.edges.collect())


def test_the_first_application_takes_a_review(spark):
    reviews = spark.createDataFrame([("a:b:review:1", 1), ("a:review:2", 2), ("ab:review:3", 3), ("none", 4), ("a:", 5), (None, 6)], "id string, n int")
    apps = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, seq int")
    found = lambda a: {r.n: r.app_key for r in store.review_apps(reviews, a).collect()}
    assert found(apps("a", "a:b")) == {1: "a", 2: "a", 3: None, 4: None, 5: None, 6: None}
    assert found(apps("a:b", "a", "ab")) == {1: "a:b", 2: "a", 3: "ab", 4: None, 5: None, 6: None}


def test_ranges_in_words(spark):
    df = spark.createDataFrame([("a..b", 5, "HEAD"), ("a..b", 0, None), ("", 3, "main"), (None, None, None)], "c string, n int, r string")
    assert [r[0] for r in df.select(range_text(df.c, df.n, df.r)).collect()] == ["a..b (limit 5)", "a..b", "rev=main limit=3", "rev="]
