"""Changes and what they reach, on small graphs of our own."""

from weftspark import api
from weftspark.operators import history, impact
from weftspark.parse.tokens import tokens

STEPS = "type string, src string, dst string, resolution string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_surest_of_the_shortest_ways_counts_and_circles_end(spark):
    edges = spark.createDataFrame([("a", "b", "exact"), ("a", "c", "name_only"), ("b", "d", "inferred"), ("c", "d", "exact"), ("d", "a", "exact"), ("d", "e", "exact"), ("a", "b", "name_only")], "src string, dst string, resolution string")
    starts = spark.createDataFrame([("a",)], "start string")
    want = [("a", "b", 1, "exact"), ("a", "c", 1, "name_only"), ("a", "d", 2, "inferred"), ("a", "e", 3, "inferred")]
    assert rows(impact.sure_reach(edges, starts, None)) == want
    assert rows(impact.sure_reach(edges, starts, 5, spark.createDataFrame([("d",)], "node string"))) == want[:3]
    assert rows(impact.sure_reach(edges.limit(0), starts)) == []


def test_doubt_takes_all_tests(spark):
    files = spark.createDataFrame([(f"a:{p}", p) for p in ("src/x.js", "src/x.spec.ts", "src/__tests__/y.js", "z.test.js")], "id string, path string")
    edges = spark.createDataFrame([("CALLS", "a:src/x.spec.ts#t/1", "a:src/x.js#f", "exact"), ("READS", "a:z.test.js#t", "a:src/x.js#f", "exact")], STEPS)
    changed = spark.createDataFrame([("a:src/x.js#f",)], "id string")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(impact.affected_tests(changed, paths("src/x.js"), files, edges)) == [("src/x.spec.ts", "reached")]
    assert rows(impact.affected_tests(changed, paths("src/x.spec.ts"), files, edges)) == [("src/x.spec.ts", "changed")]
    everything = [(p, "doubt") for p in ("src/__tests__/y.js", "src/x.spec.ts", "z.test.js")]
    assert rows(impact.affected_tests(changed, paths("package.json"), files, edges)) == everything
    assert rows(impact.affected_tests(changed, paths("src/gone.js"), files, edges)) == everything
    by_name = edges.unionByName(spark.createDataFrame([("CALLS", "a:o#g", "a:src/x.js#f", "name_only")], STEPS))
    assert rows(impact.affected_tests(changed, paths("src/x.js"), files, by_name)) == everything


def test_hashes_tell_bodies_from_signatures(spark):
    texts = {
        "one": "function f(a: A, b: B) {\n  return a + b;\n}\n",
        "spaced": "\n// a comment\nfunction f(a: A,   b: B) {\n  /* b */\n\n  return a + b; // sum\n}\n",
        "body": "function f(a: A, b: B) {\n  return a - b;\n}\n",
        "optional": "function f(a: A, b?: B) {\n  return a + b;\n}\n",
    }
    files = spark.createDataFrame([(f"{n}.ts", "typescript", "h", bytearray(t.encode())) for n, t in texts.items()], "path string, language string, hash string, content binary")
    nodes = api.extract(spark, files, "app").nodes
    told = tokens(spark.createDataFrame([(f"app:{n}.ts", t) for n, t in texts.items()], "file_id string, content string"))
    bodies = dict(impact.body_hashes(told, nodes.filter("type = 'Function'")).collect())
    signatures = dict(impact.signature_hashes(nodes).collect())
    body, signature = ({n: found[f"app:{n}.ts#f"] for n in texts} for found in (bodies, signatures))
    assert body["spaced"] == body["one"] and signature["spaced"] == signature["one"]
    assert body["body"] != body["one"] and signature["body"] == signature["one"]
    assert signature["optional"] != signature["one"]


def test_moves_and_renames_are_told_last(spark):
    schema = "id string, signature string, body string, place int"
    old = spark.createDataFrame([("f#a", "s", "b", 1), ("f#b", "s", "b", 2), ("f#c", "s", "b", 3), ("g#d", "s", "b", 4), ("g#e", "s", None, 5)], schema)
    new = spark.createDataFrame([("h#a", "s", "b", 9), ("h#b", "s", "x", 2), ("g#d", "s", "b", 5), ("g#e", "s", None, 5), ("g#n", "s", "b", 1)], schema)
    renames = spark.createDataFrame([("f", "h")], "old_file string, new_file string")
    assert rows(history.semantic_diff(old, new, renames)) == [("g#d", "moved"), ("g#n", "added"), ("h#a", "renamed"), ("h#b", "body"), ("h#c", "removed")]
