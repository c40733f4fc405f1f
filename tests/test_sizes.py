"""What larger tables need: nothing is gathered on the driver by a guess, and work that grows with the rows of the result."""

import random

from pyspark.sql import functions as F

from weftspark import api
from weftspark.operators import heirs, impact, link, symbols
from weftspark.parse import facts
from weftspark.parse.tokens import tokens
from weftspark.plans import parsing
from weftspark.tables import joined_by_size, materialise

LIMITS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def joins(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(word for word in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if word in plan)


def test_bodies_are_hashed_without_a_broadcast(spark, tmp_path):
    """However small the file of the texts, its tokens and declarations may be many."""
    spark.range(3000).selectExpr("concat('p', id) as file_id", "'function f(a) { return a; }' as content", "1 as start_line", "1 as start_col", "1 as end_line").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    found = impact.body_hashes(tokens(texts.select("file_id", "content")), texts.selectExpr("file_id as id", "file_id", "start_line", "start_col", "end_line"))
    assert joins(found) == "SortMergeJoin"
    assert found.count() == 3000 and found.select("body_hash").distinct().count() == 1


def test_written_tables_are_joined_by_their_rows(spark):
    """300,000 rows that a small file holds are not broadcast unmeasured; settings come back, also behind an error."""
    before = [spark.conf.get(x, None) for x in LIMITS]
    packed = materialise(spark.range(300_000).selectExpr("id as i", "'one text for all of them' as t"), "packed")
    assert joins(packed.join(packed.select("i"), "i")) == "BroadcastHashJoin"
    try:
        with joined_by_size(spark):
            assert joins(packed.join(packed.select("i"), "i")) == "SortMergeJoin"
            raise KeyError
    except KeyError:
        pass
    assert [spark.conf.get(x, None) for x in LIMITS] == before


def test_functions_are_found_by_measured_joins(spark, sf_dir, monkeypatch):
    seen, found = [], facts.functions
    monkeypatch.setattr(facts, "functions", lambda *x: seen.append(int(spark.conf.get(LIMITS[0]).rstrip("b"))) or found(*x))
    told = parsing.x25_functions(spark, sf_dir)
    assert seen == [(10 << 20) // 64] and joins(told) == ""


def graph(seed, n=40):
    """Parents of ids, random lower ones, and a circle of two: (id, parent, seq)."""
    rnd = random.Random(seed)
    rows = [(f"n{i}", f"n{rnd.randrange(i)}", k) for i in range(1, n) for k in range(rnd.randint(0, 3))]
    a, b = f"n{n * 3 // 4}", f"n{n * 5 // 6}"
    return rnd, [*rows, (a, b, -1), (b, a, 7)]


def test_members_handed_down_are_those_of_the_first_ways(spark):
    rnd, parents = graph(3)
    members = spark.createDataFrame([(f"n{i}", f"m{rnd.randrange(8)}", f"n{i}.{k}") for i in range(40) for k in range(rnd.randint(0, 2))], "holder string, name string, node string").dropDuplicates(["holder", "name"]).localCheckpoint()
    parents = spark.createDataFrame(parents, "id string, parent string, seq int")
    settled, left = heirs.handed_down(members.groupBy(F.col("holder").alias("id")).agg(F.expr("collect_list(struct(name, 0 as rank, node as value)) as held")), parents.filter("id <> parent").groupBy("id", "parent").agg(F.expr("min(seq) + 1 as every"), F.expr("cast(array() as array<struct<name:string,there:string,rank:int>>) as some")), few=0)
    assert left.count() and settled.count() > 10
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(link.inherited_members(members, parents, few=0)) == rows(link.inherited_members(members, parents))


def test_levels_are_settled_once(spark):
    """Work grows with what is held, not with the ways to all ancestors: of a ladder there are 2 to the 60."""
    parents = spark.createDataFrame([(i, i - k, k) for i in range(2, 60) for k in (1, 2)], "id long, parent long, seq int")
    members = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (1, "b", 1), (30, "b", 30)], "holder long, name string, node long")
    got = {(r.holder, r.name): r.member for r in link.inherited_members(members, parents, few=40).collect()}
    assert got == {(i, "a"): min(i, 1) for i in range(60)} | {(i, "b"): 1 if i < 30 else 30 for i in range(1, 60)}


def test_exports_handed_on_are_those_of_pairs(spark):
    """Stars, names passed on under others, a file of another's default, and circles of files."""
    rnd, stars = graph(11, 30)
    rows = [(f, "reexport_all", None, None, None, t, k) for f, t, k in stars if f != t]
    rows += [(f"n{i}", "local", x, None, f"n{i}.{x}", None, 20) for i in range(30) for x in rnd.sample(["a", "b", "c", "default"], rnd.randint(0, 1))]
    rows += [(f"n{rnd.randrange(30)}", "reexport", rnd.choice("abcdxyz"), rnd.choice([*"abcdxyz", "default", "*"]), None, f"n{rnd.randrange(30)}", 30 + i) for i in range(14)]
    exports = spark.createDataFrame(rows, "file_id string, kind string, name string, local string, node string, source string, seq long")
    files = spark.createDataFrame([(f"n{i}", "k", f"n{i}", f"s{i}") for i in range(30)], "id string, app_key string, path string, scope string")
    names = spark.createDataFrame([(f"s{i}", "top", f"n{i}.top", 1) for i in range(30)], "scope string, name string, node string, seq long")
    imports = spark.createDataFrame([], "file_id string, local string, imported string, source string, kind string, seq long")
    parts = link.Parts(files, None, names, None, None, None, imports, exports)
    modules = exports.filter("source is not null").select("file_id", "source", F.col("source").alias("target_file"), F.lit(None).cast("string").alias("package")).distinct()
    told = lambda few: sorted((tuple(str(x) for x in r) for r in symbols.resolve_symbols(parts, modules, few=few).select("file_id", "name", *symbols.FIELDS).collect()))
    want = told(1000)
    assert told(0) == want and told(5) == want and len(want) > 60


def test_an_extraction_joins_by_measured_sizes(spark, monkeypatch):
    """Inside, only what is measured small is broadcast; what follows from the graph is written, so that settings of the session can't gather it later."""
    seen, kept = [], api.materialise
    monkeypatch.setattr(api, "materialise", lambda df, name: seen.append((name, *(int(spark.conf.get(x).rstrip("b")) for x in LIMITS))) or kept(df, name))
    files = spark.createDataFrame([("a.js", "javascript", "", bytearray(b"function f(a) { return a; }\nfunction g(b) { return f(b); }\n"))], "path string, language string, hash string, content binary")
    graph = api.extract(spark, files, "k")
    assert {x[1:] for x in seen} == {((10 << 20) // 64, 10 << 20)} and [x[0] for x in seen].count("derived") == 2
    assert [tuple(r) for r in graph.edges.filter("type = 'INVOKES'").select("src", "dst").collect()] == [("k:a.js#g", "k:a.js#f")]
