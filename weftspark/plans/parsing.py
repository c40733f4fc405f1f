"""Tokens and declarations of sources that are built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..parse import facts
from ..parse.tokens import tokens
from ..tables import joined_by_size, materialise
from .views import table


def x25_tokens(spark, sf_dir):
    """A call inside templates, up to six deep: where its name stands and how many brackets are around it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("cast(p_partkey % 7 as int)").alias("n"))
    content = F.concat(F.repeat(F.lit("`é${"), F.col("n")), F.lit("f"), F.col("k").cast("string"), F.lit("(a)"), F.repeat(F.lit("}`"), F.col("n")))
    told = tokens(part.select(F.col("k").cast("string").alias("file_id"), content.alias("content")))
    return told.filter("tok like 'f%'").select("file_id", "tok", "i", "line", "col", "level", "grp")


def _source(spark, sf_dir):
    """Each conversation as a file with a function a turn, in five forms."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = F.concat(F.lit("t"), F.col("turn").cast("string"))
    forms = ("const {n} = (a) => k(a)", "const {n} = a => k(a)", "const {n} = async (a): Promise<A.B> => {{ return k(a); }}", "const {n} = <T,>(a: T): A | B => k(a)", "function {n}(a): {{ x: A }} {{ return k(a); }}")
    text = F.lit("")
    for k, form in enumerate(forms):
        before, after = form.format(n="\u0001").split("\u0001")
        text = F.when(F.col("turn") % len(forms) == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(text)
    rows = F.array_sort(F.collect_list(F.struct("turn", text.alias("line"))))
    files = t.groupBy("conv_id").agg(rows.alias("rows"))
    return files.select(F.col("conv_id").cast("string").alias("file_id"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content"), F.lit("tsx").alias("language"))


def x25_functions(spark, sf_dir):
    """Functions of every form: name, kind, whether async, line, and the words of what they return."""
    with joined_by_size(spark):
        s = facts.read_source(_source(spark, sf_dir))
        classes = materialise(facts.holders(s), "holders")
        members, declared = materialise(facts.members(s, classes), "members"), materialise(facts.declarators(s), "declarators")
        found = materialise(facts.functions(s, classes, members, declared), "functions")
    return found.select("file_id", "name", "kind", "async", "line", F.coalesce(F.array_join("type_words", " "), F.lit("")).alias("returns"))


def x25_members(spark, sf_dir):
    """A class a supplier, with a static field, a private one, a getter, and a method that returns an object type."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_id"))
    text = F.concat(F.lit("export class C"), F.col("file_id"), F.lit(" extends B<X> implements I {\n  static a = 1;\n  private readonly b: Map<string, X> = new Map();\n  get v() { return this.b; }\n  m(x): { y: Z } { return x; }\n  go = async () => this.m(1);\n}\n"))
    source = facts.read_source(s.select("file_id", text.alias("content"), F.lit("typescript").alias("language")))
    classes = materialise(facts.holders(source), "holders")
    found = facts.members(source, classes).join(classes.select("file_id", F.col("i").alias("class_i"), F.col("name").alias("class")), ["file_id", "class_i"])
    return found.select("class", "name", "is_method", "mods.static", "mods.private", "mods.get", F.coalesce(F.array_join(F.transform("type", lambda x: x["tok"]), " "), F.lit("")).alias("type"))


QUERIES = (x25_tokens, x25_functions, x25_members)

SQL = {
    "x25_tokens": "SELECT p_partkey::VARCHAR AS file_id, 'f' || p_partkey AS tok, (3 * (p_partkey % 7) + 1)::INT AS i, 1 AS line, (5 * (p_partkey % 7) + 1)::INT AS col, (2 * (p_partkey % 7))::INT AS level, (3 * (p_partkey % 7))::INT AS grp FROM part",
    "x25_functions": """
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS line FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id::VARCHAR AS file_id, 't' || turn AS name, CASE WHEN turn % 5 = 4 THEN 'declaration' ELSE 'arrow' END AS kind, turn % 5 = 2 AS async, line,
       CASE turn % 5 WHEN 2 THEN 'Promise <A.B>' WHEN 3 THEN 'A | B' WHEN 4 THEN '{ }' ELSE '' END AS returns
FROM t""",
    "x25_members": """
SELECT 'C' || s_suppkey AS class, m.* FROM supplier CROSS JOIN (VALUES
  ('a', false, true, false, false, ''), ('b', false, false, true, false, 'Map <string, X>'), ('v', true, false, false, true, ''),
  ('m', true, false, false, false, '{ }'), ('go', false, false, false, false, '')) AS m(name, is_method, static, private, get, type)""",
}
