"""What the streams of bracket groups say: declarations, statements, uses and modules.

Declarations are patterns of neighbours in a stream.  Every use belongs to the
innermost region around it (a function, a value that is assigned, returned,
thrown or handed over), which is a join of points with nested ranges.  Runs of
rows have any length: paths, lists and types are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.link import Parts
from ..operators.paths import ancestors
from ..operators.spans import innermost, within
from ..tables import materialise
from .tokens import NAME, streams, tokens

c = F.col
MODIFIERS = ("public", "private", "protected", "readonly", "static", "async", "override", "abstract", "declare", "get", "set", "accessor", "*")
#: Words that are never uses.
WORDS = ("if", "else", "for", "while", "do", "switch", "case", "default", "return", "throw", "try", "catch", "finally", "break", "continue", "function", "class", "interface", "enum", "const", "let", "var", "new", "typeof", "instanceof", "in", "of", "void", "delete", "await", "yield", "async", "import", "export", "from", "as", "extends", "implements", "null", "true", "false", "undefined", "static", "type", "declare", "satisfies", "keyof", "get", "set", "debugger", "with")
#: Words before a bracket that make it no call.
HEADS = ("if", "for", "while", "switch", "catch", "return", "throw", "case", "typeof", "await", "yield", "in", "of", "instanceof", "void", "delete", "else", "do", "function", "new", "async", "=>")
ASSIGNS = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
#: Types that stand for what they hold.
WRAPPERS = ("Promise", "Observable", "Array", "ReadonlyArray", "Partial", "Readonly", "Required")
PRIMITIVES = ("string", "number", "boolean", "any", "unknown", "void", "null", "undefined", "never", "object", "symbol", "bigint", "this", "true", "false", "keyof", "typeof", "readonly", "is", "asserts", "infer", "unique", "extends")
#: Fixed value: bytes of a text that a node keeps.
MOST_BYTES = 200
KEY = ["file_id", "grp", "seg"]
PART = [*KEY, "sub"]
_HEADS = rf"\b(?:{'|'.join(WRAPPERS)})<"


def _is_name(x: Column) -> Column:
    return x.rlike(NAME)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def cut_text(text: Column) -> Column:
    """The first bytes of a text; what is left of a character that is cut becomes a replacement sign."""
    return F.when(F.octet_length(text) <= MOST_BYTES, text).otherwise(F.make_valid_utf8(F.substring(text.cast("binary"), 1, MOST_BYTES).cast("string")))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _grouped(v: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, start, end and the tokens of each statement or part in order (i, tok, mate, deco)."""
    toks = F.array_sort(F.collect_list(F.struct("i", "tok", "mate", "deco")))
    return v.groupBy(*keys).agg(toks.alias("toks"), F.min("i").alias("start"), F.max("i").alias("end"))


def _core(toks: Column) -> Column:
    return F.filter(toks, lambda x: ~x["deco"])


def _place(toks: Column, test) -> Column:
    """Place in an array of the first token that passes ``test`` (of itself and the next)."""
    return F.get(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda k: F.coalesce(test(F.get(toks, k)["tok"], F.get(toks, k + 1)["tok"]), F.lit(False))), F.lit(0))


def _first(toks: Column, *signs: str) -> Column:
    """The first token (struct) that is one of ``signs``."""
    return F.get(F.filter(toks, lambda x: x["tok"].isin(*signs)), F.lit(0))


def _slice(toks: Column, after: Column, before: Column) -> Column:
    """Tokens behind place i ``after`` and before ``before`` (null: to the end)."""
    return F.filter(toks, lambda x: (x["i"] > after) & (before.isNull() | (x["i"] < before)))


def _text(toks: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(F.transform(toks, lambda x: x["tok"]), " "), r" ?([.\[\]<>()]) ?", "$1"))


@dataclass
class Source:
    """Tokens of files and their streams, statements and parts, all written."""

    t: DataFrame
    v: DataFrame
    segs: DataFrame
    parts: DataFrame


#: Behind these a brace belongs to a type, and what stands between a function's ``)`` and its ``=>`` is no type beyond those of ``_NO_TYPE``.
_TYPE_SIGNS = (":", "|", "&", "=>", "is", "<")
_NO_TYPE = ("=>", "=", "?", "&&", "||", "??", ",", ";", "return", "+", "-", "*", "/")
#: Before these, or first of all, a bracket that opens parameters may stand.
_BEFORE_FUNCTION = ("=", "(", ",", "=>", "return", "async", "default", ":", "[", "&&", "||", "??", "yield", "await", "export")


def _arrow_heads() -> dict[str, Column]:
    """For a ``=>``: head, the last ``)`` before it that a ``:`` follows, in its part, and where the last sign stands that no type holds.

    ``head``: place, place of its ``(``; ``no_type``: place; ``asks``: place of the first ``?``.  So a return type may be of any length.
    """
    before = W.partitionBy(*PART).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    head = F.last(F.when((c("tok") == ")") & (c("s1") == ":"), F.struct(c("i").alias("close"), c("mate").alias("open"))), ignorenulls=True).over(before)
    return {"head": head, "no_type": F.last(F.when(c("tok").isin(*_NO_TYPE), c("i")), ignorenulls=True).over(before), "asks": F.first(F.when(c("tok") == "?", c("i")), ignorenulls=True).over(before)}


#: What ``declare`` may stand before.
_AMBIENT = ("class", "abstract", "function", "async", "const", "let", "var", "enum", "interface", "type", "module", "namespace", "global")


def _without_ambient(v: DataFrame) -> DataFrame:
    """Streams without statements that only declare what is somewhere else, and all that is inside of them."""
    w = W.partitionBy(*KEY).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    words = [F.nth_value("tok", k).over(w) for k in (1, 2, 3)]
    ambient = ((words[0] == "declare") & words[1].isin(*_AMBIENT)) | ((words[0] == "export") & (words[1] == "declare") & words[2].isin(*_AMBIENT))
    v = materialise(v.withColumn("ambient", F.coalesce(ambient, F.lit(False))), "streams")
    spans = v.filter("ambient").groupBy(*KEY).agg(F.min("i").alias("a"), F.max("i").alias("b")).select("file_id", "a", "b")
    return v.drop("ambient").alias("v").join(spans.alias("s"), (c("v.file_id") == c("s.file_id")) & c("v.i").between(c("s.a"), c("s.b")), "left_anti")


def read_source(named: DataFrame) -> Source:
    t = materialise(tokens(named), "tokens")
    v = _without_ambient(streams(t))
    w = W.partitionBy("file_id", "grp").orderBy("i")
    back = W.partitionBy(*KEY).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, -1)
    # A brace behind a sign of a type is a type's; the next one may be a body.
    body = (c("tok") == "{") & ~F.coalesce(c("q1").isin(*_TYPE_SIGNS), F.lit(False))
    later = {name: F.last(F.when(test, c("i")), ignorenulls=True).over(back) for name, test in (("next_brace", c("tok") == "{"), ("next_body", body), ("next_paren", c("tok") == "("))}
    lag = {"m1": F.lag("mate").over(w), "q_i": F.lag("i").over(w), "q2_i": F.lag("i", 2).over(w)} | _arrow_heads()
    v = v.withColumns(later | lag).withColumn("sub_end", F.max("i").over(W.partitionBy(*PART))).withColumn("seg_end", F.max("i").over(W.partitionBy(*KEY)))
    # Postfix runs: a name and what hangs on it.
    generic = c("q1").startswith("<") & (F.length("q1") > 2) & F.coalesce(_is_name(c("q2")) | c("q2").isin(")", "]"), F.lit(False))
    call = (c("tok") == "(") & (_is_name(c("q1")) | c("q1").isin(")", "]") | generic) & (~c("q1").isin(*HEADS) | c("q2").isin(".", "?."))
    hangs = c("tok").isin(".", "?.", ")", "]") | c("q1").isin(".", "?.") | call | ((c("tok") == "[") & (_is_name(c("q1")) & ~c("q1").isin(*WORDS) | c("q1").isin(")", "]"))) | (c("tok").startswith("<") & (F.length("tok") > 2)) | ((c("tok") == "!") & c("s1").isin(".", "?."))
    v = v.withColumns({"call": F.coalesce(call, F.lit(False)), "run": F.sum(F.when(F.coalesce(hangs, F.lit(False)) & c("q1").isNotNull(), 0).otherwise(1)).over(w)})
    v = materialise(v, "streams")
    return Source(t, v, materialise(_grouped(v, KEY), "statements"), materialise(_grouped(v, PART), "parts"))


def holders(s: Source) -> DataFrame:
    """Classes, interfaces and enums: file_id, i, kind, name, body, body_end, grp, seg, heritage (tokens between name and body)."""
    word = s.v.filter(c("tok").isin("class", "interface", "enum") & ~F.coalesce(c("q1"), F.lit("")).isin(".", "?.") & c("next_brace").isNotNull() & (_is_name(c("s1")) | ((c("tok") == "class") & (c("s1") == "{"))))
    ends = s.v.select("file_id", c("i").alias("next_brace"), c("mate").alias("body_end"))
    assigned = F.when(c("q1") == "=", c("q2")).when((c("q1") == "default") | ((c("q1") == "abstract") & (c("q2") == "default")), F.lit("default"))
    name = F.when(_is_name(c("s1")) & ~c("s1").isin("extends", "implements"), c("s1")).otherwise(assigned)
    found = word.join(ends, ["file_id", "next_brace"]).select(*KEY, "i", "line", "col", F.initcap("tok").alias("kind"), name.alias("name"), c("next_brace").alias("body"), "body_end")
    told = found.join(s.segs.select(*KEY, "toks"), KEY)
    exported = F.exists(_slice(c("toks"), F.lit(0), c("i")), lambda x: x["tok"] == "export")
    return told.select(*found.columns, _slice(_core(c("toks")), c("i") + 1, c("body")).alias("heritage"), exported.alias("exported"), F.exists(_slice(c("toks"), F.lit(0), c("i")), lambda x: x["tok"] == "abstract").alias("abstract")).filter("name is not null")


def members(s: Source, classes: DataFrame) -> DataFrame:
    """Members of classes and interfaces: file_id, class_i, name, start (i), is_method, open, body, body_end, type (tokens), eq (i of =), end, modifiers, keys of the statement."""
    bodies = classes.filter("kind in ('Class', 'Interface')").select("file_id", c("body").alias("grp"), c("i").alias("class_i"))
    # Members of interfaces may end with commas.
    kinds = classes.select("file_id", c("body").alias("grp"), c("kind").alias("class_kind"))
    rows = s.parts.join(bodies, ["file_id", "grp"]).join(kinds, ["file_id", "grp"]).withColumn("core", F.filter(_core(c("toks")), lambda x: ~x["tok"].isin(",", ";")))
    stops = ("(", "=", ":", "?", "!")
    at = _place(c("core"), lambda x, n: (_is_name(x) | x.rlike(r"^['\"]")) & (~x.isin(*MODIFIERS) | n.isNull() | n.isin(*stops)))
    rows = rows.filter(F.size("core") > 0).withColumn("at", at).filter("at is not null")
    behind = F.slice("core", c("at") + 2, F.size("core"))
    rows = rows.withColumn("behind", behind)
    generic = F.coalesce(F.get("behind", F.lit(0))["tok"].startswith("<"), F.lit(False))
    nxt = F.when(generic, F.get("behind", F.lit(1))).otherwise(F.get("behind", F.lit(0)))
    eq = _first(c("behind"), "=")
    is_body = lambda k: (F.get("behind", k)["tok"] == "{") & ~F.coalesce(F.get("behind", k - 1)["tok"].isin(*_TYPE_SIGNS), F.lit(False))
    body = F.get("behind", F.get(F.filter(F.when(F.size("behind") > 0, F.sequence(F.lit(0), F.size("behind") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.when(k > 0, is_body(k)).otherwise(F.get("behind", k)["tok"] == "{")), F.lit(0)))
    rows = rows.withColumns({"nxt": nxt, "eq": eq["i"], "colon": _first(c("behind"), ":")["i"]})
    is_method = F.coalesce(c("nxt")["tok"] == "(", F.lit(False))
    body = F.when(is_method, body)
    name = F.regexp_replace(F.get("core", c("at"))["tok"], r"^['\"]|['\"]$", "")
    told = rows.withColumns({"is_method": is_method, "body": body["i"], "body_end": body["mate"]})
    kind = _slice(c("behind"), c("colon"), F.when(c("is_method"), c("body")).otherwise(c("eq")))
    has = lambda m: F.exists(F.slice("core", F.lit(1), c("at")), lambda x: x["tok"] == m)
    mods = {m: has(m) for m in ("static", "readonly", "private", "protected", "abstract", "override", "async", "get", "set")}
    optional = F.exists("behind", lambda x: x["tok"] == "?") & ~is_method
    return told.select(
        *PART, "class_i", "class_kind", name.alias("name"), F.get("core", F.lit(0))["i"].alias("i"), "is_method", F.when(c("is_method"), c("nxt")["i"]).alias("open"), F.when(c("is_method"), c("nxt")["mate"]).alias("params_end"),
        "body", "body_end", F.when(c("colon").isNotNull() & (c("eq").isNull() | (c("colon") < c("eq")) | c("is_method")), kind).alias("type"), F.when(~c("is_method"), c("eq")).alias("eq"), "end", F.struct(*(v.alias(k) for k, v in mods.items())).alias("mods"), optional.alias("optional"),
    )


def declarators(s: Source) -> DataFrame:
    """Parts of const, let and var: PART, word, name (null for a pattern), pattern (i of its bracket), at, eq, type (tokens), end, exported, value (first token behind =), source (of a require)."""
    first = s.segs.withColumn("core", F.filter(_core(c("toks")), lambda x: ~x["tok"].isin("export", "declare")))
    word = F.get("core", F.lit(0))["tok"]
    some = first.filter(word.isin("const", "let", "var") & ~F.coalesce(F.get("core", F.lit(1))["tok"] == "enum", F.lit(False))).select(*KEY, word.alias("word"), F.coalesce(F.get("toks", F.lit(0))["tok"] == "export", F.lit(False)).alias("exported"))
    rows = s.parts.join(some, KEY).withColumn("core", F.filter(_core(c("toks")), lambda x: ~x["tok"].isin("export", "declare", "const", "let", "var", ",", ";"))).filter(F.size("core") > 0)
    head = F.get("core", F.lit(0))
    eq, of = _first(c("core"), "="), _first(c("core"), "of", "in")
    rows = rows.withColumns({"head": head, "eq": eq["i"], "of": F.when(eq["i"].isNull(), of["i"]), "colon": _first(c("core"), ":")["i"]})
    value = F.transform(_slice(c("core"), F.coalesce("eq", F.lit(1 << 30)), F.lit(None)), lambda x: x["tok"])
    kind = F.when(c("colon").isNotNull() & (c("eq").isNull() | (c("colon") < c("eq"))), _slice(c("core"), c("colon"), F.coalesce("eq", "of")))
    required = F.when(F.array_join(value, " ") == "require ( )", F.get(_slice(c("core"), c("eq"), F.lit(None)), F.lit(1))["i"])
    return rows.select(
        *PART, "word", "exported", F.when(_is_name(c("head")["tok"]), c("head")["tok"]).alias("name"), F.when(c("head")["tok"].isin("{", "["), c("head")["i"]).alias("pattern"), c("head")["i"].alias("i"),
        "eq", "of", kind.alias("type"), "end", F.get(value, F.lit(0)).alias("value"), required.alias("required"),
    )


def functions(s: Source, classes: DataFrame, ms: DataFrame, ds: DataFrame) -> DataFrame:
    """file_id, i, name (null: none), kind, open, params_end, single (i of an only parameter without brackets), body, body_end, class_i, type, flags, keys."""
    v = s.v
    mates = v.filter("mate is not null").select("file_id", c("i").alias("b"), c("mate").alias("b_end"))
    # Words: function name? ( ) { }
    word = v.filter((c("tok") == "function") & ~F.coalesce(c("q1").isin(".", "?."), F.lit(False)) & c("next_body").isNotNull() & c("next_paren").isNotNull())
    own = F.when(_is_name(c("s1")), c("s1")).when((c("s1") == "*") & _is_name(c("s2")), c("s2"))
    is_async = F.coalesce(c("q1") == "async", F.lit(False))
    # What is exported by default without a name is called so.
    by_default = lambda q1, q2: F.coalesce((q1 == "default") | (is_async & (q2 == "default")), F.lit(False))
    word = word.select(*PART, F.when(is_async, c("q_i")).otherwise(c("i")).alias("i"), F.coalesce(own, F.when(by_default(c("q1"), c("q2")), F.lit("default"))).alias("name"), own.isNotNull().alias("own_name"), by_default(c("q1"), c("q2")).alias("by_default"), F.lit("function").alias("kind"), c("next_paren").alias("open"), c("next_body").alias("b"), F.lit(None).cast("int").alias("single"), is_async.alias("async"), (c("q1").isin("=") | (is_async & (c("q2") == "="))).alias("assigned"))
    word = word.join(mates, ["file_id", "b"]).select(*[x for x in word.columns if x != "b"], c("b").alias("body"), c("b_end").alias("body_end"))
    # Arrows: ( ) => or name =>, with a type of any length before the arrow perhaps.
    opens = v.filter("tok = '('").select("file_id", c("i").alias("head_open"), F.coalesce(c("q1").isin(*_BEFORE_FUNCTION) | (c("q1").startswith("<") & (F.length("q1") > 2)), c("q1").isNull()).alias("may_begin"))
    arrow = v.filter("tok = '=>'").withColumn("head_open", c("head.open")).join(opens, ["file_id", "head_open"], "left")
    free = c("no_type").isNull() | (c("no_type") < c("head.close"))
    typed = F.coalesce(c("may_begin") & free & (c("asks").isNull() | (c("asks") > c("head_open"))), F.lit(False))
    opened = F.when(typed, c("head_open")).when(c("q1") == ")", c("m1"))
    arrow = arrow.withColumns({"typed": typed, "open": opened}).withColumn("single", F.when(c("open").isNull() & _is_name(c("q1")), c("q_i"))).filter("open is not null or single is not null")
    arrow = arrow.select(*PART, c("i").alias("arrow"), "open", "single", F.when(c("s1") == "{", c("s_i")).alias("b"), "sub_end", F.when(c("typed"), c("head.close") + 1).alias("colon"))
    words = s.parts.select(*PART, c("toks").alias("part_toks"))
    arrow = arrow.join(words, PART).withColumn("type_words", F.when(c("colon").isNotNull(), F.transform(_slice(c("part_toks"), c("colon"), c("arrow")), lambda x: x["tok"]))).drop("part_toks")
    begins = v.select("file_id", c("i").alias("begin"), c("q1").alias("bq1"), c("q2").alias("bq2"), c("q3").alias("bq3"), c("q_i").alias("bq_i"), c("q2_i").alias("bq2_i"))
    arrow = arrow.withColumn("begin", F.coalesce("open", "single")).join(begins, ["file_id", "begin"]).join(mates, ["file_id", "b"], "left")
    # Type parameters stand before the bracket: what precedes them is one further back.
    generic = F.coalesce(c("open").isNotNull() & c("bq1").startswith("<") & (F.length("bq1") > 2), F.lit(False))
    arrow = arrow.withColumns({"begin": F.when(generic, c("bq_i")).otherwise(c("begin")), "bq_i": F.when(generic, c("bq2_i")).otherwise(c("bq_i")), "bq1": F.when(generic, c("bq2")).otherwise(c("bq1")), "bq2": F.when(generic, c("bq3")).otherwise(c("bq2"))})
    is_async = F.coalesce(c("bq1") == "async", F.lit(False))
    # An expression's body begins at the arrow itself: so the arrow is the last that tells no use.
    arrow = arrow.select(*PART, F.when(is_async, c("bq_i")).otherwise(c("begin")).alias("i"), F.when(by_default(c("bq1"), c("bq2")), F.lit("default")).alias("name"), F.lit(False).alias("own_name"), by_default(c("bq1"), c("bq2")).alias("by_default"), F.lit("arrow").alias("kind"), "open", "single", F.coalesce("b", "arrow").alias("body"), F.coalesce("b_end", "sub_end").alias("body_end"), is_async.alias("async"), ((c("bq1") == "=") | (is_async & (c("bq2") == "="))).alias("assigned"), "type_words")
    both = word.unionByName(arrow, allowMissingColumns=True)
    # What is assigned to a variable or a field of a class takes its name.
    given = ds.filter("name is not null and eq is not null").select(*PART, c("name").alias("given"), c("exported").alias("given_exported"), c("eq").alias("eq_d"), F.lit("variable").alias("by"), _none("int").alias("class_i"), _none("string").alias("class_kind"))
    given = given.unionByName(ms.filter("not is_method and eq is not null and class_kind = 'Class'").select(*PART, c("name").alias("given"), F.lit(False).alias("given_exported"), c("eq").alias("eq_d"), F.lit("field").alias("by"), "class_i", "class_kind"))
    both = both.join(given, PART, "left").withColumn("takes", F.coalesce(c("assigned") & (c("i") > c("eq_d")) & (c("i") - c("eq_d") <= 1), F.lit(False)))
    exported = F.exists(_slice(c("toks"), F.lit(0), c("i")), lambda x: x["tok"] == "export")
    both = both.join(s.segs.select(*KEY, "toks"), KEY).withColumn("exported", F.when(c("takes"), c("given_exported")).otherwise(c("by_default") | ((c("kind") == "function") & exported & (c("name").isNotNull()))))
    # A function word at the beginning of its statement declares its name.
    lead = F.filter(_core(c("toks")), lambda x: ~x["tok"].isin("export", "default", "async", "declare"))
    declares = (c("kind") == "function") & c("own_name") & F.coalesce(F.get(lead, F.lit(0))["tok"] == "function", F.lit(False)) & (F.get(lead, F.lit(0))["i"] - c("i") <= 1)
    colon = F.when(c("kind") == "function", _first(_slice(c("toks"), c("open"), c("body")), ":")["i"])
    # The colon is a column of its own: inside of another lambda it would not be found.
    both = both.withColumn("colon", colon)
    words = F.transform(_slice(c("toks"), c("colon"), c("body")), lambda x: x["tok"])
    both = both.select(
        *PART, "i", F.when(c("takes"), c("given")).otherwise(c("name")).alias("name"), F.when(c("takes") & (c("by") == "field"), "method").when(declares, "declaration").when(c("kind") == "arrow", "arrow").otherwise("expression").alias("kind"),
        "open", "single", "body", "body_end", F.when(c("takes") & (c("by") == "field"), c("class_i")).alias("class_i"), F.coalesce("type_words", F.when(c("colon").isNotNull(), words)).alias("type_words"), "async", "exported", F.coalesce(c("takes"), F.lit(False)).alias("takes"), declares.alias("declares"),
    )
    kind = F.when(c("name") == "constructor", "constructor").when(c("mods.get"), "getter").when(c("mods.set"), "setter").otherwise("method")
    methods = ms.filter("is_method").select(*PART, "i", "name", kind.alias("kind"), "open", _none("int").alias("single"), "body", "body_end", "class_i", F.when(c("type").isNotNull(), F.transform("type", lambda x: x["tok"])).alias("type_words"), c("mods.async").alias("async"), F.lit(False).alias("exported"), F.lit(True).alias("takes"), F.lit(False).alias("declares"), "mods")
    places = v.select("file_id", "i", "line", "col")
    closes = v.filter("tok = '('").select("file_id", c("i").alias("open"), c("mate").alias("params_end"))
    return both.unionByName(methods, allowMissingColumns=True).join(places, ["file_id", "i"]).join(closes, ["file_id", "open"], "left")


def type_refs(df: DataFrame, words: str, edge: str, inferred: bool = False) -> DataFrame:
    """(src, edge, scope, name, path, idx, inferred, seq) of ``df`` (src, scope, seq and an array of type tokens).

    Wrappers stand for what they hold; arguments of other types are HAS_TYPE_ARG with their place.
    """
    every = df.filter(F.size(words) > 0).select("src", "scope", "seq", F.posexplode(words).alias("k", "tok"), c(words).alias("all"))
    generic = F.get("all", c("k") + 1)
    args = F.when(generic.startswith("<") & (F.length(generic) > 2), generic)
    prev = F.get("all", c("k") - 1)
    heads = every.filter(_is_name(c("tok")) & ((c("k") == 0) | ~F.coalesce(prev.isin(".", "typeof", "keyof"), F.lit(False)))).withColumn("args", args)
    # A.B.C: the names behind dots.
    dotted = F.aggregate(F.slice("all", c("k") + 2, F.size("all")), F.struct(F.lit("").alias("s"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & ((x == ".") | a["s"].endswith(".")), F.concat(a["s"], x)).otherwise(a["s"]).alias("s"), (a["on"] & ((x == ".") | a["s"].endswith("."))).alias("on")), lambda a: a["s"])
    heads = heads.withColumn("whole", F.concat("tok", F.regexp_replace(dotted, r"[.\s]+$", "")))
    wraps = c("tok").isin(*WRAPPERS) & c("args").isNotNull()
    inner = F.regexp_replace(F.expr("substr(args, 2)"), _HEADS, "")
    held = F.when(wraps, F.regexp_extract_all(F.regexp_extract(inner, r"^([^<,]*)", 1), F.lit(r"[\w$.]+"), 0)).otherwise(F.array("whole"))
    rest = F.when(wraps, F.regexp_extract(inner, r"^[^<]*<(.*)$", 1)).otherwise(F.coalesce(inner, F.lit("")))
    told = heads.select("src", "scope", "seq", F.explode(held).alias("n"), F.lit(edge).alias("edge"), _none("int").alias("idx"))
    pieces = heads.select("src", "scope", "seq", F.posexplode(F.split(rest, ",")).alias("idx", "piece")).select("src", "scope", "seq", F.explode(F.regexp_extract_all("piece", F.lit(r"(?<![\w$.'\"])[A-Za-z_$][\w$.]*"), 0)).alias("n"), F.lit("HAS_TYPE_ARG").alias("edge"), c("idx").cast("int").alias("idx"))
    names = F.split("n", r"\.")
    return told.unionByName(pieces).filter(~c("n").isin(*PRIMITIVES, "") & ~c("n").rlike("^[0-9]")).select("src", "edge", "scope", F.get(names, F.lit(0)).alias("name"), F.slice(names, F.lit(2), F.size(names)).alias("path"), "idx", F.lit(inferred).alias("inferred"), "seq")


def decorators(s: Source) -> DataFrame:
    """file_id, keys, i, end, name, arg (first string among arguments), text."""
    at = s.v.filter("tok = '@'").select(*PART, "i", "run", c("s1").alias("name"))
    # The run behind the sign: names, dots and the arguments' brackets.
    runs = s.v.filter("deco").select("file_id", "grp", "run", c("i").alias("j"), "tok", "mate", "q1").filter("tok <> '@'")
    first = s.v.filter("q1 = '@'").select("file_id", c("q_i").alias("i"), c("run").alias("r"))
    held = at.join(first, ["file_id", "i"]).join(runs.withColumnRenamed("run", "r"), ["file_id", "grp", "r"])
    whole = held.groupBy(*PART, "i", "name").agg(F.max("j").alias("end"), F.min(F.when(c("tok") == "(", c("j"))).alias("open"))
    strings = s.v.filter(c("tok").rlike(r"^['\"`]")).groupBy("file_id", c("grp").alias("open")).agg(F.min_by("tok", "i").alias("arg"))
    told = whole.join(strings, ["file_id", "open"], "left").withColumn("arg", F.coalesce(F.regexp_extract("arg", r"(?s)^.(.*).$", 1), F.lit("")))
    spaced = within(s.t.select("file_id", c("i").alias("line"), "tok"), told.select("file_id", c("i").alias("span_id"), (c("i") + 1).alias("start_line"), c("end").alias("end_line")))
    texts = spaced.groupBy("file_id", c("span_id").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "tok"))), lambda x: x["tok"]), "").alias("text"))
    return told.join(texts, ["file_id", "i"])


def parse(files: DataFrame, app_key: str) -> tuple[Parts, DataFrame]:
    """Parts for linking, and the edges that files tell alone, of ``files`` (path, language, hash, content as text)."""
    named = files.withColumn("file_id", F.concat(F.lit(f"{app_key}:"), "path"))
    s = read_source(named)
    classes = materialise(holders(s), "holders")
    ms, ds = materialise(members(s, classes), "members"), materialise(declarators(s), "declarators")
    fs = materialise(functions(s, classes, ms, ds), "functions")
    return _Facts(named, app_key, s, classes, ms, ds, fs).told()


class _Facts:
    """Puts findings together: owners and names, then calls, statements and uses, then rows for linking."""

    def __init__(self, named: DataFrame, app_key: str, s: Source, classes: DataFrame, ms: DataFrame, ds: DataFrame, fs: DataFrame) -> None:
        self.named, self.app_key, self.s, self.classes, self.ms, self.ds, self.fs = named, app_key, s, classes, ms, ds, fs
        self.deco = materialise(decorators(s), "decorators")
        self._groups()
        self._owners()
        self.banned = materialise(self._banned(), "banned")
        self._declared()
        self._calls()
        self._statements()
        self._uses()

    def _groups(self) -> None:
        """Parts that declare: parameters, patterns; and what no use can be in."""
        s, fs = self.s, self.fs
        opens = fs.filter("open is not null").select("file_id", c("open").alias("grp"), c("i").alias("fi"), "kind", "class_i")
        rows = s.parts.join(opens, ["file_id", "grp"]).withColumn("core", F.filter(_core(c("toks")), lambda x: x["tok"] != ",")).filter(F.size("core") > 0)
        rows = rows.withColumn("at", _place(c("core"), lambda x, n: (_is_name(x) & (~x.isin(*MODIFIERS) | n.isNull() | n.isin("=", ":", "?"))) | x.isin("{", "["))).filter("at is not null")
        head, eq, colon = F.get("core", c("at")), _first(c("core"), "=")["i"], _first(c("core"), ":")["i"]
        rows = rows.withColumns({"head": head, "eq": eq, "colon": F.when(eq.isNull() | (colon < eq), colon)})
        has = lambda m: F.exists(F.slice("core", F.lit(1), c("at")), lambda x: x["tok"] == m)
        kind = F.when(c("colon").isNotNull(), F.transform(_slice(c("core"), c("colon"), c("eq")), lambda x: x["tok"]))
        params = rows.select(
            *PART, "fi", "class_i", c("kind").alias("f_kind"), c("start").alias("i"), F.when(_is_name(c("head")["tok"]), c("head")["tok"]).alias("name"), F.when(c("head")["tok"].isin("{", "["), c("head")["i"]).alias("pattern"),
            has("...").alias("variadic"), c("eq").isNotNull().alias("has_default"), F.coalesce(F.get("core", c("at") + 1)["tok"] == "?", F.lit(False)).alias("optional"), has("readonly").alias("readonly"), has("private").alias("private"), has("protected").alias("protected"), has("public").alias("public"), kind.alias("type_words"), "eq", "end", F.lit(False).alias("single"),
        )
        single = fs.filter("single is not null").select(*PART, c("i").alias("fi"), "class_i", c("kind").alias("f_kind"), c("single").alias("i"))
        single = single.join(s.v.select("file_id", "i", c("tok").alias("name")), ["file_id", "i"]).withColumns({k: F.lit(False) for k in ("variadic", "has_default", "optional", "readonly", "private", "protected", "public")} | {"single": F.lit(True)})
        self.params = materialise(params.unionByName(single, allowMissingColumns=True).filter("name is null or name <> 'this'").withColumn("idx", F.row_number().over(W.partitionBy("file_id", "fi").orderBy("i")) - 1), "parameters")
        # Patterns: names that are taken out of what is assigned or handed over, with the key or place that they come from.
        catches = s.v.filter("tok = '(' and q1 = 'catch' and q2 = '}'").select("file_id", c("i").alias("grp"))
        caught = s.v.join(catches, ["file_id", "grp"]).filter(c("q1").isNull()).select(*PART, "i", F.when(_is_name(c("tok")), c("tok")).alias("name"), F.when(c("tok").isin("{", "["), c("i")).alias("pattern"))
        self.caught = materialise(caught, "caught")
        roots = [self.ds.select("file_id", c("pattern").alias("grp"), F.lit("variable").alias("by"), c("i").alias("by_i")), self.params.select("file_id", c("pattern").alias("grp"), F.lit("parameter").alias("by"), c("i").alias("by_i")), self.caught.select("file_id", c("pattern").alias("grp"), F.lit("catch").alias("by"), c("i").alias("by_i"))]
        now, found = _union(roots).filter("grp is not null"), []
        while True:
            bracket = s.v.select("file_id", c("i").alias("grp"), c("tok").alias("bracket"))
            p = s.parts.join(now, ["file_id", "grp"]).join(bracket, ["file_id", "grp"]).withColumn("core", F.filter(c("toks"), lambda x: ~x["tok"].isin(",", "...")))
            p = p.filter(F.size("core") > 0).withColumns({"eq": _first(c("core"), "=")["i"], "colon": F.when(c("bracket") == "{", _first(c("core"), ":")["i"])})
            p = p.withColumn("target", F.when(c("colon").isNotNull() & (c("eq").isNull() | (c("colon") < c("eq"))), F.get(_slice(c("core"), c("colon"), F.lit(None)), F.lit(0))).otherwise(F.get("core", F.lit(0))))
            member = F.when(c("bracket") == "{", F.get("core", F.lit(0))["tok"]).otherwise(c("sub").cast("string"))
            p = materialise(p.select(*PART, "by", "by_i", c("target")["i"].alias("i"), F.when(_is_name(c("target")["tok"]), c("target")["tok"]).alias("name"), F.when(c("target")["tok"].isin("{", "["), c("target")["i"]).alias("pattern"), member.alias("member"), "start", "eq", "end"), "patterns")
            found.append(p)
            now = p.filter("pattern is not null").select("file_id", c("pattern").alias("grp"), "by", "by_i")
            if now.isEmpty():
                break
        self.taken = _union(found)

    def _owners(self) -> None:
        """Functions and classes around each place, and qualified names along them."""
        inside = self.fs.select("file_id", c("i").alias("span_id"), F.when(c("open").isNotNull(), c("open") + 1).otherwise(c("body")).alias("start_line"), c("body_end").alias("end_line"), F.lit(0).alias("seq"))
        inside = inside.filter("end_line is not null")
        bodies = self.classes.select("file_id", c("i").alias("span_id"), c("body").alias("start_line"), c("body_end").alias("end_line"), F.lit(1).alias("seq"))
        self.owning = materialise(inside.unionByName(bodies), "owning")
        line = lambda df: df.select("file_id", c("i").alias("line")).distinct()
        around = innermost(line(self.fs), self.owning).select("file_id", c("line").alias("i"), c("span_id").alias("parent"))
        held = self.fs.join(around, ["file_id", "i"], "left").withColumn("parent", F.coalesce("class_i", "parent"))
        places = self.s.v.select("file_id", "i", "line", "col")
        f = held.join(places.select("file_id", "i", c("line").alias("l"), c("col").alias("k")), ["file_id", "i"]).select("file_id", "i", F.coalesce("name", F.concat(F.lit("fn@"), "l", F.lit(":"), "k")).alias("name"), "parent")
        up = innermost(line(self.classes), self.owning).select("file_id", c("line").alias("i"), c("span_id").alias("parent"))
        h = self.classes.join(up, ["file_id", "i"], "left").select("file_id", "i", "name", "parent")
        key = lambda x: F.concat("file_id", F.lit("|"), x)
        both = materialise(f.unionByName(h).withColumns({"id": key(c("i")), "up": F.when(c("parent").isNotNull(), key(c("parent")))}), "owners")
        closure = ancestors(both.select("id", c("up").alias("parent")))
        names = closure.join(both.select(c("id").alias("ancestor"), "name"), "ancestor").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-c("depth")).alias("d"), "name"))).alias("n"))
        self.quals = materialise(both.join(names, "id").select("file_id", "i", "name", "parent", F.array_join(F.transform("n", lambda x: x["name"]), ".").alias("qual")), "quals")

    def _placed(self, df: DataFrame) -> DataFrame:
        """``df`` (file_id, i) with parent, the innermost function or class, and its qualified name."""
        at = innermost(df.select("file_id", c("i").alias("line")).distinct(), self.owning).select("file_id", c("line").alias("i"), c("span_id").alias("parent"))
        own = self.quals.select("file_id", c("i").alias("parent"), c("qual").alias("owner_qual"))
        return df.join(at, ["file_id", "i"], "left").join(own, ["file_id", "parent"], "left")

    def _declared(self) -> None:
        """All declarations with ids: file_id, i, type, name, id, owner (i), flags."""
        text = lambda x: F.when(F.size(x) > 0, F.regexp_replace(F.array_join(x, " "), r" ?([.<>\[\]]) ?", "$1"))
        f = self.quals.join(self.fs.select("file_id", "i", c("kind").alias("node_kind"), "async", "exported", "mods", "type_words", "body_end", "class_i"), ["file_id", "i"])
        f = f.select("file_id", "i", F.lit("Function").alias("type"), "name", "qual", "parent", "node_kind", "async", "exported", *(F.coalesce(c("mods")[m], F.lit(False)).alias(m) for m in ("static", "abstract", "override", "private", "protected")), text(c("type_words")).alias("type_name"), c("body_end").alias("end"), "class_i")
        h = self.quals.join(self.classes.select("file_id", "i", c("kind").alias("type"), "exported", "abstract", c("body_end").alias("end")), ["file_id", "i"]).select("file_id", "i", "type", "name", "qual", "parent", "exported", "abstract", "end")
        fields = self.ms.filter("not is_method and name is not null").join(self.fs.filter("takes").select(*PART, F.lit(True).alias("fn")).distinct(), PART, "left").filter("fn is null")
        own = self.quals.select("file_id", c("i").alias("class_i"), c("qual").alias("class_qual"))
        fields = fields.join(own, ["file_id", "class_i"]).select("file_id", "i", F.lit("Field").alias("type"), "name", F.concat("class_qual", F.lit("."), "name").alias("qual"), c("class_i").alias("parent"), *(c(f"mods.{m}").alias(m) for m in ("static", "readonly", "private", "protected", "abstract")), "optional", text(F.transform("type", lambda x: x["tok"])).alias("type_name"), "end", "class_i")
        properties = self.params.filter("f_kind = 'constructor' and (readonly or private or protected or public) and name is not null").join(own, ["file_id", "class_i"])
        properties = properties.select("file_id", "i", F.lit("Field").alias("type"), "name", F.concat("class_qual", F.lit("."), "name").alias("qual"), c("class_i").alias("parent"), "readonly", "private", "protected", "optional", text(c("type_words")).alias("type_name"), "end", "class_i", F.lit(True).alias("property"))
        taken_by_function = self.fs.filter("takes").select(*PART, F.lit(True).alias("fn")).distinct()
        plain = self.ds.filter("name is not null and required is null").join(taken_by_function, PART, "left").filter("fn is null and not coalesce(value = 'class', false)")
        v = plain.select("file_id", "i", "name", F.when(c("of").isNotNull(), "loop").otherwise(c("word")).alias("node_kind"), "exported", text(F.transform("type", lambda x: x["tok"])).alias("type_name"), "end")
        required = self.ds.filter("required is not null").select("file_id", c("i").alias("by_i"))
        parts = self.taken.filter("name is not null").join(required, ["file_id", "by_i"], "left_anti")
        words = self.ds.select("file_id", c("i").alias("by_i"), "word", "of", "exported")
        v = v.unionByName(parts.filter("by = 'variable'").join(words, ["file_id", "by_i"]).select("file_id", "i", "name", F.when(c("of").isNotNull(), "loop").otherwise(c("word")).alias("node_kind"), "exported", "end"), allowMissingColumns=True)
        v = v.unionByName(self.caught.filter("name is not null").select("file_id", "i", "name", F.lit("catch").alias("node_kind"), F.lit(False).alias("exported"), c("i").alias("end")).unionByName(parts.filter("by = 'catch'").select("file_id", "i", "name", F.lit("catch").alias("node_kind"), F.lit(False).alias("exported"), "end")), allowMissingColumns=True)
        v = self._placed(v).withColumns({"type": F.lit("Variable"), "qual": F.concat_ws(".", "owner_qual", "name")}).drop("owner_qual")
        enums = self.classes.filter("kind = 'Enum'").select("file_id", c("body").alias("grp"), c("i").alias("class_i")).join(own, ["file_id", "class_i"])
        e = self.s.parts.join(enums, ["file_id", "grp"]).withColumn("core", F.filter(c("toks"), lambda x: x["tok"] != ",")).filter(F.size("core") > 0)
        name = F.regexp_replace(F.get("core", F.lit(0))["tok"], r"^['\"]|['\"]$", "")
        e = e.select("file_id", c("start").alias("i"), F.lit("EnumMember").alias("type"), name.alias("name"), F.concat("class_qual", F.lit("."), name).alias("qual"), c("class_i").alias("parent"), F.array_join(F.transform(F.slice("core", F.lit(3), F.size("core")), lambda x: x["tok"]), "").alias("value"), "end", "class_i")
        every = _union([f, h, fields, properties, v, e])
        places = self.s.t.select("file_id", "i", "line", "col")
        every = every.join(places, ["file_id", "i"]).join(places.select("file_id", c("i").alias("end"), c("line").alias("end_line")), ["file_id", "end"], "left")
        self.decls = materialise(_unique(every, F.concat("file_id", F.lit("#"), "qual")), "declared")
        owner = self.decls.filter(c("type").isin("Function", "Class", "Interface", "Enum")).select("file_id", c("i").alias("owner_i"), c("id").alias("owner_id"), c("qual").alias("owner_name"))
        self.owner_ids = materialise(owner, "owner-ids")
        p = self.params.join(owner, (self.params.file_id == owner.file_id) & (self.params.fi == owner.owner_i)).drop(owner.file_id)
        # A pattern is named by its text.
        shape = self.taken.filter("by = 'parameter'").groupBy("file_id", c("by_i").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.coalesce("name", F.lit("")).alias("n")))), lambda x: x["n"]), ", ").alias("shape"))
        p = p.join(shape, ["file_id", "i"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("{ "), "shape", F.lit(" }")), F.lit("{}")))
        p = p.join(places, ["file_id", "i"]).withColumn("type_name", text(c("type_words")))
        self.parameters = materialise(_unique(p, F.concat("owner_id", F.lit("("), "name", F.lit(")"))), "parameter-ids")

    def _owner_of(self, df: DataFrame) -> DataFrame:
        """``df`` (file_id, i) with the owner's id and the beginning of ids under it."""
        placed = self._placed(df).drop("owner_qual").join(self.owner_ids.withColumnRenamed("owner_i", "parent"), ["file_id", "parent"], "left")
        return placed.withColumns({"under": F.concat("file_id", F.lit("#"), F.coalesce("owner_name", F.lit(""))), "owner": F.coalesce("owner_id", "file_id")}).drop("owner_id", "owner_name", "parent")

    def _banned(self) -> DataFrame:
        """PART, a, b: stretches of the streams that declare or tell types and modules: nothing in them is a use."""
        big, s = F.lit(1 << 30), self.s
        row = lambda df, a, b: df.select(*PART, a.alias("a"), b.alias("b"))
        before = lambda eq, end: F.coalesce(eq - 1, end)
        out = [row(self.params.filter("grp is not null and not single"), F.lit(0), before(c("eq"), big)), row(self.taken, F.lit(0), before(c("eq"), big)), row(self.ds, F.lit(0), F.coalesce("eq", "of", big)), row(self.caught, F.lit(0), big)]
        out += [row(self.ms, F.lit(0), before(c("eq"), big)), row(self.fs.filter("body is not null"), c("i"), c("body"))]
        out.append(row(self.fs.filter("single is not null"), c("single"), c("single")))
        out.append(row(s.parts.select(*PART).join(self.classes.select(*KEY, "i", "body"), KEY), c("i"), c("body")))
        enums = self.classes.filter("kind = 'Enum'").select("file_id", c("body").alias("grp"))
        out.append(row(s.parts.join(enums, ["file_id", "grp"]), F.lit(0), before(_first(c("toks"), "=")["i"], big)))
        first = F.get(_core(c("toks")), F.lit(0))["tok"]
        second = F.get(_core(c("toks")), F.lit(1))["tok"]
        told = s.segs.withColumns({"first": first, "second": second})
        alias = F.coalesce((c("first") == "type") & _is_name(c("second")), F.lit(False)) | F.coalesce((c("first") == "export") & (c("second") == "type"), F.lit(False))
        modules = told.filter(((c("first") == "import") & ~F.coalesce(c("second").isin("(", "."), F.lit(False))) | ((c("first") == "export") & c("second").isin("{", "*")) | alias).select(*KEY, "toks")
        out.append(row(s.parts.select(*PART).join(modules.select(*KEY), KEY), F.lit(0), big))
        lists = modules.select("file_id", F.explode(F.filter("toks", lambda x: x["tok"].isin("{", "("))["i"]).alias("grp"))
        out.append(row(s.parts.select(*PART).join(lists, ["file_id", "grp"]), F.lit(0), big))
        return _union(out)

    def _calls(self) -> None:
        """Runs of names and calls, with what is banned left out: the first path of each, and all calls."""
        s = self.s
        v = s.v
        first = v.filter(_is_name(c("tok")) & (~c("tok").isin(*WORDS) | (c("s1") == "(") & c("tok").isin("get", "set", "of", "type", "from"))).select(*PART, "run", "i", "tok", "q1", "q2", "q_i", "s1", "deco", "line", "col").filter(~F.coalesce(c("q1").isin(".", "?."), F.lit(False)))
        group = v.filter(c("tok").isin("{", "(", "[")).select("file_id", c("i").alias("grp"), c("tok").alias("bracket"), c("q1").alias("bracket_q"))
        first = first.join(group, ["file_id", "grp"], "left")
        is_object = (c("bracket") == "{") & (F.coalesce(c("bracket_q"), F.lit("(")).isin("(", "=", ",", ":", "?", "return", "&&", "||", "??", "...", "default", "[", "throw"))
        leads = c("q1").isNull() | c("q1").isin(",", "async", "get", "set", "*")
        key = F.coalesce((c("bracket") == "{") & leads & (c("s1") == ":"), F.lit(False))
        first = first.withColumn("object", F.coalesce(is_object, F.lit(False))).filter(~key & ~F.coalesce((c("tok") == "abstract") & (c("s1") == "class"), F.lit(False)) & ~F.coalesce(c("q1").isin("as", "satisfies", "function", "break", "continue"), F.lit(False)))
        banned = self.banned
        plain = first.filter("not deco").alias("f").join(banned.alias("b"), [c(f"f.{k}") == c(f"b.{k}") for k in PART] + [c("f.i").between(c("b.a"), c("b.b"))], "left_anti")
        first = plain.unionByName(first.filter("deco"))
        toks = v.groupBy("file_id", "grp", "run").agg(F.array_sort(F.collect_list(F.struct("i", "tok", "mate", "call"))).alias("toks"), F.max("i").alias("run_end"))
        after = v.select("file_id", c("i").alias("run_end"), c("s1").alias("behind"), c("s_i").alias("behind_i"), c("q1").alias("before_end"))
        runs = first.join(toks, ["file_id", "grp", "run"]).join(after, ["file_id", "run_end"]).withColumn("toks", F.filter("toks", lambda x: x["i"] >= c("i")))
        hit = F.get(F.filter("toks", lambda x: (x["tok"] == "[") | x["call"]), F.lit(0))
        runs = runs.withColumns({"stop": hit["i"], "stops_at": hit["tok"], "path": F.transform(F.filter("toks", lambda x: _is_name(x["tok"]) & (hit["i"].isNull() | (x["i"] < hit["i"]))), lambda x: x["tok"])})
        # A method written in an object: name ( ) { }.
        shorthand = c("object") & leads & F.coalesce((c("stops_at") == "(") & (c("behind") == "{"), F.lit(False))
        made = F.coalesce(c("q1") == "new", F.lit(False))
        runs = runs.filter(~shorthand).withColumns({"made": made, "awaited": F.coalesce(F.when(made, c("q2")).otherwise(c("q1")) == "await", F.lit(False)), "begin": F.when(made, c("q_i")).otherwise(c("i"))})
        self.runs = materialise(runs, "runs")
        opened = self.runs.select(*PART, "run", "i", "begin", "made", "awaited", "path", "stop", F.explode(F.filter("toks", lambda x: x["call"])).alias("x")).select(*PART, "run", "i", "begin", "made", "awaited", "path", "stop", c("x.i").alias("open"), c("x.mate").alias("close"))
        bare = self.runs.filter("made and coalesce(stops_at, '') <> '('").select(*PART, "run", "i", "begin", "made", "awaited", "path", "stop", _none("int").alias("open"), c("run_end").alias("close"))
        direct = F.coalesce(c("open") == c("stop"), c("open").isNull())
        calls = opened.unionByName(bare).withColumn("direct", direct)
        # require('x') alone is an import.
        required = calls.filter((F.size("path") == 1) & (F.get("path", F.lit(0)) == "require")).join(s.parts.select("file_id", c("grp").alias("open"), "toks"), ["file_id", "open"]).filter((F.size("toks") == 1) & F.get("toks", F.lit(0))["tok"].rlike(r"^['\"]"))
        self.required = required.select("file_id", "i", F.regexp_extract(F.get("toks", F.lit(0))["tok"], r"^.(.*).$", 1).alias("source"))
        calls = calls.join(required.select("file_id", "open"), ["file_id", "open"], "left_anti")
        places = s.t.select("file_id", c("i").alias("begin"), "line", "col")
        ends = s.t.select("file_id", c("i").alias("close"), c("line").alias("end_line"))
        owned = self._owner_of(calls).join(places, ["file_id", "begin"]).join(ends, ["file_id", "close"], "left")
        # The outermost of calls that begin at one place comes first.
        rank = F.row_number().over(W.partitionBy("file_id", "begin").orderBy(F.desc("open")))
        again = F.when(rank > 1, F.concat(F.lit("@"), "line", F.array_join(F.transform(F.when(rank > 2, F.sequence(F.lit(2), rank - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("#"), k)), ""))).otherwise("")
        owned = owned.withColumn("id", F.concat("under", F.lit("/call@"), "line", F.lit(":"), "col", again))
        callee = F.when(c("direct"), F.array_join("path", "."))
        outer = F.lag("id").over(W.partitionBy("file_id", "begin").orderBy(F.desc("open")))
        self.calls = materialise(owned.withColumns({"callee": callee, "outer": outer}), "calls")

    def _statements(self) -> None:
        """Returns, throws, branches, loops, jumps and assignments."""
        s = self.s
        v = s.v
        free = ~F.coalesce(c("q1").isin(".", "?."), F.lit(False))
        word = v.filter(free & c("tok").isin("return", "throw", "if", "for", "while", "do", "switch", "case", "default", "try", "catch", "break", "continue"))
        done = (c("tok") == "while") & F.coalesce((c("q1") == "}") & (c("q3") == "do"), F.lit(False))
        colon = F.coalesce(c("s1") == ":", F.lit(False))
        word = word.filter(~done & F.when(c("tok") == "default", colon).otherwise(~colon) & (~c("tok").isin("if", "for", "while", "switch", "catch") | c("s1").isin("(", "{", "await")))
        kinds = {"return": "Return", "throw": "Throw", "if": "If", "for": "Loop", "while": "Loop", "do": "Loop", "switch": "Switch", "case": "Case", "default": "Case", "try": "Try", "catch": "Catch", "break": "Jump", "continue": "Jump"}
        # for (x of y), also behind await.
        heads = s.segs.select("file_id", c("grp").alias("next_paren"), F.exists("toks", lambda x: x["tok"] == "of").alias("has_of"), F.exists("toks", lambda x: x["tok"] == "in").alias("has_in")).groupBy("file_id", "next_paren").agg(F.max("has_of").alias("has_of"), F.max("has_in").alias("has_in"))
        word = word.join(heads, ["file_id", "next_paren"], "left")
        loop = F.when(c("tok") == "do", "do_while").when(c("tok") == "while", "while").when(c("has_of"), "for_of").when(c("has_in"), "for_in").otherwise("for")
        kind = F.when(fn.looked_up(c("tok"), kinds) == "Loop", loop).when(c("tok").isin("break", "continue"), c("tok"))
        label = F.when(c("tok").isin("break", "continue") & F.coalesce(_is_name(c("s1")) & (c("s_i") <= c("seg_end")), F.lit(False)), c("s1"))
        closes = v.filter("tok = '('").select("file_id", c("i").alias("next_paren"), c("mate").alias("cond_end"))
        told = word.join(closes, ["file_id", "next_paren"], "left").select(*PART, "i", "line", "col", fn.looked_up(c("tok"), kinds).alias("type"), kind.alias("node_kind"), label.alias("label"), (c("tok") == "default").alias("is_default"), F.when(c("tok") == "if", c("next_paren")).alias("cond"), F.when(c("tok") == "if", c("cond_end")).alias("cond_end"), c("seg_end").alias("end"))
        # Assignments: what has a sign of it, but in declarations; and variables with a value.
        banned = self.banned
        sign = v.filter(c("tok").isin(*ASSIGNS, "++", "--")).select(*PART, "i", "tok", "q1", "q_i", "s1", "s_i", "sub_end", "run", "line")
        owners = _union([self.ds.select(*PART, "eq"), self.ms.select(*PART, "eq"), self.params.select(*PART, "eq"), self.taken.select(*PART, "eq")]).filter("eq is not null and grp is not null").select("file_id", c("eq").alias("i"))
        sign = sign.join(owners.distinct(), ["file_id", "i"], "left_anti")
        sign = sign.alias("f").join(banned.alias("b"), [c(f"f.{k}") == c(f"b.{k}") for k in PART] + [c("f.i").between(c("b.a"), c("b.b"))], "left_anti")
        left = self.runs.select("file_id", "grp", c("run").alias("left_run"), c("begin").alias("left_i"), "path", c("run_end").alias("left_end"), c("stops_at"))
        prior = v.select("file_id", c("i").alias("q_i"), c("run").alias("q_run"))
        nxt = v.select("file_id", c("i").alias("s_i"), c("run").alias("s_run"))
        sign = sign.join(prior, ["file_id", "q_i"], "left").join(nxt, ["file_id", "s_i"], "left")
        prefix = c("tok").isin("++", "--") & F.coalesce(_is_name(c("s1")), F.lit(False)) & ~F.coalesce(_is_name(c("q1")) | c("q1").isin(")", "]"), F.lit(False))
        sign = sign.withColumn("left_run", F.when(prefix, c("s_run")).otherwise(c("q_run"))).join(left, ["file_id", "grp", "left_run"])
        # module.exports = and exports.x = are exports.
        cjs = F.array_join("path", ".").rlike(r"^(module\.)?exports(\.|$)") & ~F.array_join("path", ".").isin("module") & (F.get("path", F.lit(0)).isin("module", "exports"))
        assigned = sign.filter(~cjs & ~F.coalesce(c("stops_at") == "(", F.lit(False))).select(*PART, F.least("left_i", "i").alias("i"), c("tok").alias("operator"), "path", "left_i", F.when(~c("tok").isin("++", "--"), c("i") + 1).alias("from"), F.when(~c("tok").isin("++", "--"), c("sub_end")).alias("to"))
        function_parts = self.fs.filter("takes").select(*PART).distinct()
        valued = self.ds.filter("eq is not null and required is null and not coalesce(value = 'class', false)").join(function_parts, PART, "left_anti").select(*PART, "i", F.lit("=").alias("operator"), (c("eq") + 1).alias("from"), c("end").alias("to"), c("i").alias("declares"))
        assigned = assigned.unionByName(valued, allowMissingColumns=True).join(s.t.select("file_id", "i", "line", "col"), ["file_id", "i"]).withColumns({"type": F.lit("Assignment"), "end": F.coalesce("to", "i")})
        every = self._owner_of(told.unionByName(assigned, allowMissingColumns=True))
        places = s.t.select("file_id", c("i").alias("end"), c("line").alias("end_line"))
        every = every.join(places, ["file_id", "end"], "left")
        self.statements = materialise(_unique(every, F.concat("under", F.lit("#"), "type", F.lit("@"), "line", F.lit(":"), "col")), "statement-ids")

    def _uses(self) -> None:
        """Regions, and what each use belongs to."""
        s = self.s
        st = self.statements
        none = _none("int")
        region = lambda df, a, b, src, edge, idx=none, seq=1: df.select("file_id", a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), src.alias("src"), F.lit(edge).alias("edge"), idx.cast("int").alias("idx"), F.lit(seq).alias("seq"))
        ids = self.owner_ids
        inside = self.owning.join(ids.select("file_id", c("owner_i").alias("span_id"), "owner_id"), ["file_id", "span_id"])
        out = [region(inside, c("start_line"), c("end_line"), c("owner_id"), "READS", seq=0)]
        out.append(region(st.filter("type in ('Return', 'Throw')"), c("i") + 1, c("end"), c("id"), "READS"))
        out.append(region(st.filter("type = 'Assignment' and `to` is not null"), c("from"), c("to"), c("id"), "READS"))
        fields = self.decls.filter("type = 'Field' and property is null").join(self.ms.filter("eq is not null").select("file_id", "i", "eq", c("end").alias("value_end")), ["file_id", "i"])
        out.append(region(fields, c("eq") + 1, c("value_end"), c("id"), "READS"))
        arguments = s.parts.select("file_id", c("grp").alias("open"), "sub", "start", "end").join(self.calls.filter("open is not null").select("file_id", "open", "id"), ["file_id", "open"])
        # The comma before a part is of the part before it.
        out.append(region(arguments, c("start"), c("end"), c("id"), "ARGUMENT", c("sub"), 2))
        regions = _union(out).filter("start_line <= end_line").withColumn("span_id", F.concat_ws("|", "start_line", "end_line", "seq", "src"))
        self.regions = materialise(regions, "regions")
        held = self.regions.select("file_id", "span_id", "src", "edge", "idx")

        def placed(df: DataFrame) -> DataFrame:
            """``df`` (file_id, line) with src, edge and idx of the innermost region; of its file where there is none."""
            points = df.select("file_id", "line").distinct()
            at = innermost(points, self.regions).join(held, ["file_id", "span_id"]).select("file_id", "line", c("src").alias("in_src"), c("edge").alias("in_edge"), c("idx").alias("in_idx"))
            return df.join(at, ["file_id", "line"], "left").withColumns({"in_src": F.coalesce("in_src", "file_id"), "in_edge": F.coalesce("in_edge", F.lit("READS"))})

        # Plain uses: first paths that are not called, nor written to.
        written = self.statements.filter("left_i is not null").select("file_id", c("left_i").alias("begin"), F.lit(True).alias("written"))
        said = F.array_join("path", ".")
        exporting = said.rlike(r"^(module\.exports|exports\.)") & F.coalesce(c("behind") == "=", F.lit(False))
        direct = self.runs.filter(~exporting & ~c("made") & (F.coalesce("stops_at", F.lit("")) != "(")).join(written.distinct(), ["file_id", "begin"], "left").filter("written is null")
        uses = direct.select("file_id", c("i").alias("line"), "i", "path")
        root = F.get("path", F.lit(0))
        uses = placed(uses).filter(~((root == "super") | ((root == "this") & (F.size("path") == 1))))
        self.uses = materialise(self._scoped(uses), "uses")
        # Calls and functions as values of what they are in.
        values = self.calls.filter("outer is null").select("file_id", "begin", "id", "owner").withColumn("line", c("begin"))
        functions = self.decls.filter("type = 'Function' and node_kind in ('arrow', 'expression')").join(self.fs.filter("not takes").select("file_id", "i"), ["file_id", "i"])
        up = self.owner_ids.select("file_id", c("owner_i").alias("parent"), c("owner_id"))
        functions = functions.join(up, ["file_id", "parent"], "left").select("file_id", c("i").alias("begin"), "id", F.coalesce("owner_id", "file_id").alias("owner"), c("i").alias("line"))
        own = placed(values.unionByName(functions)).filter((c("in_src") != c("owner")) & (c("in_src") != c("id")))
        # A call that is called, or whose member is, is read by the call around it.
        chained = self.calls.filter("outer is not null").select("file_id", "begin", "id", c("outer").alias("in_src"), F.lit("READS").alias("in_edge"), _none("int").alias("in_idx"))
        self.values = materialise(own.select(*chained.columns).unionByName(chained), "values")

    def _scoped(self, df: DataFrame) -> DataFrame:
        at = innermost(df.select("file_id", "line").distinct(), self.owning).select("file_id", "line", c("span_id").alias("owner_i"))
        return df.join(at, ["file_id", "line"], "left").join(self.owner_ids.select("file_id", "owner_i", "owner_id"), ["file_id", "owner_i"], "left").withColumn("scope", F.concat(F.coalesce("owner_id", "file_id"), F.lit("$"))).drop("owner_i", "owner_id")

    def told(self) -> tuple[Parts, DataFrame]:
        from .assemble import assemble

        return assemble(self)


def _unique(df: DataFrame, base: Column) -> DataFrame:
    """``df`` (file_id, i, line) with ``id``: the first of equal names as it is, others with their line, others of one line with numbers too."""
    named = df.withColumn("base", base)
    place = F.row_number().over(W.partitionBy("base").orderBy("i"))
    named = named.withColumn("place", place)
    same = F.row_number().over(W.partitionBy("base", "line", c("place") > 1).orderBy("i"))
    named = named.withColumn("same", same)
    more = F.array_join(F.transform(F.when(c("same") > 1, F.sequence(F.lit(2), c("same"))).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("#"), k)), "")
    return named.withColumn("id", F.when(c("place") == 1, c("base")).otherwise(F.concat("base", F.lit("@"), "line", more))).drop("base", "place", "same")
