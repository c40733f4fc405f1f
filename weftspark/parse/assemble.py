"""Findings as rows: nodes, the edges that a file tells alone, and what linking needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.derive import next_statements
from ..operators.link import Parts
from ..operators.spans import innermost, within
from ..tables import materialise
from .facts import ASSIGNS, KEY, PART, _core, _first, _is_name, _none, _slice, _union, _unique, cut_text, type_refs

c = F.col
_EMPTY = F.array().cast("array<string>")


def _scope(x: Column) -> Column:
    return F.concat(x, F.lit("$"))


def _edge(df: DataFrame, kind: str | Column, src: Column, dst: Column, seq: Column, idx: Column | None = None, member: Column | None = None, operator: Column | None = None) -> DataFrame:
    none = _none("string")
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), src.alias("src"), dst.alias("dst"), (_none("int") if idx is None else idx.cast("int")).alias("idx"), (none if member is None else member).alias("member"), (none if operator is None else operator).alias("operator"), F.lit("exact").alias("resolution"), seq.cast("long").alias("seq"))


def _ref(df: DataFrame, src: Column, edge: str | Column, scope: Column, path: Column, seq: Column, idx: Column | None = None, operator: Column | None = None, inferred: bool = False) -> DataFrame:
    return df.select(src.alias("src"), (F.lit(edge) if isinstance(edge, str) else edge).alias("edge"), scope.alias("scope"), F.get(path, F.lit(0)).alias("name"), F.slice(path, F.lit(2), F.size(path)).alias("path"), (_none("int") if idx is None else idx.cast("int")).alias("idx"), (_none("string") if operator is None else operator).alias("operator"), _none("string").alias("member"), F.lit(inferred).alias("inferred"), seq.cast("long").alias("seq"))


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({"operator": _none("string"), "member": _none("string"), "seq": c("seq").cast("long")})


def _blocks(f) -> DataFrame:
    """file_id, grp of the bodies whose statements follow each other: files, functions, braces that are no objects."""
    v = f.s.v
    outer = v.filter(c("tok").isin("{", "(", "[", "${")).select("file_id", c("i").alias("grp"), c("tok").alias("outer"))
    braces = v.filter("tok = '{'").select("file_id", "grp", c("i").alias("b"), "q1").join(outer, ["file_id", "grp"], "left")
    bodies = f.fs.filter("body is not null").select("file_id", c("body").alias("b"), F.lit(True).alias("is_body"))
    braces = braces.join(bodies.distinct(), ["file_id", "b"], "left")
    # A brace behind a value's sign, or first among arguments, is an object.
    signs = ("(", "=", ",", ":", "?", "return", "&&", "||", "??", "...", "default", "[", "throw", *ASSIGNS)
    is_object = c("q1").isin(*signs) | (c("q1").isNull() & F.coalesce(c("outer") != "{", F.lit(False)))
    plain = braces.filter(F.coalesce("is_body", F.lit(False)) | ~F.coalesce(is_object, F.lit(False))).select("file_id", c("b").alias("grp"))
    no = _union([f.classes.select("file_id", c("body").alias("grp")), f.taken.select("file_id", "grp")])
    return plain.join(no.distinct(), ["file_id", "grp"], "left_anti").unionByName(f.named.select("file_id", F.lit(0).alias("grp")))


def _next(f) -> DataFrame:
    segs = f.s.segs.join(_blocks(f), ["file_id", "grp"]).select("file_id", "grp", "seg", c("start").alias("start_line"), c("end").alias("end_line"))
    regions = segs.select("file_id", F.concat_ws("|", "grp", "seg").alias("span_id"), "start_line", "end_line", F.lit(0).alias("seq"))
    # Of which function or class the block is.
    block = f._placed(segs.select("file_id", c("grp").alias("i")).distinct().filter("i > 0")).join(f.owner_ids.select("file_id", c("owner_i").alias("parent"), "owner_id"), ["file_id", "parent"], "left").select("file_id", c("i").alias("grp"), F.coalesce("owner_id", "file_id").alias("block_owner"))
    block = block.unionByName(f.named.select("file_id", F.lit(0).alias("grp"), c("file_id").alias("block_owner")))
    nodes = f.statements.select("file_id", "i", "id", "owner", F.lit(0).alias("late")).unionByName(f.calls.select("file_id", c("begin").alias("i"), "id", "owner", (F.lit(1 << 30) - F.coalesce("open", F.lit(0))).cast("int").alias("late")))
    held = innermost(nodes.withColumn("line", c("i")), regions).select("file_id", F.split("span_id", r"\|").alias("s"), "i", "late", "id", "owner")
    held = held.select("file_id", c("s")[0].cast("int").alias("grp"), c("s")[1].cast("long").alias("seg"), "i", "late", "id", "owner").join(block, ["file_id", "grp"]).filter("owner = block_owner")
    first = held.groupBy("file_id", "grp", "seg").agg(F.min_by(F.struct("id", "i"), F.struct("i", "late")).alias("n"))
    return next_statements(first.select(F.concat_ws("|", "file_id", "grp").alias("block"), c("seg").alias("position"), c("n.id").alias("node"))).withColumn("seq", F.lit(0))


def _texts(f, ranges: DataFrame) -> DataFrame:
    """(key, text) of the tokens of ``ranges`` (file_id, key, start_line, end_line), a space where lines or names meet."""
    told = within(f.s.t.select("file_id", c("i").alias("line"), "tok"), ranges.withColumnRenamed("key", "span_id"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("line", "tok"))), lambda x: x["tok"])
    joined = told.groupBy("span_id").agg(F.array_join(words, " ").alias("text"))
    tight = F.regexp_replace("text", r" ?(\?\.|[.()\[\]]) ?", "$1")
    return joined.select(c("span_id").alias("key"), cut_text(F.regexp_replace(F.regexp_replace(tight, r" ([,;])", "$1"), r"([!~]) ", "$1")).alias("text"))


def _imports(f) -> tuple[DataFrame, DataFrame]:
    """imports and exports of files, ESM and CommonJS, by tokens: what stands in comments and strings is none."""
    s = f.s
    core = s.segs.withColumn("core", F.filter(c("toks"), lambda x: x["tok"] != ";"))
    tok = lambda k: F.get("core", F.lit(k))["tok"]
    text = lambda x: F.regexp_extract(x, r"(?s)^.(.*).$", 1)
    strings = F.filter("core", lambda x: x["tok"].rlike(r"^['\"]"))
    lists = s.parts.withColumn("words", F.transform(F.filter("toks", lambda x: ~x["tok"].isin(",", "type")), lambda x: x["tok"])).filter(F.size("words") > 0).select("file_id", c("grp").alias("list"), "start", "words")
    w = lambda k: F.get("words", F.lit(k))
    imp = core.filter((tok(0) == "import") & ~F.coalesce(tok(1).isin("(", "."), F.lit(False)))
    imp = imp.select("file_id", "core", c("start").alias("seq"), text(F.get(strings, F.lit(0))["tok"]).alias("source"), _first(c("core"), "{")["i"].alias("list"), _first(c("core"), "=")["i"].alias("eq"), _first(c("core"), "*")["i"].alias("star"), _first(c("core"), "(")["i"].alias("paren"))
    row = lambda df, local, imported, kind, seq=None: df.select("file_id", local.alias("local"), imported.alias("imported"), "source", F.lit(kind).alias("kind"), (c("seq") if seq is None else seq).cast("long").alias("seq"))
    esm = imp.filter("source is not null and eq is null")
    type_only = (tok(1) == "type") & ~F.coalesce(tok(2).isin("from", ","), F.lit(False))
    head = F.when(type_only, tok(2)).otherwise(tok(1))
    main = row(esm.withColumn("head", head).filter(_is_name(c("head"))), c("head"), F.lit("default"), "default")
    after_star = F.get(_slice(c("core"), c("star"), F.lit(None)), F.lit(1))["tok"]
    spaces = row(esm.filter("star is not null").withColumn("space", after_star), c("space"), F.lit("*"), "namespace")
    named = row(esm.filter("list is not null").join(lists, ["file_id", "list"]), F.coalesce(F.when(w(1) == "as", w(2)), w(0)), w(0), "named", c("start"))
    bare = row(esm.filter(F.size("core") == 2), _none("string"), _none("string"), "sideeffect")
    # import x = require('y')
    inside = s.parts.select("file_id", c("grp").alias("paren"), text(F.get("toks", F.lit(0))["tok"]).alias("source"))
    equals = row(imp.filter("eq is not null and paren is not null").drop("source").join(inside, ["file_id", "paren"]), tok(1), F.lit("*"), "namespace")
    required = f.ds.filter("required is not null").join(inside.withColumnRenamed("paren", "required"), ["file_id", "required"]).withColumn("seq", c("i"))
    whole = row(required.filter("name is not null"), c("name"), F.lit("*"), "namespace")
    parts = f.taken.filter("by = 'variable'").select("file_id", c("by_i").alias("i"), c("name").alias("local"), "member", c("start").alias("at"))
    pieces = row(required.filter("pattern is not null").join(parts, ["file_id", "i"]).filter("local is not null"), c("local"), c("member"), "named", c("at"))
    used = f.ds.filter("required is not null").select("file_id", c("required").alias("open"))
    alone = row(f.required.join(f.runs.select("file_id", "i", c("stop").alias("open")), ["file_id", "i"]).join(used, ["file_id", "open"], "left_anti").withColumn("seq", c("i")), _none("string"), _none("string"), "sideeffect")
    imports = _union([main, spaces, named, bare, equals, whole, pieces, alone])

    exp = core.withColumn("core", _core(c("core"))).filter(tok(0) == "export")
    exp = exp.select(*KEY, "core", c("start").alias("seq"), text(F.get(F.filter("core", lambda x: x["tok"].rlike(r"^['\"]")), F.lit(0))["tok"]).alias("source"), _first(c("core"), "{")["i"].alias("list"))
    out = lambda df, kind, name, local, node=None, source=None, seq=None: df.select("file_id", F.lit(kind).alias("kind"), name.alias("name"), local.alias("local"), (_none("string") if node is None else node).alias("node"), (_none("string") if source is None else source).alias("source"), (c("seq") if seq is None else seq).cast("long").alias("seq"))
    none = _none("string")
    second = F.when(tok(1) == "type", tok(2)).otherwise(tok(1))
    exp = exp.withColumn("second", second)
    listed = exp.filter("second = '{'").join(lists, ["file_id", "list"])
    renamed = F.coalesce(F.when(w(1) == "as", w(2)), w(0))
    again = out(listed.filter("source is not null"), "reexport", renamed, w(0), source=c("source"), seq=c("start"))
    own = out(listed.filter("source is null"), "local", renamed, w(0), seq=c("start"))
    stars = exp.filter("second = '*' and source is not null")
    all_ = out(stars.filter(~F.coalesce(tok(2) == "as", F.lit(False))), "reexport_all", none, none, source=c("source"))
    # export * as ns: the name stands for the other file.
    spaced = out(stars.filter(F.coalesce(tok(2) == "as", F.lit(False))), "reexport", tok(3), F.lit("*"), source=c("source"))
    default = exp.filter(tok(1) == "default")
    value = out(default.filter((F.size("core") == 3) & _is_name(tok(2))), "local", F.lit("default"), tok(2))
    tops = f.decls.filter(c("type").isin("Function", "Class", "Interface", "Enum")).select("file_id", "i", "id")
    kept = default.select("file_id", "seq", F.explode(F.filter("core", lambda x: x["tok"].isin("function", "class", "async", "(") | _is_name(x["tok"]))["i"]).alias("i"))
    first_decl = kept.join(tops, ["file_id", "i"]).groupBy("file_id", "seq").agg(F.min_by("id", "i").alias("id"))
    declared_default = out(first_decl, "local", F.lit("default"), none, node=c("id"))
    is_default = default.select("file_id", "seq", F.explode(F.transform("core", lambda x: x["i"])).alias("i")).select("file_id", "i", F.lit(True).alias("by_default"))
    flagged = f.decls.filter("exported and parent is null").join(is_default, ["file_id", "i"], "left").filter("by_default is null")
    told = out(flagged, "local", c("name"), none, node=c("id"), seq=c("i"))
    # CommonJS
    joined = F.array_join(F.transform("core", lambda x: x["tok"]), " ")
    cjs = core.withColumn("said", joined).filter(c("said").rlike(r"^(module \. )?exports\b")).select("file_id", "core", "said", c("start").alias("seq"), _first(c("core"), "{")["i"].alias("list"))
    cjs_lists = cjs.filter(c("said").rlike(r"^module \. exports = \{ \}$")).join(lists, ["file_id", "list"])
    held = out(cjs_lists.filter(_is_name(w(0)) & (F.size("words") == 1)), "local", w(0), w(0), seq=c("start")).unionByName(out(cjs_lists.filter((w(1) == ":") & (F.size("words") == 3)), "local", w(0), w(2), seq=c("start")))
    one = cjs.withColumns({"n": F.regexp_extract("said", r"^(?:module \. )?exports \. ([\w$]+) = ", 1), "l": F.regexp_extract("said", r" = ([\w$]+)$", 1)}).filter("n <> ''")
    single = out(one, "local", c("n"), F.when(c("l") != "", c("l")).otherwise(c("n")))
    main_value = cjs.withColumn("l", F.regexp_extract("said", r"^module \. exports = ([\w$]+)$", 1)).filter("l <> ''")
    module = out(main_value, "local", F.lit("default"), c("l"))
    return imports, _union([again, own, all_, spaced, value, declared_default, told, held, single, module])


def assemble(f) -> tuple[Parts, DataFrame]:
    app_key, named, s = f.app_key, f.named, f.s
    owner = f.owner_ids.select("file_id", c("owner_i").alias("parent"), "owner_id")
    d = materialise(f.decls.join(owner, ["file_id", "parent"], "left").withColumn("holder", F.coalesce("owner_id", "file_id")).drop("owner_id"), "held")
    # Fields that only assignments to this.x tell.
    member_rows = d.filter("type in ('Field', 'EnumMember') or (type = 'Function' and class_i is not null)").select("holder", "name", c("id").alias("node"), "i")
    bodies = f.classes.filter("kind = 'Class'").select("file_id", c("i").alias("span_id"), c("body").alias("start_line"), c("body_end").alias("end_line"), F.lit(0).alias("seq"))
    to_this = f.statements.filter((F.size("path") == 2) & (F.get("path", F.lit(0)) == "this")).select("file_id", c("left_i").alias("line"), F.get("path", F.lit(1)).alias("name"), "id", "from")
    class_ids = d.filter("type = 'Class'").select("file_id", c("i").alias("span_id"), c("id").alias("holder"), c("qual").alias("class_qual"))
    to_this = innermost(to_this, bodies).join(class_ids, ["file_id", "span_id"])
    new_fields = to_this.join(member_rows.select("holder", "name"), ["holder", "name"], "left_anti").groupBy("file_id", "holder", "name").agg(F.min("line").alias("i"))
    new_fields = new_fields.select("file_id", "holder", "name", "i", F.concat("holder", F.lit("."), "name").alias("id"), F.lit("Field").alias("type")).join(s.t.select("file_id", "i", "line", "col"), ["file_id", "i"])
    d = d.unionByName(new_fields, allowMissingColumns=True)
    d = materialise(d, "declarations")
    members = member_rows.unionByName(new_fields.select("holder", "name", c("id").alias("node"), "i")).groupBy("holder", "name").agg(F.max_by("node", "i").alias("node"))

    # What decorators stand on.
    deco = f.deco.select(*PART, c("i").alias("deco_i"), c("end").alias("deco_end"), c("name").alias("deco"), "arg", "text")
    ids = d.select("file_id", "i", c("id").alias("target"), "type")
    on_class = deco.join(f.classes.filter("kind = 'Class'").select(*KEY, "i"), KEY).filter("deco_i < i").join(ids, ["file_id", "i"])
    field_functions = f.fs.filter("takes and class_i is not null").select(*PART, "i")
    on_member = deco.join(f.ms.select(*PART, c("i").alias("m_i"), "is_method"), PART).join(field_functions.withColumnRenamed("i", "fi"), PART, "left")
    on_member = on_member.withColumn("i", F.coalesce("fi", "m_i")).join(ids, ["file_id", "i"])
    p = f.parameters
    on_parameter = deco.join(p.filter("grp is not null").select(*PART, c("id").alias("target"), F.lit("Parameter").alias("type"), "i"), PART)
    decorated = materialise(_union([x.select("file_id", "deco_i", "deco_end", "deco", "arg", "text", "target", "type", "i") for x in (on_class, on_member, on_parameter)]), "decorated")
    listed = decorated.groupBy(c("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("deco_i", "text"))), lambda x: x["text"]).alias("decorators"))
    in_deco = within(f.calls.select("file_id", c("begin").alias("line"), c("id").alias("call"), "i"), decorated.select("file_id", c("target").alias("span_id"), c("deco_i").alias("start_line"), c("deco_end").alias("end_line")))

    # Contracts: controllers' base paths, methods' endpoints, parameters.
    base = decorated.filter("deco = 'Controller' and type = 'Class'").groupBy("file_id", c("i").alias("class_i")).agg(F.min_by("arg", "deco_i").alias("base"))
    verb = decorated.filter("type = 'Function'").withColumn("method", fn.looked_up(c("deco"), fn.HTTP_METHODS)).filter("method is not null").groupBy("file_id", "i", "target").agg(F.min_by(F.struct("method", "arg"), "deco_i").alias("m"))
    ends = verb.join(f.fs.select("file_id", "i", "class_i"), ["file_id", "i"]).join(base, ["file_id", "class_i"]).join(s.t.select("file_id", "i", "line"), ["file_id", "i"])
    ends = ends.select("file_id", "i", "line", c("target").alias("handler"), c("m.method").alias("method"), fn.http_path(c("base"), c("m.arg")).alias("path"))
    ends = materialise(_unique(ends, F.concat("file_id", F.lit("#"), "file_id", F.lit("#endpoint:"), "method", F.lit(" "), "path")), "endpoints")
    asked = decorated.filter("type = 'Parameter'").withColumn("in", fn.looked_up(c("deco"), fn.HTTP_PARAMS)).filter("`in` is not null").groupBy("file_id", "i", "target").agg(F.min_by(F.struct("in", "arg"), "deco_i").alias("q"))
    hp = asked.join(p.select(c("id").alias("target"), "owner_id", c("name").alias("p_name"), "type_name", "optional", "has_default", "line"), "target").join(ends.select(c("handler").alias("owner_id"), c("id").alias("endpoint")), "owner_id")
    hp = hp.select("file_id", "i", "line", "target", "endpoint", c("q.in").alias("in"), F.coalesce(F.nullif("q.arg", F.lit("")), "p_name").alias("name"), "type_name", (~c("optional") & ~c("has_default")).alias("required"))
    hp = materialise(_unique(hp, F.concat("file_id", F.lit("#"), "endpoint", F.lit("#httpparam:"), "in", F.lit(":"), "name")), "http-parameters")

    callee = f.calls.filter("callee is null and open is not null").select("file_id", c("id").alias("key"), c("i").alias("start_line"), (c("open") - 1).alias("end_line"))
    conditions = f.statements.filter("cond is not null").select("file_id", c("id").alias("key"), c("cond").alias("start_line"), c("cond_end").alias("end_line"))
    said = materialise(_texts(f, callee.unionByName(conditions)), "texts").withColumnRenamed("key", "id")
    calls = f.calls.join(said, "id", "left").withColumn("callee", cut_text(F.coalesce("callee", "text")))
    st = f.statements.join(said, "id", "left")
    file_row = named.select(c("file_id").alias("id"), F.lit("File").alias("type"), fn.base_name(c("path")).alias("name"), "file_id", F.lit(1).alias("start_line"), "path", "language", "hash", F.lit(False).alias("exported"))
    flags = ("async", "static", "abstract", "override", "private", "protected", "readonly", "optional", "exported")
    decl_rows = d.join(listed, "id", "left").select("id", "type", "name", c("holder").alias("owner_id"), "file_id", c("line").alias("start_line"), c("col").alias("start_col"), F.coalesce("end_line", "line").alias("end_line"), c("node_kind").alias("kind"), "type_name", "value", "decorators", *flags)
    param_rows = p.join(listed, "id", "left").select("id", F.lit("Parameter").alias("type"), "name", "owner_id", "file_id", c("line").alias("start_line"), c("col").alias("start_col"), c("line").alias("end_line"), "idx", "variadic", "has_default", "optional", "readonly", "private", "protected", "type_name", "decorators")
    call_rows = calls.select("id", F.lit("Call").alias("type"), c("callee").alias("name"), c("owner").alias("owner_id"), "file_id", c("line").alias("start_line"), c("col").alias("start_col"), F.coalesce("end_line", "line").alias("end_line"), F.when(c("made"), "new").otherwise("call").alias("kind"), "awaited", c("callee").alias("callee_text"))
    st_rows = st.select("id", "type", c("owner").alias("owner_id"), "file_id", c("line").alias("start_line"), c("col").alias("start_col"), F.coalesce("end_line", "line").alias("end_line"), c("node_kind").alias("kind"), "operator", "label", "is_default", c("text").alias("condition_text"))
    end_rows = ends.select("id", F.lit("Endpoint").alias("type"), "file_id", "method", "path")
    hp_rows = hp.select("id", F.lit("HttpParam").alias("type"), "file_id", "name", "in", "type_name", "required")
    nodes = materialise(_union([file_row, decl_rows, param_rows, call_rows, st_rows, end_rows, hp_rows]), "file-nodes")

    i = c("i")
    by_declaration = f.fs.select("file_id", "i", (c("declares") | (c("takes") & c("class_i").isNull())).alias("named"))
    dn = d.join(by_declaration, ["file_id", "i"], "left").withColumn("named", F.when(c("type") == "Function", F.coalesce("named", F.lit(False))).otherwise(c("type").isin("Variable", "Class", "Interface", "Enum")))
    dn = materialise(dn, "named")
    taken_names = f.taken.filter("by = 'parameter' and name is not null").select("file_id", c("by_i").alias("pi"), "name", "i")
    scopes = named.select(_scope(c("file_id")).alias("id"), _none("string").alias("parent"), "file_id").unionByName(d.filter(c("type").isin("Function", "Class", "Interface", "Enum")).select(_scope(c("id")).alias("id"), _scope(c("holder")).alias("parent"), "file_id"))
    name = lambda df, scope, n, node, at=i: df.select(_scope(scope).alias("scope"), n.alias("name"), node.alias("node"), at.cast("long").alias("seq"))
    names = name(dn.filter("named and name is not null"), c("holder"), c("name"), c("id")).unionByName(name(p.filter("pattern is null"), c("owner_id"), c("name"), c("id")))
    names = names.unionByName(name(p.select("file_id", c("i").alias("pi"), "owner_id", "id").join(taken_names, ["file_id", "pi"]), c("owner_id"), c("name"), c("id")))
    names = names.unionByName(name(d.filter("type = 'Class'"), c("id"), F.lit("this"), c("id")))

    bare_this = (F.size("path") == 1) & (F.get("path", F.lit(0)) == "this")
    scoped_calls = f._scoped(f.calls.filter(c("direct") & ~bare_this).withColumn("at", c("line")).withColumn("line", c("begin")))
    refs = [_ref(scoped_calls, c("id"), F.when(c("made"), "INSTANTIATES").otherwise("CALLS"), c("scope"), c("path"), c("i"))]
    refs.append(_ref(f.uses, c("in_src"), c("in_edge"), c("scope"), c("path"), c("i"), c("in_idx")))
    written = f._scoped(f.statements.filter("path is not null").withColumn("line", c("left_i")))
    refs.append(_ref(written, c("id"), "WRITES", c("scope"), c("path"), c("i"), operator=c("operator")))
    words = lambda x: F.transform(x, lambda t: t["tok"])
    own_scope = _scope(c("holder")).alias("scope")
    typed = lambda df, tokens, edge: _typed(type_refs(df.select(c("id").alias("src"), own_scope, i.alias("seq"), tokens.alias("words")).filter("words is not null"), "words", edge))
    refs.append(_typed(type_refs(p.filter("type_words is not null").select(c("id").alias("src"), _scope(c("owner_id")).alias("scope"), i.alias("seq"), c("type_words").alias("words")), "words", "HAS_TYPE")))
    refs.append(typed(d.filter("type = 'Function'").join(f.fs.select("file_id", "i", "type_words"), ["file_id", "i"]), c("type_words"), "RETURNS_TYPE"))
    refs.append(typed(d.filter("type = 'Field'").join(f.ms.filter("type is not null").select("file_id", "i", c("type").alias("toks")), ["file_id", "i"]), words(c("toks")), "HAS_TYPE"))
    refs.append(typed(d.filter("type = 'Field' and property").join(p.select("file_id", "i", "type_words"), ["file_id", "i"]), c("type_words"), "HAS_TYPE"))
    refs.append(typed(d.filter("type = 'Variable'").join(f.ds.filter("type is not null").select("file_id", "i", c("type").alias("toks")), ["file_id", "i"]), words(c("toks")), "HAS_TYPE"))
    # Types by new: of variables, fields and this.x, where new X(...) is the whole value.
    whole = F.element_at("toks", -1)
    made = f.runs.filter("made").filter(F.coalesce(whole["tok"] == ")", F.lit(True)) & (F.size(F.filter("toks", lambda x: x["call"])) <= 1)).select("file_id", c("begin").alias("from"), "path", F.filter("toks", lambda x: x["tok"].startswith("<"))["tok"].alias("generic"))
    fresh = d.filter("type = 'Variable' and type_name is null").select("file_id", "i", "id", "holder").join(f.ds.filter("name is not null and eq is not null").select("file_id", "i", (c("eq") + 1).alias("from")), ["file_id", "i"])
    fresh = fresh.unionByName(d.filter("type = 'Field' and type_name is null").select("file_id", "i", "id", "holder").join(f.ms.filter("eq is not null").select("file_id", "i", (c("eq") + 1).alias("from")), ["file_id", "i"]))
    fields_by_name = members.select("holder", "name", c("node").alias("field"))
    fresh = fresh.unionByName(to_this.filter("`from` is not null").join(fields_by_name, ["holder", "name"]).select("file_id", c("line").alias("i"), c("field").alias("id"), "holder", "from"))
    fresh = fresh.join(made, ["file_id", "from"])
    refs.append(_ref(fresh, c("id"), "HAS_TYPE", own_scope, c("path"), i, inferred=True))
    refs.append(_typed(type_refs(fresh.filter((F.size("path") == 1) & (F.size("generic") > 0)).select(c("id").alias("src"), own_scope, i.alias("seq"), F.array(F.get("path", F.lit(0)), F.get("generic", F.lit(0))).alias("words")), "words", "HAS_TYPE", True)).filter("edge = 'HAS_TYPE_ARG'"))
    # Heritage: every entry of the lists, with the word before them.
    heirs = d.filter(c("type").isin("Class", "Interface")).join(f.classes.select("file_id", "i", "heritage"), ["file_id", "i"]).select("id", "holder", "heritage", F.posexplode("heritage").alias("k", "t"))
    before = F.filter(F.slice("heritage", F.lit(1), c("k")), lambda x: x["tok"].isin("extends", "implements"))
    last_word = F.element_at(F.concat(F.array(F.lit("")), F.transform(before, lambda x: x["tok"])), -1)
    prev = F.get("heritage", c("k") - 1)["tok"]
    entries = heirs.filter(_is_name(c("t.tok")) & ~c("t.tok").isin("extends", "implements") & prev.isin("extends", "implements", ",")).withColumn("word", last_word)
    rest = F.aggregate(F.slice("heritage", c("k") + 2, F.size("heritage")), F.struct(F.lit("").alias("s"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & ((x["tok"] == ".") | a["s"].endswith(".")), F.concat(a["s"], x["tok"])).otherwise(a["s"]).alias("s"), (a["on"] & ((x["tok"] == ".") | a["s"].endswith("."))).alias("on")), lambda a: a["s"])
    refs.append(_ref(entries, c("id"), F.when(c("word") == "implements", "IMPLEMENTS").otherwise("EXTENDS"), own_scope, F.split(F.concat("t.tok", rest), r"\."), c("t.i")))
    refs = materialise(_union(refs), "refs")

    imports, exports = _imports(f)
    one = lambda *kinds: d.filter(c("type").isin(*kinds))
    edges = [_edge(dn.filter("named"), "DECLARES", c("holder"), c("id"), i), _edge(d.filter("type = 'Function' and class_i is not null"), "HAS_METHOD", c("holder"), c("id"), i), _edge(one("Field"), "HAS_FIELD", c("holder"), c("id"), i), _edge(one("EnumMember"), "HAS_MEMBER", c("holder"), c("id"), i)]
    edges += [_edge(p, "HAS_PARAMETER", c("owner_id"), c("id"), i, c("idx")), _edge(f.calls, "CONTAINS", c("owner"), c("id"), c("begin")), _edge(f.statements, "CONTAINS", c("owner"), c("id"), i), _edge(f.statements.filter("type = 'Throw' and owner <> file_id"), "THROWS", c("owner"), c("id"), i)]
    edges.append(_edge(f.values, c("in_edge"), c("in_src"), c("id"), c("begin"), c("in_idx")))
    variables = d.filter("type = 'Variable'").select("file_id", "i", c("id").alias("variable"))
    valued = f.statements.filter("declares is not null").select("file_id", c("declares").alias("by_i"), c("id").alias("assign"))
    plain = valued.join(variables.withColumnRenamed("i", "by_i"), ["file_id", "by_i"]).withColumn("member", _none("string")).withColumn("i", c("by_i"))
    pieces = valued.join(f.taken.filter("by = 'variable' and name is not null").select("file_id", "by_i", "i", "member"), ["file_id", "by_i"]).join(variables, ["file_id", "i"])
    edges += [_edge(x, "WRITES", c("assign"), c("variable"), i, member=c("member"), operator=F.lit("=")) for x in (plain, pieces)]
    properties = d.filter("type = 'Field' and property").select("file_id", "i", "id").join(p.select("file_id", "i", "owner_id"), ["file_id", "i"])
    edges.append(_edge(properties, "WRITES", c("owner_id"), c("id"), i, operator=F.lit("=")))
    edges.append(_edge(_next(f), "NEXT", c("src"), c("dst"), c("seq")))
    edges.append(_edge(in_deco, "DECORATES", c("call"), c("span_id"), c("line")))
    edges += [_edge(ends, "EXPOSES", c("file_id"), c("id"), i), _edge(ends, "HANDLED_BY", c("id"), c("handler"), i), _edge(hp, "HAS_PARAM", c("endpoint"), c("id"), i), _edge(hp, "BINDS", c("id"), c("target"), i)]
    files = named.select(c("file_id").alias("id"), F.lit(app_key).alias("app_key"), "path", _scope(c("file_id")).alias("scope"))
    parts = Parts(files, materialise(scopes, "scopes"), materialise(names, "names"), nodes, materialise(members, "members"), refs, materialise(imports, "imports"), materialise(exports, "exports"))
    return parts, materialise(_union(edges), "file-edges")
