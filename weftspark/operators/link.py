"""From the parts that files tell alone to one graph: scopes, modules, exports, types, members and uses.

Inputs are DataFrames (see :class:`Parts`).  All steps are joins; recursion runs
in rounds over what the last round found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.confidence import weaker
from ..tables import discard, joined_by_size, materialise
from .dedup import edge_set, first_wins
from .heirs import FEW, handed_down
from .paths import ancestors, first_ways, nearest
from .symbols import FIELDS, resolve_symbols, symbol

HERITAGE = ("EXTENDS", "IMPLEMENTS")
TYPES = ("HAS_TYPE", "RETURNS_TYPE", "HAS_TYPE_ARG")
#: Types that have members of their own.
HOLDERS = ("Class", "Interface", "Enum")


@dataclass(frozen=True)
class Parts:
    """What parsing tells.

    files: id, app_key, path, scope.  scopes: id, parent, file_id.
    names: scope, name, node, seq.  nodes: id, type, name, owner_id, file_id.
    members: holder, name, node.
    refs: src, edge, scope, name, path (array), idx, operator, member, inferred, seq.
    imports: file_id, local, imported, source, kind (named, default, namespace, sideeffect), seq.
    exports: file_id, kind (local, reexport, reexport_all), name, local, node, source, seq.
    """

    files: DataFrame
    scopes: DataFrame
    names: DataFrame
    nodes: DataFrame
    members: DataFrame
    refs: DataFrame
    imports: DataFrame
    exports: DataFrame


def resolve_modules(asked: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``asked`` (file_id, source) with target_file or package.

    Relative paths, then ``aliases`` (app_key, prefix, suffix, wildcard, target
    with ``*``, base_url), then a package; the first candidate file that exists wins.
    """
    each = asked.select("file_id", "source").distinct().join(files.select(F.col("id").alias("file_id"), "app_key", F.col("path").alias("from_path")), "file_id")
    folder = F.when(F.contains("from_path", F.lit("/")), F.expr("substr(from_path, 1, length(from_path) - length(substring_index(from_path, '/', -1)))")).otherwise("")
    relative = F.col("source").rlike(r"^\.\.?(/|$)")
    direct = each.filter(relative).select("file_id", "source", "app_key", fn.clean_path(F.concat(folder, "source")).alias("p"), F.lit(0).alias("way"))
    if aliases is not None:
        held = fn.alias_capture(F.col("source"), F.col("prefix"), F.col("suffix"), F.col("wildcard"))
        mapped = each.filter(~relative).join(aliases, "app_key").withColumn("held", held).filter("held is not null")
        direct = direct.unionByName(mapped.select("file_id", "source", "app_key", fn.clean_path(F.concat_ws("/", "base_url", F.replace("target", F.lit("*"), F.col("held")))).alias("p"), F.length("prefix").alias("way")))
    tried = direct.select("file_id", "source", "app_key", "way", F.posexplode(fn.candidate_files(F.coalesce("p", F.lit("")))).alias("rank", "path"))
    there = files.select("app_key", F.regexp_replace("path", "^/", "").alias("path"), F.col("id").alias("target_file"))
    found = tried.join(there, ["app_key", "path"]).groupBy("file_id", "source").agg(F.min_by("target_file", F.struct((-F.col("way")).alias("w"), "rank")).alias("target_file"))
    package = F.when(F.col("target_file").isNull() & ~relative, fn.package_name(F.col("source")))
    return each.select("file_id", "source").join(found, ["file_id", "source"], "left").withColumn("package", package)


def resolve_exports(parts: Parts, modules: DataFrame) -> DataFrame:
    """(file_id, name, node, resolution) of what each file exports that is a node, also through other files (see :func:`resolve_symbols`)."""
    return resolve_symbols(parts, modules).filter("node is not null").select("file_id", "name", "node", "resolution")


def asked_exports(parts: Parts, modules: DataFrame) -> DataFrame:
    """(file_id, name) that linking one application asks for: what imports name, what exports pass on, and what stands behind a name of a file in a path."""
    there = parts.imports.join(modules.filter("target_file is not null"), ["file_id", "source"])
    wanted = there.select(F.col("target_file").alias("file_id"), F.when(F.col("kind") == "default", "default").when(F.col("kind") == "named", F.col("imported")).alias("name"))
    own = parts.exports.select("file_id", "name")
    again = parts.exports.filter("source is not null").join(modules.filter("target_file is not null"), ["file_id", "source"])
    named = again.filter("kind = 'reexport' and coalesce(local, name) <> '*'").select(F.col("target_file").alias("file_id"), F.coalesce("local", "name").alias("name"))
    behind = again.filter("kind = 'reexport_all'").select("target_file").join(own.withColumnRenamed("file_id", "target_file"), "target_file").select(F.col("target_file").alias("file_id"), "name")
    # util.x: the file that util stands for is asked for x; and so are files that are exported as a whole, whatever stands before their name.
    pairs = parts.refs.withColumn("way", F.concat(F.array("name"), "path")).filter(F.size("path") > 0)
    pairs = pairs.select("scope", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.struct(k.alias("k"), F.get("way", k).alias("l"), F.get("way", k + 1).alias("name")))).alias("p")).select("scope", "p.*").distinct()
    inside = pairs.filter("k = 0").join(parts.scopes.select(F.col("id").alias("scope"), "file_id"), "scope").select("file_id", F.col("l").alias("local"), F.col("name").alias("seg")).distinct()
    members = there.join(inside, ["file_id", "local"]).select(F.col("target_file").alias("file_id"), F.col("seg").alias("name"))
    spaces = again.filter("coalesce(local, name) = '*'").select(F.col("name").alias("l"), "target_file").unionByName(there.filter("kind = 'namespace'").select(F.col("local").alias("l"), "target_file")).distinct()
    deeper = pairs.select("l", "name").distinct().join(spaces, "l").select(F.col("target_file").alias("file_id"), "name")
    return wanted.unionByName(own).unionByName(named).unionByName(behind).unionByName(members).unionByName(deeper).filter("name is not null").distinct()


def roots(parts: Parts, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """``refs`` with what their first name means: node, module (a file), package with first_member, or external; and resolution."""
    closure = ancestors(parts.scopes.select("id", "parent"))
    # ``super`` is sought as the class around it; its parent is found when heritage is known.
    asked = parts.refs.withColumn("__super", F.col("name") == "super").withColumn("name", F.when(F.col("name") == "super", "this").otherwise(F.col("name")))
    inside = nearest(asked, closure, parts.names).withColumn("name", F.when(F.col("__super"), "super").otherwise(F.col("name"))).drop("__super")
    with_file = inside.join(parts.scopes.select(F.col("id").alias("scope"), "file_id"), "scope", "left")
    last = parts.imports.groupBy("file_id", "local").agg(F.max_by(F.struct("imported", "source", "kind"), "seq").alias("i")).select("file_id", F.col("local").alias("name"), "i.*")
    told = with_file.join(last, ["file_id", "name"], "left").join(modules, ["file_id", "source"], "left")
    wanted = F.when(F.col("kind") == "default", "default").when(F.col("kind") == "named", F.col("imported"))
    e = exports.select(F.col("file_id").alias("target_file"), F.col("name").alias("__w"), symbol(**{k: F.col(k) for k in FIELDS}).alias("__e"))
    told = told.withColumn("__w", wanted).join(e, ["target_file", "__w"], "left")
    # One symbol: of a scope, else of an import, else a name that nothing here declares.
    imported = F.when(F.col("package").isNotNull(), symbol(package=F.col("package"), member=F.when(F.col("kind") == "named", F.col("imported"))))
    imported = imported.when((F.col("kind") == "namespace") & F.col("target_file").isNotNull(), symbol(module=F.col("target_file"))).otherwise(F.col("__e"))
    told = told.withColumn("s", F.when(F.col("node").isNotNull(), symbol(node=F.col("node"))).otherwise(imported))
    return told.select(
        *parts.refs.columns, "s.node", "s.module", "s.package", F.col("s.member").alias("first_member"), F.when(F.col("s").isNull(), F.col("name")).alias("external"),
        F.coalesce("s.resolution", F.lit("name_only")).alias("resolution"),
    )


def inherited_members(members: DataFrame, parents: DataFrame, few: int = FEW) -> DataFrame:
    """(holder, name, member) with those of ``parents`` (id, parent, seq): own first, then depth first through parents in order.

    Level by level (see :func:`handed_down`); what is in circles, or below them, and the last ``few`` by their ways.
    """
    ways = parents.filter("id <> parent").groupBy("id", "parent").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(W.partitionBy("id").orderBy("seq", "parent"))
    entry = F.struct("name", F.lit(0).alias("rank"), F.col("node").alias("value"))
    own = members.groupBy(F.col("holder").alias("id")).agg(F.collect_list(entry).alias("held"))
    some = F.array().cast("array<struct<name:string,there:string,rank:int>>")
    found = handed_down(own, ways.select("id", "parent", place.alias("every"), some.alias("some")), few=few)
    if found is None:
        return _by_ways(members, parents)
    settled, left = found
    told = lambda df: df.select(F.col("id").alias("holder"), F.explode("held").alias("x")).select("holder", "x.name", F.col("x.value").alias("member"))
    if left.isEmpty():
        return told(settled)
    with joined_by_size(members.sparkSession):
        above = materialise(parents.join(left, "id", "left_semi"), "parents")
        beside = told(settled.join(above.select(F.col("parent").alias("id")), "id", "left_semi")).withColumnRenamed("member", "node")
        own = members.join(left.withColumnRenamed("id", "holder"), "holder", "left_semi").select("holder", "name", "node")
        rest = _by_ways(materialise(own.unionByName(beside), "members"), above).join(left.withColumnRenamed("id", "holder"), "holder", "left_semi")
        return told(settled).unionByName(materialise(rest, "inherited"))


def _by_ways(members: DataFrame, parents: DataFrame) -> DataFrame:
    """As :func:`inherited_members`, by the first way to each ancestor: any height in few rounds, but a row for each of the ways."""
    own = members.select("holder", "name", F.col("node").alias("member"))
    ways = first_ways(parents)
    none = F.array().cast(ways.schema["way"].dataType)
    above = own.join(ways.select("id", F.col("ancestor").alias("holder"), "way"), "holder").select(F.col("id").alias("holder"), "name", "member", "way")
    every = own.withColumn("way", none).unionByName(above)
    return every.groupBy("holder", "name").agg(F.min_by("member", "way").alias("member"))


def type_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """EXTENDS, IMPLEMENTS and type edges to classes, interfaces and enums that are told without a path."""
    holders = nodes.filter(F.col("type").isin(*HOLDERS)).select(F.col("id").alias("node"))
    some = resolved.filter(F.col("edge").isin(*HERITAGE, *TYPES) & (F.size("path") == 0)).join(holders, "node", "left_semi")
    sure = F.when(F.col("inferred"), "inferred").otherwise(F.col("resolution"))
    told = some.select(F.col("edge").alias("type"), "src", F.col("node").alias("dst"), "idx", sure.alias("resolution"), "seq")
    return first_wins(told, ["type", "src", "dst"], ["seq"])


def types_of(types: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, of, of_external, resolution): the first type of each value, a node or a name from outside (``Map``), whose members its calls are."""
    inside = types.filter("type in ('HAS_TYPE', 'RETURNS_TYPE')").select("src", F.col("dst").alias("of"), F.lit(None).cast("string").alias("of_external"), "resolution", "seq")
    outside = resolved.filter("edge = 'HAS_TYPE' and external is not null and size(path) = 0").select("src", F.lit(None).cast("string").alias("of"), F.col("external").alias("of_external"), F.lit("name_only").alias("resolution"), "seq")
    return first_wins(inside.unionByName(outside), ["src"], ["seq"])


def walk(resolved: DataFrame, parts: Parts, exports: DataFrame, members: DataFrame, type_of: DataFrame) -> DataFrame:
    """``resolved`` uses followed along their paths: node, module, package, external with first_member; rest (what could not be followed), chain (what was met), resolution.

    A step goes from a file to what it exports, from a class, interface or enum,
    or a value of such a type, to a member, and from a value of a type from
    outside to a member of that.
    """
    holders = parts.nodes.filter(F.col("type").isin(*HOLDERS)).select(F.col("id").alias("node"), F.lit(True).alias("holds"))
    known = type_of.select(F.col("src").alias("node"), "of", "of_external", F.col("resolution").alias("of_r"))
    out = exports.select(F.col("file_id").alias("module"), F.col("name").alias("seg"), symbol(**{k: F.col(k) for k in FIELDS}).alias("exported"))
    state = resolved.withColumn("rest", F.col("path")).withColumn("chain", F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array().cast("array<string>"))).withColumn("open", F.lit(True))
    longest = resolved.agg(F.max(F.size("path"))).first()[0] or 0
    for _ in range(longest):
        seg = F.when(F.col("open") & (F.size("rest") > 0), F.get("rest", F.lit(0)))
        s = state.withColumn("seg", seg).join(holders, "node", "left").join(known, "node", "left")
        s = s.withColumn("holder", F.when(F.col("holds"), F.col("node")).otherwise(F.col("of")))
        s = s.join(members.select("holder", F.col("name").alias("seg"), "member_node"), ["holder", "seg"], "left").join(out, ["module", "seg"], "left")
        through = F.when(F.col("holds").isNull(), weaker(F.col("resolution"), F.col("of_r"))).otherwise(F.col("resolution"))
        reached = F.when(F.col("member_node").isNotNull(), F.struct(*symbol_fields(node=F.col("member_node"), resolution=through)))
        reached = reached.when(F.col("exported").isNotNull(), F.struct(*symbol_fields(resolution=weaker(F.col("resolution"), F.col("exported.resolution")), **{k: F.col(f"exported.{k}") for k in FIELDS[:-1]})))
        reached = reached.when(F.col("seg").isNotNull() & F.col("holds").isNull() & F.col("of_external").isNotNull(), F.struct(*symbol_fields(external=F.col("of_external"), member=F.col("seg"), resolution=through)))
        now = F.struct(*symbol_fields(node=F.col("node"), module=F.col("module"), package=F.col("package"), external=F.col("external"), member=F.col("first_member"), resolution=F.col("resolution")))
        s = s.withColumn("reached", F.when(F.col("seg").isNotNull(), reached))
        moved = F.col("reached").isNotNull()
        s = s.withColumn("now", F.coalesce("reached", now))
        s = s.select(
            *(c for c in state.columns if c not in ("node", "module", "package", "external", "first_member", "rest", "chain", "open", "resolution")),
            "now.node", "now.module", "now.package", "now.external", F.col("now.member").alias("first_member"), "now.resolution",
            F.when(moved, F.slice("rest", F.lit(2), F.size("rest"))).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("reached.node").isNotNull(), F.array_append("chain", F.col("reached.node"))).otherwise(F.col("chain")).alias("chain"),
            (F.col("open") & moved).alias("open"),
        )
        old, state = state, materialise(s, "walk")
        discard(old)
    return state


def symbol_fields(**told: Column) -> list[Column]:
    """Columns of a symbol that may stand for a name from outside too."""
    return [(told[k] if k in told else F.lit(None)).cast("string").alias(k) for k in ("node", "module", "package", "external", "member", "resolution")]


def use_edges(walked: DataFrame, nodes: DataFrame, app_key: str) -> DataFrame:
    """Edges of uses, and READS of the values met on the way.

    A call of something that is neither a function nor a class, or whose path
    goes on, is a READS.
    """
    types = nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
    u = walked.filter(~F.col("edge").isin(*HERITAGE, *TYPES)).join(types, "node", "left")
    outside = F.when(F.col("package").isNotNull(), F.concat(F.lit("pkg:"), "package")).otherwise(F.concat(F.lit(f"app:{app_key}/ext:"), F.coalesce("external", F.lit(""))))
    tail = F.array_join(F.concat(F.array_compact(F.array("first_member")), "rest"), ".")
    not_called = (F.col("edge") == "CALLS") & F.col("node").isNotNull() & (~F.coalesce("node_type", F.lit("")).isin("Function", "Class") | (F.size("rest") > 0))
    edge = u.select(
        F.when(not_called, "READS").otherwise(F.col("edge")).alias("type"), "src", F.coalesce("node", "module", outside).alias("dst"), "idx",
        F.coalesce(F.nullif(tail, F.lit("")), "member").alias("member"), "operator", "resolution", "seq",
    )
    met = u.select("src", "seq", F.col("node").alias("last"), F.explode("chain").alias("node")).filter(~F.col("node").eqNullSafe(F.col("last")))
    values = met.join(types.filter("node_type in ('Variable', 'Parameter', 'Field')"), "node", "left_semi")
    none = lambda t: F.lit(None).cast(t)
    return edge.unionByName(values.select(F.lit("READS").alias("type"), "src", F.col("node").alias("dst"), none("int").alias("idx"), none("string").alias("member"), none("string").alias("operator"), F.lit("exact").alias("resolution"), "seq"))


def outside_nodes(edges: DataFrame) -> DataFrame:
    """Package and External nodes that edges go to, each once."""
    ids = edges.select(F.col("dst").alias("id"), (F.col("type") == "BINDS").alias("bound")).filter("id like 'pkg:%' or id like 'app:%/ext:%'")
    ids = ids.groupBy("id").agg(F.max("bound").alias("bound"))
    # What is bound below a package is its member: pkg:name/member, where a name may have a scope (@x/common).
    member = F.regexp_extract("id", r"^pkg:(?:@[^/]+/)?[^/]+/(.+)$", 1)
    of_package = F.col("id").startswith("pkg:")
    is_member = of_package & F.col("bound") & (member != "")
    kind = F.when(of_package & ~is_member, "Package").otherwise("External")
    return ids.select("id", kind.alias("type"), F.when(is_member, member).when(of_package, F.expr("substr(id, 5)")).otherwise(F.expr("substr(id, instr(id, '/ext:') + 5)")).alias("name"))


def with_super(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """``resolved`` with the first of ``parents`` (id, parent, seq) in place of the class that ``super`` was sought as."""
    first = parents.groupBy(F.col("id").alias("node")).agg(F.min_by("parent", "seq").alias("__first"))
    joined = resolved.join(first, "node", "left")
    is_super = F.col("name") == "super"
    # Without a parent, super means nothing.
    kept = joined.filter(~is_super | F.col("__first").isNotNull())
    return kept.withColumn("node", F.when(is_super, F.col("__first")).otherwise(F.col("node"))).select(*resolved.columns)


def export_edges(parts: Parts, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """IMPORTS of what is exported again, and EXPORTS of what a file exports: its own, by name from another, and one level of names behind a star."""
    none = lambda t: F.lit(None).cast(t)
    row = lambda df, kind, dst, member=None: df.select(F.lit(kind).alias("type"), F.col("file_id").alias("src"), dst.alias("dst"), none("int").alias("idx"), (none("string") if member is None else member).alias("member"), none("string").alias("operator"), (F.lit("exact") if kind == "IMPORTS" else F.col("sure")).alias("resolution"), "seq")
    again = parts.exports.filter("source is not null").join(modules, ["file_id", "source"])
    brings = row(again.filter("coalesce(target_file, package) is not null"), "IMPORTS", F.coalesce("target_file", F.concat(F.lit("pkg:"), "package")))
    there = _targets(exports, "package").select(F.col("file_id").alias("f"), F.col("name").alias("n"), "id", "sure")
    own = parts.exports.filter("kind = 'local'").join(_targets(exports, "nodes").select(F.col("file_id").alias("f"), F.col("name").alias("n"), "id", "sure"), (F.col("file_id") == F.col("f")) & (F.col("name") == F.col("n")))
    named = again.filter("kind = 'reexport' and target_file is not null").withColumn("wanted", F.coalesce("local", "name"))
    # A name of a package, or a whole file, has no row of its own to look up.
    outside = again.filter("kind = 'reexport' and (package is not null or coalesce(local, name) = '*')").withColumns({"id": F.coalesce(F.concat(F.lit("pkg:"), "package"), "target_file"), "sure": F.lit("exact")}).filter("id is not null")
    named = named.join(there, (named.target_file == there.f) & (named.wanted == there.n))
    behind = parts.exports.filter("name is not null and name <> 'default'").select(F.col("file_id").alias("target_file"), F.col("name").alias("wanted")).distinct()
    stars = again.filter("kind = 'reexport_all' and target_file is not null").join(behind, "target_file")
    stars = stars.join(there, (stars.target_file == there.f) & (stars.wanted == there.n))
    return brings.unionByName(row(own, "EXPORTS", F.col("id"))).unionByName(row(named, "EXPORTS", F.col("id"))).unionByName(row(outside, "EXPORTS", F.col("id"))).unionByName(row(stars, "EXPORTS", F.col("id")))


def _targets(exports: DataFrame, kind: str) -> DataFrame:
    """file_id, name, id, sure: the node that an edge to an exported symbol goes to.

    ``nodes``: nodes alone; ``package``: files and packages too; ``member``: of a package its member.
    """
    package = F.concat(F.lit("pkg:"), "package")
    if kind == "member":
        package = F.concat_ws("/", package, "member")
    id_ = F.col("node") if kind == "nodes" else F.coalesce("node", "module", package)
    return exports.select("file_id", "name", id_.alias("id"), F.col("resolution").alias("sure")).filter("id is not null")


def link(parts: Parts, app_key: str, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that linking adds to one application's files."""
    asked = parts.imports.select("file_id", "source").unionByName(parts.exports.filter("source is not null").select("file_id", "source"))
    modules = materialise(resolve_modules(asked, parts.files, aliases), "modules")
    exports = resolve_symbols(parts, modules, asked_exports(parts, modules))
    resolved = materialise(roots(parts, modules, exports), "roots")
    types = materialise(type_edges(resolved, parts.nodes), "types")
    parents = types.filter(F.col("type").isin(*HERITAGE)).select(F.col("src").alias("id"), F.col("dst").alias("parent"), "seq")
    resolved = with_super(resolved, parents)
    members = materialise(inherited_members(parts.members, parents).withColumnRenamed("member", "member_node"), "inherited")
    walked = walk(resolved, parts, exports, members, types_of(types, resolved))
    uses = use_edges(walked, parts.nodes, app_key)
    targets = parts.imports.join(modules, ["file_id", "source"])
    e = _targets(exports, "member").select(F.col("file_id").alias("target_file"), F.col("name").alias("__w"), F.col("id").alias("target_id"), "sure")
    bound = targets.withColumn("__w", F.when(F.col("kind") == "default", "default").when(F.col("kind") == "named", F.col("imported"))).join(e, ["target_file", "__w"], "left")
    # import { x } from 'pkg' binds that member of the package; a default import, the package.
    of_package = F.concat_ws("/", F.concat(F.lit("pkg:"), "package"), F.when(F.col("kind") == "named", F.col("imported")))
    bound = bound.withColumns({"target_id": F.when(F.col("package").isNotNull() & F.col("kind").isin("named", "default"), of_package).otherwise(F.col("target_id")), "sure": F.coalesce("sure", F.lit("exact"))})
    none = lambda t: F.lit(None).cast(t)
    row = lambda df, kind, dst, member: df.select(F.lit(kind).alias("type"), F.col("file_id").alias("src"), dst.alias("dst"), none("int").alias("idx"), member.alias("member"), none("string").alias("operator"), (F.lit("exact") if kind == "IMPORTS" else F.col("sure")).alias("resolution"), "seq")
    whole = F.coalesce("target_file", F.concat(F.lit("pkg:"), "package"))
    brings = row(bound.filter(whole.isNotNull()), "IMPORTS", whole, none("string")).unionByName(row(bound.filter("target_id is not null"), "BINDS", F.col("target_id"), F.when(F.col("local") != F.col("imported"), F.col("local"))))
    contains = parts.files.select(F.lit("CONTAINS").alias("type"), F.lit(f"app:{app_key}").alias("src"), F.col("id").alias("dst"), none("int").alias("idx"), none("string").alias("member"), none("string").alias("operator"), F.lit("exact").alias("resolution"), F.lit(0).cast("long").alias("seq"))
    plain = contains.unionByName(types.select(*contains.columns[:4], none("string").alias("member"), none("string").alias("operator"), "resolution", "seq")).unionByName(brings)
    plain = plain.unionByName(export_edges(parts, modules, exports))
    edges = edge_set(plain.withColumn("loc", none("int"))).drop("loc").unionByName(uses)
    app = parts.files.select(F.lit(f"app:{app_key}").alias("id"), F.lit("Application").alias("type"), F.lit(app_key).alias("name")).distinct()
    return app.unionByName(outside_nodes(edges)), edges
