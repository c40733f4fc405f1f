"""What a change may reach: how surely, in which applications, which tests and gates it touches; and which node a trace means."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import rank
from ..tables import materialise
from .spans import innermost, within

#: Edges that a change goes back along, and those that a test uses what it tests by.
DEPENDS = ("INVOKES", "CALLS", "READS", "HAS_TYPE", "EXTENDS", "IMPLEMENTS", "IMPORTS")
TESTED_BY = ("CALLS", "INVOKES", "INSTANTIATES")
#: Paths of tests, and of configurations on which every test may depend.
TEST_PATH = r"\.(spec|test)\.[cm]?[jt]sx?$|(^|/)__tests__/"
CONFIGURATION = r"(^|/)(package\.json|tsconfig[^/]*\.json|jest\.config\.[^/]*)$"
#: Rule, level, the most that it allows.
RULES = (("contract_breaking", "error", 0), ("exported_signature_changed", "warning", 0), ("blast_radius", "warning", 5), ("unresolved_increase", "warning", 10))


def _named(sure: F.Column) -> F.Column:
    return F.when(sure == 2, "name_only").when(sure == 1, "inferred").otherwise("exact")


def backwards(edges: DataFrame, kinds: tuple[str, ...] = DEPENDS) -> DataFrame:
    """(src, dst, resolution) from what is used to what uses it."""
    return edges.filter(F.col("type").isin(*kinds)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "resolution")


def sure_reach(edges: DataFrame, starts: DataFrame, depth: int | None = 5, stops: DataFrame | None = None) -> DataFrame:
    """(start, node, distance, resolution): nodes within ``depth`` steps over ``edges`` (src, dst, resolution), by the shortest way.

    ``resolution`` is that of the way's weakest step; of several shortest ways the
    surest counts.  Beyond ``stops`` (node) no way goes on; without ``depth`` ways
    end where nothing new is found.  Each round joins only what was new in the last.
    """
    steps = materialise(edges.groupBy("src", "dst").agg(F.min(rank(F.col("resolution"))).alias("step")), "sure-steps")
    new = seen = materialise(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), F.lit(0).alias("sure")).distinct(), "sure-reach")
    for d in count(1) if depth is None else range(1, depth + 1):
        open_ = new if stops is None else new.join(stops.select("node").distinct(), "node", "left_anti")
        met = open_.join(steps, open_.node == steps.src).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.greatest("sure", "step")).alias("sure"))
        met = met.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("distance"), "sure")
        new = materialise(met, "sure-reach")
        seen = seen.unionByName(new)
        if new.isEmpty():
            break
    return seen.filter("distance > 0").select("start", "node", "distance", _named(F.col("sure")).alias("resolution"))


def consumers(changed: DataFrame, handled: DataFrame, requests: DataFrame, callers: DataFrame, invokes: DataFrame, depth: int = 6) -> DataFrame:
    """(id, node, distance, resolution): functions of any application that reach a changed one of ``changed`` (id) through its endpoints.

    ``handled``: endpoint, id; ``requests``: call, endpoint, resolution;
    ``callers``: call, owner; ``invokes``: src, dst, resolution.  Whoever requests
    an endpoint is at distance 0, those above follow ``invokes`` backwards.
    """
    ends = handled.join(changed.select("id").distinct(), "id", "left_semi")
    first = requests.join(ends, "endpoint").join(callers, "call").groupBy("id", F.col("owner").alias("start")).agg(F.min(rank(F.col("resolution"))).alias("first"))
    first = materialise(first, "consumers")
    up = sure_reach(invokes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "resolution"), first.select("start"), depth)
    above = first.join(up, "start").select("id", "node", "distance", F.greatest("first", rank(F.col("resolution"))).alias("sure"))
    own = first.select("id", F.col("start").alias("node"), F.lit(0).alias("distance"), F.col("first").alias("sure"))
    best = own.unionByName(above).groupBy("id", "node").agg(F.min(F.struct("distance", "sure")).alias("b"))
    return best.select("id", "node", "b.distance", _named(F.col("b.sure")).alias("resolution"))


def affected_tests(changed: DataFrame, changed_paths: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, reason) of test files among ``files`` (id, path): changed, or reached by a use of ``changed`` (id).

    In doubt it is all of them, for the reason ``doubt``: a configuration among
    ``changed_paths`` (path), a changed path that is no file of the graph, or a use
    that is known by its name only.  A node is in the file before its ``#``.
    """
    file_of = lambda c: F.substring_index(c, "#", 1)
    tests = files.filter(F.col("path").rlike(TEST_PATH)).select("id", "path")
    uses = sure_reach(backwards(edges, TESTED_BY), changed.select(F.col("id").alias("start")), None)
    odd = changed_paths.filter(F.col("path").rlike(CONFIGURATION)).select("path").unionByName(changed_paths.join(files, "path", "left_anti").select("path"))
    if not odd.isEmpty() or not uses.filter("resolution = 'name_only'").isEmpty():
        return tests.select("path", F.lit("doubt").alias("reason"))
    own = tests.join(changed_paths.select("path").distinct(), "path", "left_semi").select("path", F.lit("changed").alias("reason"))
    reached = tests.join(uses.select(file_of("node").alias("id")).distinct(), "id", "left_semi").select("path", F.lit("reached").alias("reason"))
    return own.unionByName(reached).groupBy("path").agg(F.min("reason").alias("reason"))


def gate_values(diff: DataFrame, endpoints: DataFrame, exported: DataFrame, edges: DataFrame, reached: DataFrame, old_open: DataFrame, new_open: DataFrame) -> DataFrame:
    """(rule, value) of a change.

    ``diff``: id, change; ``endpoints`` and ``exported``: id; ``edges``: src, dst;
    ``reached``: node; ``old_open`` and ``new_open``: id of what each version left unresolved.
    """
    ends = endpoints.select("id").distinct()
    n = lambda rule, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(rule).alias("rule"), "value")
    removed = diff.filter("change = 'removed'").join(ends, "id", "left_semi")
    shown = diff.filter("change = 'signature'").join(exported.select("id").distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    hit = reached.select(F.col("node").alias("id")).distinct().join(ends, "id", "left_semi")
    open_ = new_open.select(F.lit(1).alias("n")).unionByName(old_open.select(F.lit(-1).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
    return n("contract_breaking", removed).unionByName(n("exported_signature_changed", shown)).unionByName(n("blast_radius", hit)).unionByName(open_.select(F.lit("unresolved_increase").alias("rule"), "value"))


def gates(values: DataFrame, rules: tuple[tuple[str, str, int], ...] = RULES) -> DataFrame:
    """(rule, level, value, most) of the rules that ``values`` (rule, value) break."""
    table = values.sparkSession.createDataFrame(list(rules), "rule string, level string, most long")
    return values.join(F.broadcast(table), "rule").filter("value > most").select("rule", "level", "value", "most")


def trace_nodes(traces: DataFrame, frames: DataFrame, declarations: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(trace, node, resolution) of ``traces`` (trace, file_id, line, app_key, method, route, name), the best there is; null if nothing fits.

    In this order: the innermost of ``declarations`` (id, qualified, name,
    file_id, start_line, end_line, seq) around the line; around the first of
    ``frames`` (trace, pos, file_id, line) that is in any; the one of ``endpoints``
    (id, app_key, method, path) of that route; a declaration of that qualified
    name; one of that bare name in the file.  Ties go to the smallest id.
    """
    spans = declarations.select(F.col("id").alias("span_id"), "file_id", "start_line", "end_line", "seq")
    told = lambda df, place, sure, node: df.select("trace", F.lit(place).alias("place"), F.col(node).alias("node"), F.lit(sure).alias("resolution"))
    by_line = told(innermost(traces.filter("file_id is not null and line is not null").select("file_id", "line", "trace"), spans), 1, "exact", "span_id")
    inner = innermost(frames.select("file_id", "line", "trace", "pos"), spans).groupBy("trace").agg(F.min_by("span_id", F.struct("pos", "span_id")).alias("span_id"))
    routes = endpoints.select("app_key", F.upper("method").alias("method"), F.col("path").alias("route"), F.col("id").alias("endpoint"))
    by_route = told(traces.withColumn("method", F.upper("method")).join(routes, ["app_key", "method", "route"]), 3, "exact", "endpoint")
    by_name = told(traces.join(declarations.select(F.col("qualified").alias("name"), "id"), "name"), 4, "inferred", "id")
    bare = declarations.select("file_id", "name", "id")
    by_file = told(traces.withColumn("name", F.substring_index("name", ".", -1)).join(bare, ["file_id", "name"]), 5, "name_only", "id")
    all_ = by_line.unionByName(told(inner, 2, "exact", "span_id")).unionByName(by_route).unionByName(by_name).unionByName(by_file)
    best = all_.groupBy("trace").agg(F.min(F.struct("place", "node", "resolution")).alias("b")).select("trace", "b.node", "b.resolution")
    return traces.select("trace").distinct().join(best, "trace", "left")


def body_hashes(tokens: DataFrame, declarations: DataFrame, nameless: bool = False) -> DataFrame:
    """(id, body_hash): Sha-256 of the tokens of each of ``declarations`` (id, file_id, start_line, start_col, end_line), one a line.

    ``tokens`` is (file_id, i, tok, line, col), without comments and white space, so
    neither those nor a move changes a hash.  What else is on the last line counts.
    ``nameless``: the first token that is the declaration's own ``name`` is left out.
    """
    spans = declarations.select(F.col("id").alias("span_id"), "file_id", "start_line", "start_col", "end_line")
    # Spark guesses the size of tokens by that of the files that hold the texts, far too low: neither side is broadcast.
    met = within(tokens.select("file_id", "line", "col", "i", "tok").hint("merge"), spans).filter("line > start_line or col >= start_col")
    held = met.groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("i", "tok"))).alias("toks"))
    words = held.select(F.col("span_id").alias("id"), F.transform("toks", lambda x: x["tok"]).alias("words"))
    if nameless:
        named = words.join(declarations.select("id", "name"), "id").withColumn("k", F.array_position("words", F.col("name")).cast("int"))
        words = named.withColumn("words", F.when(F.col("k") > 0, F.concat(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.col("k") + 1, F.size("words")))).otherwise(F.col("words")))
    return words.select("id", F.sha2(F.array_join("words", "\n"), 256).alias("body_hash"))


def signature_hashes(nodes: DataFrame) -> DataFrame:
    """(id, signature_hash) of the functions of a graph: name, modifiers, type, decorators and the parameters in order."""
    text = lambda *names: F.concat_ws("|", *(F.coalesce(F.to_json(F.struct(n)), F.lit("")) for n in names))
    of = nodes.filter("type = 'Parameter'").groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", text("name", "type_name", "optional", "has_default", "variadic").alias("t")))).alias("ps"))
    own = nodes.filter("type = 'Function'").select("id", text("name", "async", "static", "abstract", "override", "private", "protected", "type_name", "decorators").alias("t"))
    told = F.concat_ws("\n", "t", F.transform("ps", lambda x: x["t"]))
    return own.join(of, "id", "left").select("id", F.sha2(told, 256).alias("signature_hash"))
