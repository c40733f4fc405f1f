"""Contracts of endpoints, compared; areas that ask for attention, and people who know them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialise

KEYS = ("app_key", "method", "route", "part", "place", "name")
_VARIABLE = r"\{[^/}]*\}|:[^/]+"


def route(path: F.Column) -> F.Column:
    """A path without the names of its variables."""
    return F.regexp_replace(path, _VARIABLE, "{}")


def contract(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(app_key, method, route, part, place, name, type, required) of a graph: each endpoint, its parameters, and what its handler returns.

    Variables of a path are named by their place, so renaming one changes nothing.
    Where several nodes tell the same part of one route, the first by id counts.
    """
    ends = nodes.filter("type = 'Endpoint'").select("id", F.substring_index("id", ":", 1).alias("app_key"), "method", "path", route(F.col("path")).alias("route"))
    of = lambda kind: edges.filter(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias("at")).distinct()
    told = nodes.filter("type = 'HttpParam'").select(F.col("id").alias("at"), "name", F.col("in").alias("place"), F.col("type_name").alias("told"), "required")
    params = ends.join(of("HAS_PARAM"), "id").join(told, "at")
    variables = F.transform(F.regexp_extract_all("path", F.lit(f"({_VARIABLE})"), 1), lambda x: F.regexp_replace(x, r"[{}:]", ""))
    nth = F.array_position(variables, F.col("name"))
    name = F.when((F.col("place") == "path") & (nth > 0), F.concat(F.lit("{"), nth.cast("string"), F.lit("}"))).otherwise(F.col("name"))
    handlers = nodes.filter("type = 'Function'").select(F.col("id").alias("at"), F.col("type_name").alias("told"))
    answers = ends.join(of("HANDLED_BY"), "id").join(handlers, "at")
    row = lambda df, part, at, place, name, told, required: df.select("app_key", "method", "route", F.lit(part).alias("part"), place.alias("place"), name.alias("name"), at.alias("at"), told.alias("type"), required.alias("required"))
    no, nothing = F.lit(False), F.lit(None).cast("string")
    rows = row(ends, "endpoint", F.col("id"), F.lit(""), F.lit(""), nothing, no)
    rows = rows.unionByName(row(params, "parameter", F.col("at"), F.coalesce("place", F.lit("")), F.coalesce(name, F.lit("")), F.col("told"), F.coalesce("required", no)))
    rows = rows.unionByName(row(answers, "response", F.col("at"), F.lit(""), F.lit(""), F.col("told"), no))
    first = rows.groupBy(*KEYS).agg(F.min_by(F.struct("type", "required"), "at").alias("v"))
    return first.select(*KEYS, "v.type", "v.required")


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(app_key, method, route, place, name, change, breaking) between two contracts.

    Breaking: an endpoint is gone; a parameter has become, or came as, required;
    a parameter's or an answer's type is another.  Not breaking: what is new or no
    longer asked for, and a type that one side does not tell (``.._type_untold``).
    Parts of endpoints that came or went are not told one by one.  Both sides are
    read once and meet in one aggregation.
    """
    side = lambda df, s: df.select(*KEYS, F.struct("type", "required").alias("v"), F.lit(s).alias("side"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    both = materialise(side(old, "old").unionByName(side(new, "new")).groupBy(*KEYS).agg(of("old").alias("o"), of("new").alias("n")), "contracts")
    had, has = F.col("o").isNotNull(), F.col("n").isNotNull()
    say = lambda test, change, breaking: F.when(test, F.struct(F.lit(change).alias("change"), F.lit(breaking).alias("breaking")))
    is_end, is_param = F.col("part") == "endpoint", F.col("part") == "parameter"
    needs, needed = F.col("n.required"), F.coalesce(F.col("o.required"), F.lit(False))
    other = had & has & ~F.col("o.type").eqNullSafe(F.col("n.type"))
    known = F.col("o.type").isNotNull() & F.col("n.type").isNotNull()
    changes = F.array_compact(F.array(
        say(is_end & ~has, "endpoint_removed", True), say(is_end & ~had, "endpoint_added", False),
        say(is_param & has & needs & ~needed, "parameter_required", True), say(is_param & ~had & ~needs, "parameter_added", False),
        say(is_param & ~has, "parameter_removed", False), say(is_param & had & has & needed & ~needs, "parameter_optional", False),
        say(other & known & is_param, "parameter_type", True), say(other & known & ~is_param, "response_type", True),
        say(other & ~known & is_param, "parameter_type_untold", False), say(other & ~known & ~is_param, "response_type_untold", False),
    ))
    kept = both.filter(is_end & had & has).select("app_key", "method", "route")
    told = both.select(*KEYS, F.explode(changes).alias("c"))
    inner = told.filter(~is_end).join(kept, ["app_key", "method", "route"], "left_semi")
    return told.filter(is_end).unionByName(inner).select("app_key", "method", "route", "place", "name", "c.change", "c.breaking")


def broken_requests(diff: DataFrame, requests: DataFrame) -> DataFrame:
    """(caller, app_key, method, route, change) of ``requests`` (caller, app_key, method, path) to what ``diff`` breaks."""
    asked = requests.select("caller", "app_key", "method", route(F.col("path")).alias("route")).distinct()
    return asked.join(diff.filter("breaking").select("app_key", "method", "route", "change").distinct(), ["app_key", "method", "route"]).select("caller", "app_key", "method", "route", "change")


def contract_values(diff: DataFrame) -> DataFrame:
    """(rule, value) of the rule ``contract_breaking``: how many breaking changes there are."""
    return diff.agg(F.count_if("breaking").alias("value")).select(F.lit("contract_breaking").alias("rule"), "value")


def in_areas(touched: DataFrame, patterns: DataFrame) -> DataFrame:
    """(area, id) of ``touched`` (id, kind, text) that ``patterns`` (area, kind, prefix, pattern) match, each once.

    ``kind`` is ``path``, ``node`` or ``endpoint``; ``prefix``: the folders before the
    pattern's first wild card, with a slash at their end.  A text meets only the
    patterns of folders that it is in, by an equal join.
    """
    steps = F.split("text", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))))
    each = touched.filter("text is not null").select("id", "kind", "text", F.explode(folders).alias("prefix")).distinct()
    return each.join(patterns, ["kind", "prefix"]).filter("text rlike pattern").select("area", "id").distinct()


def reviewers(touched: DataFrame, owns: DataFrame, last: DataFrame, authors: DataFrame, since: F.Column, most: int = 2) -> DataFrame:
    """(person, share, place): at most ``most`` people for a review of ``touched`` (id), a top list.

    Who owns most of it by ``owns`` (id, person, share) comes first, then who was
    last at it by ``last`` (id, person, time), then by name.  Left out: ``authors``
    (person) of the change, and who did nothing anywhere in ``last`` after ``since``.
    """
    ids = touched.select("id").distinct()
    active = last.filter(F.col("time") >= since).select("person").distinct()
    share = owns.join(ids, "id", "left_semi").join(authors, "person", "left_anti").join(active, "person", "left_semi").groupBy("person").agg(F.sum("share").alias("share"))
    times = last.join(ids, "id", "left_semi").groupBy("person").agg(F.max("time").alias("time"))
    ranked = share.join(times, "person", "left").orderBy(F.desc("share"), F.desc_nulls_last("time"), "person").limit(most)
    return ranked.select("person", "share", F.row_number().over(W.orderBy(F.desc("share"), F.desc_nulls_last("time"), "person")).alias("place"))


def area_gates(hits: DataFrame, required: DataFrame, owns: DataFrame, approvals: DataFrame) -> DataFrame:
    """(area, required, approved) of areas in ``hits`` (area, id) that fewer owners of what was touched there approved than ``required`` (area, required) asks for.

    ``owns``: id, person; ``approvals``: person.
    """
    touched = hits.select("area").distinct().join(required.filter("required > 0"), "area")
    knowing = owns.select("id", "person").join(approvals.select("person").distinct(), "person", "left_semi")
    approved = hits.join(knowing, "id").groupBy("area").agg(F.countDistinct("person").alias("approved"))
    counted = touched.join(approved, "area", "left").select("area", "required", F.coalesce("approved", F.lit(0)).alias("approved"))
    return counted.filter("approved < required")
