"""Contracts, critical areas, reviewers and configured rules, on small tables of our own."""

import json

import pytest
from pyspark.sql import functions as F

from weftspark.operators import contracts, impact
from weftspark.sources.config import Gates, glob_pattern, load_gates

NODE = "id string, type string, method string, path string, name string, `in` string, type_name string, required boolean"
EDGE = "type string, src string, dst string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def side(spark, *ends):
    """Endpoints as (method, path, answer, [(place, name, type, required)])."""
    nodes, edges = [], []
    for i, (method, path, answer, params) in enumerate(ends):
        end = f"app:c.ts#endpoint:{i}"
        nodes += [(end, "Endpoint", method, path, None, None, None, None), (f"f{i}", "Function", None, None, "f", None, answer, None)]
        edges.append(("HANDLED_BY", end, f"f{i}"))
        for k, (place, name, told, required) in enumerate(params):
            nodes.append((f"{i}/{k}", "HttpParam", None, None, name, place, told, required))
            edges += [("HAS_PARAM", end, f"{i}/{k}")] * 2
    return contracts.contract(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def changes(old, new):
    return sorted((r.method, r.route, r.name, r.change, r.breaking) for r in contracts.contract_diff(old, new).collect())


def test_each_change_of_a_contract_is_told_once(spark):
    old = side(spark,
        ("GET", "/users/{id}", "User", [("path", "id", "string", True), ("query", "page", "number", False), ("query", "old", "string", True), ("header", "key", None, True)]),
        ("GET", "/gone/:x", "X", [("query", "q", "string", True)]), ("POST", "/users", None, [("body", "user", "NewUser", True)]), ("PUT", "/same/{a}/{b}", "S", [("path", "a", "string", True), ("path", "b", "number", True)]),
    )
    new = side(spark,
        ("GET", "/users/:userId", "UserView", [("path", "userId", "number", True), ("query", "page", "number", True), ("query", "sort", "string", False), ("query", "must", "string", True), ("header", "key", "string", False)]),
        ("GET", "/fresh", "X", [("query", "q", "string", True)]), ("POST", "/users", "User", [("body", "user", "User", True)]), ("PUT", "/same/{x}/{y}", "S", [("path", "x", "string", True), ("path", "y", "number", True)]),
    )
    one = "/users/{}"
    assert changes(old, new) == sorted([
        ("GET", "/gone/{}", "", "endpoint_removed", True), ("GET", "/fresh", "", "endpoint_added", False), ("GET", one, "", "response_type", True), ("GET", one, "{1}", "parameter_type", True),
        ("GET", one, "page", "parameter_required", True), ("GET", one, "must", "parameter_required", True), ("GET", one, "sort", "parameter_added", False), ("GET", one, "old", "parameter_removed", False),
        ("GET", one, "key", "parameter_optional", False), ("GET", one, "key", "parameter_type_untold", False), ("POST", "/users", "", "response_type_untold", False), ("POST", "/users", "user", "parameter_type", True),
    ])
    assert changes(old, old) == [] and changes(side(spark, ("GET", "/a", None, [])).limit(0), old.limit(0)) == []
    diff = contracts.contract_diff(old, new)
    asked = spark.createDataFrame([("b#f", "app", "GET", "/gone/{y}"), ("b#f", "app", "GET", "/gone/:z"), ("b#g", "app", "PUT", "/same/{a}/{b}"), ("b#h", "other", "GET", "/gone/{y}")], "caller string, app_key string, method string, path string")
    assert rows(contracts.broken_requests(diff, asked)) == [("b#f", "app", "GET", "/gone/{}", "endpoint_removed")]
    assert rows(contracts.contract_values(diff)) == [("contract_breaking", 6)]
    assert rows(contracts.contract_values(diff.limit(0))) == [("contract_breaking", 0)]


def test_areas_meet_paths_nodes_and_endpoints(spark):
    gates = Gates.of({"critical": [{"name": "auth", "match": ["src/auth/**", "**/login.?s"], "require_reviewers": 1}, {"name": "billing", "match": ["endpoint:POST /payments", "src/(x)/*.ts"]}], "stop_nodes": ["src/shared/logger.ts#*", "src/utils/**"]}, impact.RULES)
    schema = "area string, kind string, prefix string, pattern string"
    touched = spark.createDataFrame([
        ("1", "path", "src/auth/a/b.ts"), ("1", "path", "src/auth/a/b.ts"), ("2", "path", "src/auther/c.ts"), ("3", "path", "login.js"), ("4", "path", "a/b/login.ts"), ("5", "path", "src/(x)/y.ts"), ("6", "path", "src/(x)/y/z.ts"),
        ("7", "endpoint", "POST /payments"), ("8", "endpoint", "POST /payments/1"), ("9", "path", None), ("10", "path", "src/authXlogin.ts"),
    ], "id string, kind string, text string")
    assert rows(contracts.in_areas(touched, spark.createDataFrame(gates.patterns(), schema))) == [("auth", "1"), ("auth", "3"), ("auth", "4"), ("billing", "5"), ("billing", "7")]
    stops = spark.createDataFrame([("a", "node", "src/shared/logger.ts#log"), ("b", "node", "src/shared/other.ts#log"), ("c", "path", "src/utils/deep/x.ts")], "id string, kind string, text string")
    assert rows(contracts.in_areas(stops, spark.createDataFrame(gates.stops(), schema))) == [("stop", "a"), ("stop", "c")]
    assert glob_pattern("a/b*/c")[0] == "a/" and glob_pattern("**")[0] == ""


def test_reviewers_know_the_code_and_are_there(spark):
    touched = spark.createDataFrame([("f",), ("g",), ("g",)], "id string")
    owns = spark.createDataFrame([("f", "ann", 0.5), ("g", "ann", 0.25), ("f", "bob", 0.5), ("g", "cid", 0.75), ("g", "dan", 0.5), ("h", "eve", 1.0)], "id string, person string, share double")
    last = spark.createDataFrame([("f", "ann", 9), ("f", "bob", 8), ("g", "cid", 1), ("h", "dan", 7)], "id string, person string, time long")
    authors = spark.createDataFrame([("ann",)], "person string")
    assert rows(contracts.reviewers(touched, owns, last, authors, F.lit(5))) == [("bob", 0.5, 1), ("dan", 0.5, 2)]
    assert rows(contracts.reviewers(touched, owns, last, authors.limit(0), F.lit(0), 3)) == [("ann", 0.75, 1), ("bob", 0.5, 3), ("cid", 0.75, 2)]
    hits = spark.createDataFrame([("auth", "f"), ("auth", "g"), ("billing", "g"), ("free", "h")], "area string, id string")
    needed = spark.createDataFrame([("auth", 2), ("billing", 1), ("free", 0), ("idle", 1)], "area string, required long")
    approvals = lambda *p: spark.createDataFrame([(x,) for x in p], "person string")
    assert rows(contracts.area_gates(hits, needed, owns, approvals("bob", "bob", "eve"))) == [("auth", 2, 1), ("billing", 1, 0)]
    assert rows(contracts.area_gates(hits, needed, owns, approvals("bob", "cid"))) == []


def test_rules_come_from_a_configuration(spark, tmp_path):
    told = {"mode": "enforce", "rules": {"blast_radius": {"level": "error", "max_endpoints": 2}, "contract_breaking": {"allow_label": "approved"}, "unresolved_increase": {"level": "off"}}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(told))
    gates = load_gates(str(path), impact.RULES)
    assert gates.enforce and gates.active(("approved",)) == (("exported_signature_changed", "warning", 0), ("blast_radius", "error", 2))
    values = spark.createDataFrame([("contract_breaking", 1), ("blast_radius", 3), ("exported_signature_changed", 0), ("unresolved_increase", 99)], "rule string, value long")
    assert rows(impact.gates(values, gates.active())) == [("blast_radius", "error", 3, 2), ("contract_breaking", "error", 1, 0)]
    assert load_gates(None, impact.RULES).active() == impact.RULES
    for bad in ({"mode": "loud"}, {"rules": {"none": {}}}, {"rules": {"blast_radius": {"level": "high"}}}):
        with pytest.raises(ValueError):
            Gates.of(bad, impact.RULES)
