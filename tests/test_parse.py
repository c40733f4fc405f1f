"""What source texts give: declarations, statements, uses, contracts, modules, on files of our own."""

import pytest

from weftspark import api
from weftspark.model import Graph
from weftspark.parse.tokens import streams, tokens

FILES = {
    "src/main.js": """// import ghost from 'ghost'
const { helper, other: twin } = require('./util');
const fs = require('node:fs');
require('./side');
const text = "import x from 'fake'";
const obj = { a: 1, b: 2 };
const arr = [10, 20];
class Counter extends Base {
  constructor(n) { super(n); this.value = n; this.cache = new Map(); }
  inc(by = 1) { this.value += by; super.go(by); return this.value; }
}
class Base { go(by) { return by; } }
function run(list) {
  const { a, b: aliased } = obj;
  const [x, , z] = arr;
  let sum = 0
  for (const item of list) {
    if (item.skip && sum > 3) continue;
    sum += item.size
  }
  while (sum < 10) { sum++; if (sum === 7) break; }
  try { helper(a, twin(aliased)); } catch (err) { throw new Error(`bad ${err.message}`); }
  switch (x) { case 1: return z; default: sum = 2; }
  const url = process.env.USERS_URL || 'http://users:8080';
  list.map(v => v * 2).filter((v) => { return v > sum; });
  a.b.c.d.e.f.g.h.i.j(x);
  return a + aliased + x + z;
}
const start = async (port) => { await kafka.send('made', port); };
start(8080).catch(report);
module.exports = { run, Counter };
""",
    "src/empty.js": "",
    "src/comment.ts": "// only a comment\n",
    "src/side.js": "let one = 1, two = 2;\n",
    "src/plain.ts": "export default class extends Base { go(x) { return x; } }\n",
    "src/lone.js": "export default async (x) => { return x; }\n",
    "src/word.js": "export default function (x) { return x; }\n",
    "src/uses.js": "import Plain from './plain';\nimport lone from './lone';\nimport word from './word';\nlone(word(1));\nnew Plain();\n",
    "src/util.js": "function helper(v) { return v; }\nfunction other(w) { return w }\nmodule.exports = { helper, other };\n",
    "src/api.ts": """import { Injectable, type Thing } from '@x/common';
import { Repo as Store, Kind } from './repo';
export * as kinds from './repo';
@Injectable()
@Controller('orders')
export class Orders {
  private readonly cache = new Map<string, Store>();
  static LIMIT: number = 10;
  handler = (x: Store): void => { this.cache.get(x.name); };
  constructor(private readonly repo: Store, @Inject('k') protected other?: Kind) {}
  @Get(':id')
  async one(@Param('id') id: string, @Query() q?: string): Promise<Store | undefined> {
    const found = await this.repo.find(id);
    return found as Store;
  }
  @Post()
  make(@Body() body: Map<string, Kind>) { return this.repo.save({ body, n: Kind.Big }); }
}
@Controller('users')
export class Users extends Base<Kind> implements Entity, Two.Deep {
  @Get('all')
  list(...rest: string[]) { return rest; }
}
""",
    "src/repo.ts": """export enum Kind { Big = 'b', Small = 's' }
export interface Entity { id: string; name?: string; find(id: string): Entity }
export abstract class Repo implements Entity {
  id: string
  abstract find(id: string): Repo;
  save(x: any) { return x; }
}
export default Repo;
type Alias = Repo | Kind;
""",
}
M, A, R, U = "src/main.js", "src/api.ts", "src/repo.ts", "src/util.js"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(p, "javascript" if p.endswith("js") else "typescript", "h", bytearray(t.encode())) for p, t in FILES.items()]
    g = api.extract(spark, spark.createDataFrame(rows, "path string, language string, hash string, content binary"), "k")
    short = lambda x: x.removeprefix("k:")
    nodes = {short(r.id): r for r in g.nodes.collect()}
    edges = {(r.type, short(r.src), short(r.dst)): r for r in g.edges.collect()}
    return nodes, edges


def has(edges, *wanted):
    missing = [w for w in wanted if w not in edges]
    assert not missing, missing


def test_declarations(graph):
    nodes, edges = graph
    kinds = {i: n.type for i, n in nodes.items()}
    assert {i for i, t in kinds.items() if t == "Variable" and i.startswith("src/side")} == {"src/side.js#one", "src/side.js#two"}
    assert nodes[f"{M}#run"].kind == "declaration" and nodes[f"{M}#start"].kind == "arrow" and nodes[f"{M}#start"]["async"]
    assert nodes[f"{A}#Orders.one"].type_name == "Promise<Store | undefined>" and nodes[f"{A}#Orders.one"].decorators == ["Get(':id')"]
    assert nodes[f"{A}#Orders"].decorators == ["Injectable()", "Controller('orders')"] and nodes[f"{A}#Orders"].exported
    assert nodes[f"{R}#Kind.Big"].value == "'b'" and nodes[f"{R}#Entity.name"].optional
    assert nodes[f"{A}#Orders.handler"].type == "Function" and nodes[f"{A}#Orders.LIMIT"].static
    has(edges, ("HAS_METHOD", f"{R}#Repo", f"{R}#Repo.find"), ("HAS_MEMBER", f"{R}#Kind", f"{R}#Kind.Small"), ("HAS_FIELD", f"{R}#Entity", f"{R}#Entity.id"))


def test_parameters(graph):
    nodes, edges = graph
    p = nodes[f"{A}#Orders.constructor(other)"]
    assert (p.idx, p.optional, p.protected, p.type_name, p.decorators) == (1, True, True, "Kind", ["Inject('k')"])
    assert nodes[f"{M}#Counter.inc(by)"].has_default and nodes[f"{A}#Users.list(rest)"].variadic
    # A parameter with a modifier is a field too.
    has(edges, ("HAS_FIELD", f"{A}#Orders", f"{A}#Orders.repo"), ("WRITES", f"{A}#Orders.constructor", f"{A}#Orders.repo"), ("HAS_TYPE", f"{A}#Orders.repo", f"{R}#Repo"))


def test_types(graph):
    _, edges = graph
    has(edges, ("RETURNS_TYPE", f"{A}#Orders.one", f"{R}#Repo"), ("HAS_TYPE", f"{A}#Orders.handler(x)", f"{R}#Repo"), ("IMPLEMENTS", f"{R}#Repo", f"{R}#Entity"))
    arg = edges["HAS_TYPE_ARG", f"{A}#Orders.cache", f"{R}#Repo"]
    assert (arg.idx, arg.resolution) == (1, "inferred") and edges["HAS_TYPE_ARG", f"{A}#Orders.make(body)", f"{R}#Kind"].idx == 1


def test_calls_and_arguments(graph):
    nodes, edges = graph
    has(edges, ("CALLS", f"{A}#Orders.one/call@13:25", f"{R}#Repo.find"), ("READS", f"{A}#Orders.one/call@13:25", f"{A}#Orders.repo"), ("CALLS", f"{M}#run/call@22:19", f"{U}#other"))
    assert edges["ARGUMENT", f"{M}#run/call@22:9", f"{M}#run/call@22:19"].idx == 1  # a call handed over
    assert edges["ARGUMENT", f"{M}#run/call@22:57", f"{M}#run.err"].member == "message"  # in a template
    assert nodes[f"{A}#Orders.one/call@13:25"].awaited and nodes[f"{A}#Orders.one/call@13:25"].callee_text == "this.repo.find"
    # A path of ten names is one path.
    assert edges["READS", f"{M}#run/call@26:3", f"{M}#run.a"].member == "b.c.d.e.f.g.h.i.j"
    # Chained calls: the outer one reads the inner one.
    assert nodes[f"{M}#run/call@25:3"].callee_text == "list.map(v => v * 2).filter"
    has(edges, ("READS", f"{M}#run/call@25:3", f"{M}#run/call@25:3@25"), ("ARGUMENT", f"{M}#run/call@25:3", f"{M}#run.fn@25:31"), ("ARGUMENT", f"{M}#run/call@25:3@25", f"{M}#run.fn@25:12"))
    assert edges["INVOKES", f"{M}#run", f"{M}#run.fn@25:31"].resolution == "inferred"


def test_super(graph):
    _, edges = graph
    has(edges, ("CALLS", f"{M}#Counter.constructor/call@9:20", f"{M}#Base"), ("CALLS", f"{M}#Counter.inc/call@10:35", f"{M}#Base.go"))


def test_writes_and_destructuring(graph):
    nodes, edges = graph
    assert nodes[f"{M}#Counter.inc#Assignment@10:17"].operator == "+="
    assert edges["WRITES", f"{M}#Counter.inc#Assignment@10:17", f"{M}#Counter.value"].operator == "+="
    assert edges["WRITES", f"{M}#run#Assignment@21:22", f"{M}#run.sum"].operator == "++"
    member = {d.rsplit(".", 1)[1]: e.member for (t, s, d), e in edges.items() if t == "FLOWS_TO" and s in (f"{M}#obj", f"{M}#arr")}
    assert member == {"a": "a", "aliased": "b", "x": "0", "z": "2"}


def test_statements(graph):
    nodes, edges = graph
    of = lambda t: sorted((i.split("#")[-1], n.kind) for i, n in nodes.items() if n.type == t and i.startswith(f"{M}#run#"))
    assert of("Loop") == [("Loop@17:3", "for_of"), ("Loop@21:3", "while")] and of("Jump") == [("Jump@18:31", "continue"), ("Jump@21:44", "break")]
    assert {n.condition_text for i, n in nodes.items() if n.type == "If"} == {"(item.skip && sum > 3)", "(sum === 7)"}
    assert [len(of(t)) for t in ("Try", "Catch", "Throw", "Switch", "Case", "Return")] == [1, 1, 1, 1, 2, 2]
    has(edges, ("THROWS", f"{M}#run", f"{M}#run#Throw@22:51"), ("NEXT", f"{M}#run#Loop@17:3", f"{M}#run#Loop@21:3"), ("NEXT", f"{M}#run#Loop@21:3", f"{M}#run#Try@22:3"), ("NEXT", f"{M}#run/call@26:3", f"{M}#run#Return@27:3"))
    assert nodes[f"{M}#run.item"].kind == "loop" and nodes[f"{M}#run.err"].kind == "catch"


def test_flows(graph):
    _, edges = graph
    has(edges, ("FLOWS_TO", f"{M}#run.a", f"{U}#helper(v)"), ("FLOWS_TO", f"{M}#run.a", f"{M}#run#Return@27:3"), ("FLOWS_TO", f"{M}#run#Return@27:3", f"{M}#run"), ("FLOWS_TO", f"{A}#Orders.one(id)", f"{R}#Repo.find(id)"))


def test_contracts(graph):
    nodes, edges = graph
    end = f"{A}#k:{A}#endpoint:GET /orders/:id"
    assert {(n.method, n.path) for n in nodes.values() if n.type == "Endpoint"} == {("GET", "/orders/:id"), ("POST", "/orders"), ("GET", "/users/all")}
    told = {(n["in"], n.name, n.required, n.type_name) for n in nodes.values() if n.type == "HttpParam"}
    assert told == {("path", "id", True, "string"), ("query", "q", False, "string"), ("body", "body", True, "Map<string, Kind>")}
    has(edges, ("EXPOSES", A, end), ("HANDLED_BY", end, f"{A}#Orders.one"), ("DECORATES", f"{A}#/call@5:2", f"{A}#Orders"), ("DECORATES", f"{A}#Orders.one/call@12:14", f"{A}#Orders.one(id)"))
    assert any(t == "BINDS" and d == f"{A}#Orders.one(id)" for t, _, d in edges)


def test_modules(graph):
    nodes, edges = graph
    assert {d for t, s, d in edges if t == "IMPORTS" and s == M} == {U, "src/side.js", "pkg:node:fs"}  # none of comments and strings
    has(edges, ("IMPORTS", A, R), ("EXPORTS", M, f"{M}#run"), ("EXPORTS", R, f"{R}#Kind"))
    assert edges["BINDS", M, f"{U}#other"].member == "twin"
    assert nodes["app:k"].env_vars_read == ["USERS_URL"] and nodes["app:k"].host_candidates == ["users:8080"]


def test_defaults_without_a_name(graph):
    nodes, edges = graph
    told = {f: (nodes[f"{f}#default"].type, nodes[f"{f}#default"].kind, nodes[f"{f}#default"].exported) for f in ("src/plain.ts", "src/lone.js", "src/word.js")}
    assert told == {"src/plain.ts": ("Class", None, True), "src/lone.js": ("Function", "arrow", True), "src/word.js": ("Function", "expression", True)}
    has(edges, ("HAS_METHOD", "src/plain.ts#default", "src/plain.ts#default.go"), ("EXPORTS", "src/lone.js", "src/lone.js#default"), ("EXPORTS", "src/word.js", "src/word.js#default"), ("EXPORTS", "src/plain.ts", "src/plain.ts#default"))
    assert {d for t, s, d in edges if t in ("CALLS", "INSTANTIATES") and s.startswith("src/uses.js")} == {"src/lone.js#default", "src/word.js#default", "src/plain.ts#default"}


def test_long_texts_of_every_kind(spark):
    """A megabyte in a string, a template and a comment: one token each."""
    long = "x y" * 350_000
    t = tokens(spark.createDataFrame([("f", f"a = '{long}'; b = `{long}`; /* {long} */ c = \"{long}\";")], "file_id string, content string"))
    assert [len(r.tok) for r in t.filter("length(tok) > 9").collect()] == [len(long) + 2] * 3
    assert streams(t).agg({"seg": "max"}).first()[0] == 3


def test_files_without_anything(spark, graph):
    nodes, edges = graph
    for name in ("src/empty.js", "src/comment.ts"):
        assert [i for i in nodes if i.startswith(name)] == [name] and ("CONTAINS", "app:k", name) in edges
    rows = [("a.js", "javascript", "h", bytearray(b"x")), ("b.ts", "typescript", "h", bytearray(b"\xff"))]
    files = spark.createDataFrame(rows, "path string, language string, hash string, content binary")
    g = Graph(spark.range(3), spark.range(2))
    assert tuple(api.report(g, files).first()) == (2, 1, 3, 2)
    odd = spark.createDataFrame([("open.js", "javascript", bytearray(b"f({")), ("bad.js", "javascript", bytearray(b"\xff")), ("fine.js", "javascript", bytearray(b"`${f()}`"))], "path string, language string, content binary")
    assert {tuple(r) for r in api.failures(odd).collect()} == {("open.js", "brackets do not close"), ("bad.js", "not UTF-8")}
