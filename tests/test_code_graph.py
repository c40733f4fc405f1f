"""From source texts to a linked graph, on files of our own."""

import pytest

from weftspark import api
from weftspark.model import EDGE_TYPES, NODE_TYPES
from weftspark.parse.tokens import tokens

FILES = {
    "src/store.ts": """import { Log } from './log';
export interface Thing { id: string }
export abstract class Base { close() { return 1; } }
export class Store extends Base implements Thing {
  constructor(private readonly log: Log) { super(); }
  find(id: string, n = 3): Thing {
    this.close();
    helper(id);
    // a comment ( with { brackets
    return null;
  }
}
export function helper(x) { const y = new Store(x); y.find(x); return fetch('http://users:8080/a'); }
""",
    "src/log.ts": "export class Log { say(text) { console.log(text); } }\n",
    "src/index.ts": "export * from './store';\nexport { Log as Logger } from './log';\n",
    "src/app.ts": """import { Store, Logger } from './index';
import express from 'express';
import * as all from './store';
@Controller('things')
export class App {
  @Get(':id')
  show(store: Store, log: Logger) { store.find('1'); log.say('x'); all.helper(2); express.json(); }
}
const start = (port) => { kafka.send('made', port); };
""",
    "lib/old.js": """const { helper } = require('./util');
const fs = require('node:fs');
function run(a, b) { helper(a); fs.readFile(b); consumer.subscribe('made'); }
module.exports = { run };
""",
    "lib/util.js": "function helper(v) { return v; }\nmodule.exports = { helper };\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(p, "javascript" if p.endswith("js") else "typescript", "h", bytearray(t.encode())) for p, t in FILES.items()]
    g = api.extract(spark, spark.createDataFrame(rows, "path string, language string, hash string, content binary"), "shop")
    return {r.id: r for r in g.nodes.collect()}, {(r.type, r.src, r.dst, r.member, r.resolution) for r in g.edges.collect()}


def edge(edges, kind, src, dst):
    short = lambda x: x.removeprefix("shop:")
    return [(m, r) for t, s, d, m, r in edges if t == kind and short(s).startswith(src) and short(d) == dst]


def test_types_are_known(graph):
    nodes, edges = graph
    assert {n.type for n in nodes.values()} <= set(NODE_TYPES)
    assert {e[0] for e in edges} <= set(EDGE_TYPES)


def test_declarations(graph):
    nodes, edges = graph
    kinds = {i.removeprefix("shop:"): n.type for i, n in nodes.items()}
    assert kinds["src/store.ts#Store"] == "Class" and kinds["src/store.ts#Thing"] == "Interface"
    assert kinds["src/store.ts#Store.find"] == "Function" and kinds["src/app.ts#start"] == "Function"
    assert kinds["src/store.ts#Store.find(id)"] == "Parameter"
    assert edge(edges, "HAS_METHOD", "src/store.ts#Store", "src/store.ts#Store.find")


def test_heritage_and_types(graph):
    _, edges = graph
    assert edge(edges, "EXTENDS", "src/store.ts#Store", "src/store.ts#Base") == [(None, "exact")]
    assert edge(edges, "IMPLEMENTS", "src/store.ts#Store", "src/store.ts#Thing")
    assert edge(edges, "HAS_TYPE", "src/app.ts#App.show(store)", "src/store.ts#Store")
    assert edge(edges, "HAS_TYPE", "src/app.ts#App.show(log)", "src/log.ts#Log")


def test_calls_resolve_across_files(graph):
    _, edges = graph
    assert edge(edges, "CALLS", "src/app.ts#App.show/", "src/store.ts#Store.find") == [(None, "exact")]
    assert edge(edges, "CALLS", "src/app.ts#App.show/", "src/log.ts#Log.say")
    assert edge(edges, "CALLS", "src/app.ts#App.show/", "src/store.ts#helper")
    assert edge(edges, "CALLS", "src/store.ts#Store.find/", "src/store.ts#Base.close")
    assert edge(edges, "CALLS", "src/store.ts#helper/", "src/store.ts#Store.find") == [(None, "inferred")]
    assert edge(edges, "CALLS", "lib/old.js#run/", "lib/util.js#helper")
    assert edge(edges, "CALLS", "lib/old.js#run/", "pkg:node:fs") == [("readFile", "exact")]
    assert edge(edges, "CALLS", "src/log.ts#Log.say/", "app:shop/ext:console") == [("log", "name_only")]
    assert edge(edges, "INSTANTIATES", "src/store.ts#helper/", "src/store.ts#Store")


def test_invokes_and_imports(graph):
    _, edges = graph
    assert edge(edges, "INVOKES", "src/app.ts#App.show", "src/store.ts#Store.find")
    assert edge(edges, "IMPORTS", "src/app.ts", "src/index.ts") and edge(edges, "IMPORTS", "src/app.ts", "pkg:express")
    assert edge(edges, "BINDS", "src/app.ts", "src/log.ts#Log")


def test_signals_topics_endpoints(graph):
    nodes, edges = graph
    app = nodes["app:shop"]
    assert app.host_candidates == ["users:8080"] and app.endpoints == ["GET /things/:id"]
    assert edge(edges, "PRODUCES", "src/app.ts#start", "topic:unknown:made") or edge(edges, "PRODUCES", "src/app.ts#start", "topic:kafka:made")
    assert edge(edges, "CONSUMES", "lib/old.js#run", "topic:kafka:made")


def test_tokens_count_bytes(spark):
    rows = tokens(spark.createDataFrame([("f", "é = 'a\\'b'; // x\n  y(1)")], "file_id string, content string")).orderBy("i").collect()
    assert [r.tok for r in rows] == ["é", "=", "'a\\'b'", ";", "y", "(", "1", ")"]
    assert [(r.line, r.col) for r in rows][:5] == [(1, 1), (1, 4), (1, 6), (1, 12), (2, 3)]
    assert rows[5].mate == 8 and rows[6].level == 1
