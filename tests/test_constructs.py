"""Arrows and signatures of every form, templates and elements of any depth, and symbols across files."""

import pytest
from pyspark.sql import functions as F

from weftspark import api
from weftspark.operators import link, paths, symbols
from weftspark.parse.lex import lex

FILES = {
    "a.ts": """const plain = (z) => k(z)
const bare = z => z + k(1)
const none = () => go(t)
const one = (x: A): A | B | C => { return k(x); }
const two = (x): Promise<A.B.C> => helper(x)
const guard = (x): x is Map<string, Array<A>> => check(x)
const gen = <T,>(q: T): T => wrap(q)
const later = async <T extends A>(q: T) => await wrap(q)
const boxed = (x: A): { a: B; c: C } => { return k(x); }
const pick = flag ? (a) : b => c(b)
const inner = { 'x-y': (z) => k(z), m: w => w.run(w) }
list.map(v => v * f(v)).filter((v): boolean => { return v > g(v); });
const curry = a => b => k(a, b)
declare function amb(a: string): void;
function over(a: string): void;
function over(a: number): void;
function over(a: any): { x: A } { return real(a); }
declare class Ghost { m(): void }
export declare const hidden: string;
class Box { m(): { a: B } { return inside(); } abs: (x: A) => B = (x) => k(x) }
interface Shape { area(): number; }
function typed(a): B { return a; }
""",
    "v.tsx": """export function View({ rows, onPick }) {
  const label = `a ${one(`b ${two(`c ${three(`d ${four(`e ${five({ a: { b: { c: 1 } } })} it's`)}`)}`)}`)} f`;
  return (
    <Panel.Body className="a" title={label} {...more(rows)}>
      it's {rows.length > 0 && <b onClick={() => onPick(rows[0])}>first</b>}
      {rows.map(r => <Row key={r.id} render={(x) => <i>{show(x)}</i>} />)}
      <br/>
    </Panel.Body>
  );
}
const generic = <T,>(x: T) => id(x);
""",
}
N = "k:a.ts"


@pytest.fixture(scope="module")
def graph(spark):
    g = extracted(spark, FILES)
    return g


def extracted(spark, files):
    kind = lambda p: {"ts": "typescript", "tsx": "tsx"}.get(p.rsplit(".", 1)[-1], "javascript")
    rows = [(p, kind(p), "h", bytearray(t.encode())) for p, t in files.items()]
    g = api.extract(spark, spark.createDataFrame(rows, "path string, language string, hash string, content binary"), "k")
    return {r.id: r for r in g.nodes.collect()}, [r for r in g.edges.collect()]


def calls(nodes, edges, owner):
    """Names that calls of ``owner`` go to."""
    own = {i for i, n in nodes.items() if n.type == "Call" and n.owner_id == owner}
    return sorted(e.dst.rsplit("ext:", 1)[-1].rsplit("#", 1)[-1] for e in edges if e.type == "CALLS" and e.src in own)


def test_first_uses_of_arrows(graph):
    nodes, edges = graph
    for name, want in {"plain": ["k"], "bare": ["k"], "none": ["go"], "one": ["k"], "two": ["helper"], "guard": ["check"], "gen": ["wrap"], "later": ["wrap"], "boxed": ["k"], "over": ["real"], "Box.m": ["inside"], "Box.abs": ["k"]}.items():
        assert calls(nodes, edges, f"{N}#{name}") == want, name
    reads = {(e.src, e.dst) for e in edges if e.type == "READS"}
    assert (f"{N}#bare", f"{N}#bare(z)") in reads
    anonymous = [(n.start_line, calls(nodes, edges, i)) for i, n in nodes.items() if n.type == "Function" and n.name.startswith("fn@") and i.startswith(N)]
    assert (10, ["c"]) in anonymous and (11, ["k"]) in anonymous and (12, ["f"]) in anonymous and (12, ["g"]) in anonymous and (13, ["k"]) in anonymous


def test_signatures_of_any_length(graph):
    nodes, _ = graph
    types = {n: nodes[f"{N}#{n}"].type_name for n in ("one", "two", "guard", "gen", "boxed")}
    assert types["one"] == "A | B | C" and types["two"] == "Promise<A.B.C>" and types["gen"] == "T" and types["guard"].startswith("x is Map")
    assert nodes[f"{N}#over"].type_name.startswith("{") and nodes[f"{N}#typed"].type_name == "B"
    assert nodes[f"{N}#later"]["async"] and nodes[f"{N}#later"].kind == "arrow"
    names = {i.removeprefix(f"{N}#") for i, n in nodes.items() if i.startswith(N) and n.type in ("Function", "Class", "Variable", "Field")}
    assert not any(x in y for x in ("amb", "Ghost", "hidden", "over.over") for y in names)
    assert [i for i in nodes if i.startswith(f"{N}#over") and nodes[i].type == "Function"] == [f"{N}#over"] and nodes[f"{N}#Shape.area"].type == "Function"


def test_templates_and_elements(graph):
    nodes, edges = graph
    v = "k:v.tsx"
    found = {(n.name, n.start_line, n.start_col) for i, n in nodes.items() if n.type == "Call" and i.startswith(v)}
    text = FILES["v.tsx"].split("\n")
    for name, line in (("one", 2), ("two", 2), ("three", 2), ("four", 2), ("five", 2), ("more", 4), ("onPick", 5), ("rows.map", 6), ("show", 6), ("id", 11)):
        assert (name, line, text[line - 1].index(f"{name}(") + 1) in found, name
    assert len(found) == 10
    assert not [n for i, n in nodes.items() if i.startswith(v) and n.type == "Assignment" and n.start_line > 2 and n.start_line < 11]
    gone = ("className", "onClick", "title", "key", "render", "it", "first", "s")
    assert not [e for e in edges if e.src.startswith(v) and e.dst.endswith(tuple(f"ext:{x}" for x in gone))]
    # Names of elements are read, as often as they stand there.
    assert len([e for e in edges if e.type == "READS" and e.dst.endswith("ext:Panel") and e.member == "Body"]) == 2
    assert [e for e in edges if e.type == "READS" and e.dst.endswith("ext:Row")]


def test_any_text_has_tokens():
    for text in ("", "`", "`${", "<a", "<a b={", "}}}", "<a>{`${<b/>}`}", "a < b > (c", "/", "'", "<a>x</", "\\", "`${`${`"):
        toks, _ = lex(text)
        assert all(t[3] >= 0 and t[6] < i for i, t in enumerate(toks, 1))
    deep = "`${" * 300 + "x()" + "}`" * 300
    toks, balanced = lex(deep)
    assert balanced and [t[0] for t in toks].count("x") == 1
    assert lex("a } b")[1] is False and lex("f({[")[1] is False


SYMBOLS = {
    "pkg.js": "export { pad as left } from 'lodash';\nexport * from '@x/all';\n",
    "space.js": "export * as util from './util';\nexport { util2 };\nimport * as util2 from './util';\n",
    "util.js": "export function help(a) { return a; }\nimport { parse } from 'yaml';\nexport { parse };\n",
    "use.js": """import { left, other } from './pkg';
import { util, util2 } from './space';
import { parse } from './util';
class Store { constructor() { this.cache = new Map(); } read(x) { this.cache.get(x); return left(x); } }
util.help(1);
util2.help(2);
util.parse('a');
parse('b');
other('c');
""",
}


def test_symbols_across_files(spark):
    nodes, edges = extracted(spark, SYMBOLS)
    use = "k:use.js"
    told = {(e.type, e.dst, e.member) for e in edges if e.src.startswith(use)}
    assert ("CALLS", "app:k/ext:Map", "get") in told
    assert ("CALLS", "pkg:lodash", "pad") in told and ("CALLS", "pkg:@x/all", "other") in told and ("CALLS", "pkg:yaml", "parse") in told
    assert len([e for e in edges if e.type == "CALLS" and e.src.startswith(use) and e.dst == "k:util.js#help"]) == 2
    assert len([e for e in edges if e.type == "CALLS" and e.src.startswith(use) and e.dst == "pkg:yaml"]) == 2
    exports = {(e.src, e.dst) for e in edges if e.type == "EXPORTS"}
    assert {("k:pkg.js", "pkg:lodash"), ("k:space.js", "k:util.js")} <= exports
    binds = {e.dst for e in edges if e.type == "BINDS" and e.src == use}
    assert {"pkg:lodash/pad", "pkg:@x/all/other", "k:util.js", "pkg:yaml/parse"} <= binds
    assert nodes["pkg:lodash/pad"].type == "External" and nodes["pkg:lodash/pad"].name == "pad" and nodes["pkg:@x/all"].type == "Package"


def exports_of(spark, stars, own, imports=()):
    """Files that star others (file: list) and export nodes (file: names)."""
    ids = sorted({*stars, *own, *(t for ts in stars.values() for t in ts)})
    files = spark.createDataFrame([(f, "a", f, f"s{f}") for f in ids], "id string, app_key string, path string, scope string")
    rows = [(f, "reexport_all", None, None, None, t, i) for f, ts in stars.items() for i, t in enumerate(ts)] + [(f, "local", n, None, f"{f}.{n}", None, 50) for f, ns in own.items() for n in ns]
    exports = spark.createDataFrame(rows, "file_id string, kind string, name string, local string, node string, source string, seq long")
    modules = exports.filter("source is not null").select("file_id", "source", F.col("source").alias("target_file"), F.lit(None).cast("string").alias("package")).distinct()
    empty = lambda s: spark.createDataFrame([], s)
    parts = link.Parts(files, None, empty("scope string, name string, node string, seq long"), None, None, None, empty("file_id string, local string, imported string, source string, kind string, seq long"), exports)
    return {(r.file_id, r.name): r.node for r in link.resolve_exports(parts, modules).collect()}


def searched(stars, own, file, name, seen):
    """The guarded search, plainly."""
    if (file, name) in seen:
        return None
    seen.add((file, name))
    if name in own.get(file, ()):
        return f"{file}.{name}"
    for t in stars.get(file, ()):
        if found := searched(stars, own, t, name, seen):
            return found
    return None


@pytest.mark.parametrize("n", [2, 3, 5])
def test_circles_with_fallbacks(spark, n):
    """Files in a circle, each with a fallback of its own behind it, and circles of which nothing leads out."""
    stars = {f"f{i}": [f"f{(i + 1) % n}", f"g{i}"] for i in range(n)} | {f"d{i}": [f"d{(i + 1) % n}"] for i in range(n)} | {"top": ["d0", "f1"]}
    own = {f"g{i}": ["x", f"own{i}"] for i in range(n)} | {f"f{n - 1}": ["y"]}
    got = exports_of(spark, stars, own)
    ids = {*stars, *own}
    want = {(f, x): node for f in ids for x in ["x", "y", *(f"own{i}" for i in range(n))] if (node := searched(stars, own, f, x, set()))}
    assert got == want and got["f0", "x"] == f"g{n - 1}.x" and got["f1", "x"] == "g0.x"


def test_first_found_of_random_graphs(spark):
    import random

    rnd = random.Random(5)
    nodes = [f"n{i}" for i in range(24)]
    out = {a: rnd.sample(nodes, rnd.randint(0, 3)) for a in nodes}
    ends = {a: rnd.randint(0, 3) for a in rnd.sample(nodes, 4)}

    def search(a, seen):
        seen.add(a)
        options = sorted([(2 * i + 1, b) for i, b in enumerate(out[a])] + ([(2 * ends[a], None)] if a in ends else []))
        for _, b in options:
            if b is None:
                return f"end of {a}"
            if b not in seen and (found := search(b, seen)):
                return found
        return None

    edges = spark.createDataFrame([(a, b, 2 * i + 1) for a, bs in out.items() for i, b in enumerate(bs)], "src string, dst string, rank long")
    stops = spark.createDataFrame([(a, 2 * r, f"end of {a}") for a, r in ends.items()], "node string, rank long, value string")
    got = {r.start: r.value for r in paths.first_found(spark.createDataFrame([(a,) for a in nodes], "start string"), edges, stops).collect()}
    assert got == {a: found for a in nodes if (found := search(a, set()))}
    assert symbols.FIELDS[0] == "node"
