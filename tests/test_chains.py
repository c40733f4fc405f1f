"""Request chains against plain walks, on small graphs of our own."""

import random

from weftspark.operators import chains

EDGE = "type string, src string, dst string"


def plain(steps, endpoint, depth, most):
    """All ways without a node twice, walked one by one."""
    onward = {}
    for s, d, t in steps:
        if s != d:
            onward.setdefault(s, {})[d] = min(t, onward.get(s, {}).get(d, t))
    out = []

    def walk(way):
        at = way[-1][0]
        more = sorted(d for d in onward.get(at, {}) if d != endpoint and d not in [n for n, _ in way])
        if not more or len(way) == depth + 1:
            out.append((way, not more))
            return
        for d in more:
            walk([*way, (d, onward[at][d])])

    for d in sorted({d for s, d, t in steps if s == endpoint != d and t == "HANDLED_BY"}):
        walk([(d, "HANDLED_BY")])
    return [(endpoint, i + 1, way, ended) for i, (way, ended) in enumerate(sorted(out, key=lambda x: [n for n, _ in x[0]])[:most])]


def told(df):
    return sorted((r.endpoint, r.place, [tuple(x) for x in r.chain], r.ended) for r in df.collect())


def test_requests_cross_applications_and_topics(spark):
    edges = spark.createDataFrame([
        ("HANDLED_BY", "a:GET /x", "a#f"), ("INVOKES", "a#f", "a#g"), ("REQUESTS", "a#g/call", "b:GET /y"), ("HANDLED_BY", "b:GET /y", "b#h"), ("PRODUCES", "b#h", "topic:t"),
        ("CONSUMES", "c#k", "topic:t"), ("READS", "c#k", "c#z"), ("HANDLED_BY", "d:GET /none", "d#alone"),
    ], EDGE)
    owners = spark.createDataFrame([("a#g/call", "a#g"), ("a#g/call", "a#g")], "call string, owner string")
    steps = chains.request_steps(edges, owners)
    ends = spark.createDataFrame([("a:GET /x",), ("b:GET /y",), ("d:GET /none",), ("e:GET /unhandled",), ("a:GET /x",), (None,)], "endpoint string")
    found = chains.request_chains(steps, ends)
    texts = {r.endpoint: (r.t, r.ended) for r in found.select("endpoint", chains.chain_text(found.chain).alias("t"), "ended").collect()}
    assert texts == {
        "a:GET /x": ("HANDLED_BY a#f INVOKES a#g REQUESTS b:GET /y HANDLED_BY b#h PRODUCES topic:t CONSUMES c#k", True),
        "b:GET /y": ("HANDLED_BY b#h PRODUCES topic:t CONSUMES c#k", True),
        "d:GET /none": ("HANDLED_BY d#alone", True),
    }
    assert {r.endpoint: r.ended for r in chains.request_chains(steps, ends, 2).collect()} == {"a:GET /x": False, "b:GET /y": True, "d:GET /none": True}
    assert told(chains.request_chains(steps.limit(0), ends)) == []


def test_the_first_ways_are_those_of_a_plain_walk(spark):
    rng = random.Random(5)
    for n, per, depth, most in ((6, 3, 6, 5), (12, 4, 4, 3), (30, 12, 3, 4)):
        steps = {(f"n{i}", f"n{rng.randrange(n)}", rng.choice(("INVOKES", "REQUESTS"))) for i in range(n) for _ in range(per)}
        steps |= {(f"e{i}", f"n{rng.randrange(n)}", "HANDLED_BY") for i in range(4) for _ in range(2)} | {(f"n{i}", f"e{i % 4}", "REQUESTS") for i in range(0, n, 2)}
        df = spark.createDataFrame(sorted(steps), "src string, dst string, type string")
        ends = spark.createDataFrame([(f"e{i}",) for i in range(4)], "endpoint string")
        want = sorted(x for i in range(4) for x in plain(steps, f"e{i}", depth, most))
        assert told(chains.request_chains(df, ends, depth, most)) == want
