"""Registered queries against plain versions, and odd rows, names and lengths for every operator."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from weftspark.llm import bpe, chat, linededup, naming, neardup, packing, quality, queries, secrets, urlgraph, wavelet  # noqa: E402

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_packing_query(spark, sf_dir, documents):
    enc, texts = brute.tokenizer(), dict(documents)
    got = queries.op1_pack(spark, sf_dir).collect()
    seen, keys, at, held = Counter(), {}, 0, {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        ids = held.setdefault(r.doc_id, enc(texts[r.doc_id]) + [1])
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
        seen[r.doc_id] += r.length
        assert r.sequence_id * 2048 + r.offset == at
        at += r.length
        keys.setdefault(r.doc_id, r.curve_key)
    assert seen == {d: len(held[d]) for d in texts}
    # Along the curve, then by doc_id; the place of a document is that of its projected vector.
    order = list(keys)
    assert order == sorted(order, key=lambda d: (keys[d], d))
    rng = np.random.default_rng(7)
    matrix = rng.standard_normal((256, 3))
    for d in order[:40]:
        v = np.zeros(256)
        for i in held[d][:-1]:
            h = (i * 2654435761 % 2**32) >> 7
            v[h % 256] += -1 if h >> 20 & 1 else 1
        point = (v / max(np.linalg.norm(v), 1e-9)) @ matrix
        cell = [min(1023, max(0, int((x / 6 + 0.5) * 1024))) for x in point]
        assert keys[d] == packing.hilbert_key(np.array([cell]))[0]
    grid = packing.hilbert_key(np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)]), bits=3)
    walk = np.argsort(grid)
    steps = [sum(abs(int(a) // q % 8 - int(b) // q % 8) for q in (64, 8, 1)) for a, b in zip(walk, walk[1:], strict=False)]
    assert sorted(grid) == list(range(512)) and set(steps) == {1}


def test_url_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute.url_filter(pages, urlgraph.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op3_url_filter(spark, sf_dir).collect()}
    assert {p: v[:3] for p, v in got.items()} == {p: v[:3] for p, v in want.items()}
    assert [p for p, v in got.items() if v[3] != want[p][3] and not want[p][4]] == []


def test_urls_with_links_between_hosts(spark):
    """Links of all kinds, a base, a canonical address, a hub, and a host of too many labels."""
    made = [(i, f"http://www.bad.org/es/{i}", "") for i in range(30)] + [(100 + i, f"https://far.net/de/{i}", '<a href="https://good.site/x">') for i in range(30)]
    made += [(200, "http://spam.site/a", '<base href="http://www.bad.org/"><a href=x>'), (201, "http://copy.site/a", "<link rel='canonical' href='//WWW.bad.org/es/1'>"), (202, "http://good.site/b", ""), (203, "http://plain.site/b", '<a href="/local">')]
    made += [(300 + i, f"http://h{i}.hub.io/q", '<a href="http://www.bad.org/1">' if i % 2 else None) for i in range(40)] + [(400, "http://" + "a." * 200 + "com/en/1", ""), (401, "http://" + "a." * 200 + "io/x", "")]
    want = brute.url_filter(made, urlgraph.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.filter_urls(spark.createDataFrame(made, "page_id long, url string, html string"), urlgraph.rule_table(spark)).collect()}
    assert {p: v for p, v in got.items() if not want[p][4]} == {p: v[:4] for p, v in want.items() if not v[4]}
    assert got[200][3] == got[201][3] == "block" and got[202][3] == got[203][3] == "allow" and got[400][2] == "com/en/"


@pytest.fixture(scope="module")
def larger(sf_dir):
    """Tables with enough labels to certify cutoffs."""
    return sf_dir.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def judged(spark, larger):
    docs = [tuple(r) for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality").collect()]
    return docs, brute.quality(docs, labels)


def test_quality_query(spark, larger, judged):
    docs, kept = judged
    got = {r.doc_id: r for r in queries.op4_quality(spark, larger).collect()}
    assert {d: r.kept for d, r in got.items()} == kept
    assert all((got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == brute.measures(t) for d, t, _ in docs)
    # The method itself rejects some: cutoffs are certified at this size.
    assert sum(not r.kept and not r.base_failed for r in got.values()) > 0


def test_secret_spans(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in queries.op6_secrets(spark, sf_dir).collect()}
    assert got == {d: (*brute.secrets(t), brute.secret_spans(t)) for d, t in documents}
    tricky = ["AKIA" + "ABCDEFGHIJ0123456789/Zk3vQ9pLm7Tb2Wd8Rf5Hc1x", "x " + "0a" * 14 + "Zk3vQ9pLm7Tb2Wd8Rf5Hc1xQ", "QxZkvQpLmTbWdRfHcAxYeUiOpKj", "someVeryLongCamelCaseNameOfThings and path/to/some/other/file/name", "token=abcdef token: Zk3vQ9pLm7Tb2Wd8Rf5Hc1x, 123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 2024-01-02-03-04-05-06-07-08"]
    for t in tricky:
        base = secrets.base_spans(t)
        assert secrets.joined(sorted(base + secrets.entropy_spans(t, base))) == brute.secret_spans(t), t
        assert secrets.without(t, "[SECRET]") == brute.redact(t)
    assert any("entropy" in brute.secret_spans(t) for t in tricky[:3])


def test_chat_query(spark, sf_dir):
    told = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op9_chat(spark, sf_dir).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute.chats(told)) and not any(r.rewrites for r in got)


def test_rendering_in_blocks():
    """Blocks give the places that beginnings of the whole give; templates that count turns fall back to those."""
    turns = [(("user", "assistant")[i % 2], f"text {i} \\ [x]") for i in range(3 * chat.BLOCK + 1)]
    whole, spans = chat._prefixes(turns, chat.marked)
    assert chat.render(turns) == (whole, spans, False) and chat._in_blocks(turns, chat.marked) == (whole, spans)
    headed = lambda ts: "<bos>" + chat.marked(ts)
    assert chat._in_blocks(turns, headed) == chat._prefixes(turns, headed) == chat.render(turns, headed)[:2]
    counted = lambda ts: "".join(f"{i}:{t};" for i, (_, t) in enumerate(ts))
    assert chat._in_blocks(turns, counted) is None
    text, at, rewrites = chat.render(turns, counted)
    assert not rewrites and [text[a:b] for _, _, a, b in at] == [t for _, t in turns]
    closing = lambda ts: "".join(t for _, t in ts) + f"({len(ts)})"
    assert chat.render(turns, closing)[2]


#: Names that operators use for their own columns, or return.
CLASHES = ("row", "ids", "name", "begin", "component_id", "kept", "__keep", "__doc", "__key", "__kept", "n_lines", "keep", "level", "local", "curve_key", "sequence_id", "text_key", "id", "label", "band", "__stratum", "spans", "place", "h1")


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows, ties, shared ids and rows without one, beside columns of all those names."""
    line = "this very line is in several documents"
    base = [(1, f"{line}\nown words of the first"), (1, f"{line}\nown words of the first"), (2, f"{line}\nother words"), (2, "a second text of the same id"), (3, None), (None, f"{line}\nno id"), (4, ""), (5, f"{line}\nother words"), (6, "token = 'abcdef0123456789'")]
    plain = spark.createDataFrame([(*r, "en") for r in base], "doc_id long, text string, lang string")
    return plain, plain.select("*", *(F.lit(f"kept {n}").alias(n) for n in CLASHES))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: packing.pack_digest(d, JSON), linededup.line_digest, lambda d: bpe.bpe_digest(d, RANKS), secrets.secrets_digest, neardup.near_groups, lambda d: wavelet.shards_digest(d, JSON), naming.exact_groups,
        lambda d: quality.quality_digest(d, d.sparkSession.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")),
    ],
    ids=["pack", "lines", "bpe", "secrets", "near", "files", "exact", "quality"],
)
def test_clashing_columns_change_nothing(clashing, run):
    plain, extra = clashing
    want = rows(run(plain))
    assert rows(run(extra)) == want and (len(want) >= 9)


def test_stages_keep_clashing_columns(spark, clashing, tmp_path):
    import corpus_pipeline

    _, extra = clashing
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (extra, extra.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == extra.columns
            n = out.count()
            assert n == 0 if docs is not extra or name == "quality" else n >= 6
    near = corpus_pipeline.near_stage(spark, extra, "")
    assert near.filter("doc_id = 5").count() == 0 and near.filter("doc_id = 2").count() == 2  # 5 has a text of 2
    lines = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, extra, "").filter("doc_id in (1, 5)").collect()}
    assert lines[1].text.startswith("this very line") and lines[5].text == "" and lines[5]["__keep"] == "kept __keep"


def test_very_long_texts(spark):
    """Ten megabytes of words, a word of a megabyte, a line of three, and a hundred thousand lines."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 1_500_000)]
    texts = {1: " ".join(words), 2: "ab3" * 333_333, 3: "x " * 1_500_000, 4: "\n".join(f"line number {i % 90_000}" for i in range(100_000)), 5: "line number 7\nline number 7", 6: " ".join(words) + " end"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    lines = {r.doc_id: r for r in linededup.line_digest(df).collect()}
    assert (lines[4].n_lines, lines[4].n_dropped) == (100_000, 0) and (lines[5].n_lines, lines[5].n_dropped) == (2, 2)
    exact = {r.doc_id: r for r in naming.exact_groups(df).collect()}
    assert all(r.kept for r in exact.values()) and exact[2].text_sha256 == brute.sha(texts[2])
    near = {r.doc_id: r.component_id for r in neardup.near_groups(df).collect()}
    assert near[6] == 1 and [near[i] for i in (2, 3, 4, 5)] == [2, 3, 4, 5]
    told = {r.doc_id: r for r in quality.judge(df.withColumn("lang", F.lit("en")), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert told[1].n_words == 1_500_000 and told[3].n_repeat_words == 1_500_000 and told[4].n_dup_lines == 10_000
    found = {r.doc_id: r.spans for r in secrets.secrets_digest(df).collect()}
    assert found[1] == found[3] == ""
    pieces = packing.pack_digest(df, JSON).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    files = {r.doc_id: r.n_tokens for r in wavelet.shards_digest(df, JSON).collect()}
    encoded = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.bpe_digest(df, RANKS).collect()}
    assert all(r.n == r.m == files[r.doc_id] == encoded[r.doc_id][0] + 1 for r in pieces) and len(pieces) == 6
    assert {d: s for d, (_, s) in encoded.items()} == {d: brute.sha(t) for d, t in texts.items()}


@pytest.mark.parametrize("kind", ["smallint", "string"])
def test_other_types_of_ids(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one text of several words", "one text of several words", "another", None])], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    same = [df.schema["doc_id"].dataType.fromInternal(x) for x in ((0, 0, 2, 3) if kind == "smallint" else ("0", "0", "2", "3"))]
    assert [r.component_id for r in neardup.near_groups(df).orderBy("doc_id").collect()] == same
    assert [r.keep_id for r in naming.exact_groups(df).orderBy("doc_id").collect()] == same
    assert wavelet.shards_digest(df, JSON).schema["doc_id"].dataType == df.schema["doc_id"].dataType and packing.pack_digest(df, JSON).count() == 4


def test_hot_keys_in_small_blocks(spark, monkeypatch):
    """Groups far larger than a block, of copies that one document holds together and of chains that none does."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, 2 if i % 3 else 1):
            w[int(k)] = f"z{i}"
        made.append((i, " ".join(w)))
    made += [(1000 + i, " ".join([f"s{j}" for j in range(i, i + 100)])) for i in range(0, 60, 3)]  # each like its neighbours only
    made += [(2000 + i, " ".join(base)) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(neardup.near_groups(df)) == sorted(brute.near_dedup(made), key=repr)


def test_two_large_groups_joined_by_one_pair(spark, monkeypatch):
    """Members of two groups, each like its first document, of which one pair alone is alike."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"v{i}" for i in range(400)]
    far = base[:330] + [f"f{i}" for i in range(70)]  # 326 shingles of 466 with the first
    middle = base[:363] + [f"f{i}" for i in range(37)]
    other = base[:330] + [f"g{i}" for i in range(33)] + [f"f{i}" for i in range(33, 70)]
    copy = lambda words, i: " ".join([*words[:-1], f"e{i}"])
    made = [(i, copy(base, i)) for i in range(40)] + [(100 + i, copy(far, i)) for i in range(40)] + [(300, " ".join(middle)), (301, " ".join(other))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(neardup.near_groups(df)) == sorted(brute.near_dedup(made), key=repr)


def test_near_groups_takes_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are, tasks without rows are most of the work on small tables: of steps that deal rows out by key there are few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    base = [f"v{i}" for i in range(120)]
    made = [(i, " ".join([*base[:-1], f"e{i}"])) for i in range(40)] + [(100 + i, " ".join([f"s{j}" for j in range(i, i + 100)])) for i in range(0, 30, 3)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for block, most in ((512, 50), (8, 75)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        group = f"near-{block}"
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert rows(neardup.near_groups(df)) == sorted(brute.near_dedup(made), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        told = spark.sparkContext.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
        assert tasks < 40 * most


def test_pipeline_query(spark, larger, judged):
    """run() where cutoffs are certified, against plain stages."""
    import corpus_pipeline

    docs, kept = judged
    left = {d: t for d, t, _ in docs if kept[d]}
    assert len(left) < len(docs)
    holders = {}
    for d, t in sorted(left.items()):
        for line in t.split("\n"):
            holders.setdefault(brute.lower(line.strip(brute.SPACE)), d)
    lines = {d: "\n".join(x for x in t.split("\n") if len(k := brute.lower(x.strip(brute.SPACE))) < 10 or holders[k] == d) for d, t in left.items()}
    near = {d: lines[d] for d, _, c, _ in brute.near_dedup(list(lines.items()), percent=80) if c == d}
    clean = {d: brute.redact(t) for d, t in near.items()}
    enc, want, got = brute.tokenizer(), {}, Counter()
    for r in corpus_pipeline.run(spark, larger).collect():
        ids = want.setdefault(r.doc_id, enc(clean[r.doc_id]) + [1])
        assert np.frombuffer(r.ids, "<u2").tolist() == ids[r.start : r.start + r.length]
        got[r.doc_id] += r.length
    assert got == {d: len(want[d]) for d in clean}
