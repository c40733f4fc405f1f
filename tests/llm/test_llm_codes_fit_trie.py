"""Vector codes, best-fit packing and the prefix trie against plain versions; the registered token queries too."""

import math
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import oracle  # noqa: E402
import public_tokenizers  # noqa: E402
from weftspark.llm import bestfit, prefixtrie, queries, vectorcodes, wordpieces  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Vector codes


@pytest.mark.parametrize("size", [1, 1e4, 1e6, 1e12, 1e30])
def test_codes_of_any_size(spark, size):
    """Small, 64-bit and Python integers; null, NaN, infinite, empty and odd lengths; equal ids, no id, no label."""
    rng = np.random.default_rng(1)
    made = [(i, [float(x) for x in np.round(rng.standard_normal(8) * size, 1)], i % 3 or None) for i in range(90)]
    made += [(5, [0.0] * 8, 1), (5, [0.0] * 8, 1), (200, made[7][1], 2), (201, None, 1), (202, [1.0] * 7 + [None], 1), (203, [math.nan] * 8, 1), (204, [math.inf] + [0.0] * 7, 1), (205, [], 1), (206, [1.0, 2.0], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    want = brute.vector_codes([r for r in made if r[0] != 206], entries=16)
    most = (1 << 63) - 1
    spoiled = {label for label in (None, 1, 2) if any(e > most for i, _, e, _, _ in want if dict((m[0], m[2]) for m in made)[i] == label)}
    labels = {m[0]: m[2] for m in made}
    want = [(i, c, e if e <= most else None, t if t <= most and labels[i] not in spoiled else None, s) for i, c, e, t, s in want]
    assert rows(vectorcodes.vector_digest(df, entries=16)) == sorted(want, key=repr)


def test_few_ties_and_clashing_columns(spark):
    """Fewer vectors than entries, all equal ones, a length that parts don't divide, rows without an id last, and no rows."""
    made = [(i, [0.5] * 8, None, "x") for i in range(5)] + [(None, [9.0] * 8, 3, "x")]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, codes string").withColumns({c: F.lit("own") for c in ("id", "vector", "part", "entry", "n", "digits", "of", "code", "error")})
    got = vectorcodes.vector_digest(df).collect()
    assert {(r.vec_id is None, r.code, r.error, r.label_error) for r in got} == {(False, "00000000", 0, 0), (True, "05050505", 0, 0)} and len(got) == 6
    assert vectorcodes.vector_digest(df.limit(0)).collect() == []
    coded, books = vectorcodes.encode_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<double>, label int"), parts=2, scale=1)
    assert books == [[[1, 2]], [[3]]] and coded.first().codes == [0, 0]


def test_ball_is_scanned_not_all():
    """Far clusters are never looked at, and the result is that of all entries."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-(10**6), 10**6, (16, 4))
    entries = (centres[:, None, :] + rng.integers(-50, 50, (16, 16, 4))).reshape(-1, 4)
    book = vectorcodes.Codebook(entries.tolist())
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 4))
    start = np.array([((entries - v) ** 2).sum(1).argsort(kind="stable")[1] for v in x])
    index, far = book.nearest(x, start)
    whole = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == whole.argmin(1)).all() and (far == whole.min(1)).all()
    _, _, _, apart = book.tables(book.kind(vectorcodes._most(x)))
    own = ((x - entries[start]) ** 2).sum(1)
    assert max(np.searchsorted(apart[a], 4 * d, side="right") for a, d in zip(start, own, strict=True)) <= 16


def test_code_query(spark, sf_dir):
    assert oracle.difference(queries.op11_vector_codes(spark, sf_dir), queries.oracle_sql()["op11_vector_codes"], sf_dir) == ""


# Best-fit packing


def test_words_as_the_library_has_them():
    from tokenizers import Tokenizer

    tok, memo, rnd = Tokenizer.from_file(WORDS), wordpieces.word_memo(WORDS), random.Random(1)
    texts = ["It's a TEST, isn't it? 1234 x²½ ªº", "É̀ Áb  x\u0085y  z", "İstanbul ΣΑΣ ﬁ Å ß ẞ ŉ ǅ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "  ", "", "日本語 😀", "x\x0by\x0cz\rw\x00\x1f", "1٣4"]
    alpha = "aAéÉ'sStTdD l1² .,!-\n\t́İſΣßǅ 😀中"
    texts += ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 40))) for _ in range(4000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode(texts)] == want


def held(got):
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
    return seqs


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 90, 800)] + ["long " * 500, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "other")], "doc_id long, text string"))
    limits = bestfit.Capacity(tokens=128, documents=4, cost=5000)
    got = bestfit.pack_best_fit(df, WORDS, capacity=limits, rule=rule).collect()
    seqs = held(got)
    assert all(sum(r.length for r in s) <= 128 and len(s) <= 4 and sum(r.length**2 for r in s) <= 5000 for s in seqs.values())
    assert limits.piece == 70 and {r.length for r in got if r.doc_id == 800} == {70, 501 % 70}
    assert sum(r.length for r in got) == sum(len((t or "").split()) + 1 for t in texts) + 3 + 3 + 2 and sum(r.doc_id is None for r in got) == 2
    assert all(np.frombuffer(r.ids, "<u2").size == r.length for r in got)
    alone = bestfit.best_fit(np.array(sorted((r.length for r in got), reverse=True)), limits, rule=rule)
    assert len(seqs) <= (alone.max() + 1) * 1.05


def test_fit_chooses_as_a_plain_loop():
    rng = np.random.default_rng(4)
    lengths = np.array(sorted(rng.integers(1, 300, 400), reverse=True))
    for limits, w in ((bestfit.Capacity(300, 300, 90000), bestfit.WEIGHTS), (bestfit.Capacity(300, 3, 60000), (1.0, 0.5, 0.5))):
        caps, bins, want = (limits.tokens, limits.documents, limits.cost), [], []
        for n in lengths.tolist():
            need = (n, 1, n * n)
            fits = [(sum(a * (r / c - d / c) ** 2 for a, r, d, c in zip(w, b, need, caps, strict=True)), k) for k, b in enumerate(bins) if all(r >= d for r, d in zip(b, need, strict=True))]
            k = min(fits, key=lambda f: (round(f[0], 12), f[1]))[1] if fits else len(bins)
            if not fits:
                bins.append(list(caps))
            bins[k] = [r - d for r, d in zip(bins[k], need, strict=True)]
            want.append(k)
        assert bestfit.best_fit(lengths, limits, w).tolist() == want


def test_fit_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    docs = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op12_best_fit(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    for d, ids in docs.items():
        ps = sorted(by[d], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(-(-len(ids) // 2048)))
        for p in ps:
            own = ids[p.start : p.start + p.length]
            assert p.start == 2048 * p.piece and p.length == len(own) == min(2048, len(ids) - p.start) and p.ids_crc32 == brute.crc(own)
    assert len(held(got)) <= math.ceil(sum(map(len, docs.values())) / 2048) * 1.02 + 1


def test_fit_of_nothing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (2, "a " * 5000, 2)], "doc_id long, text string, row int").withColumns({c: F.lit("own") for c in ("piece", "start", "length", "alone", "ids", "sequence_id", "offset", "reopened")})
    assert bestfit.best_fit_digest(df, WORDS).count() == 4 and bestfit.best_fit_digest(df.limit(0), WORDS).count() == 0


# Prefix trie


def told(spark, data, **kwargs):
    return rows(prefixtrie.trie_digest(spark.createDataFrame(data, TURNS), **kwargs)) == sorted(brute.trie(data, **kwargs), key=repr)


@pytest.mark.parametrize("fan_in", [2, 64])
def test_tries_of_random_turns(spark, monkeypatch, fan_in):
    """Blocks joined over several levels, copies in many blocks, ends inside others, negative ids, nulls."""
    monkeypatch.setattr(prefixtrie, "FAN_IN", fan_in)
    monkeypatch.setattr(prefixtrie, "DEPTHS", 4)
    monkeypatch.setattr(prefixtrie, "CHUNK", 50)
    rnd = random.Random(fan_in)
    data = [(c, None if t == 0 else t, "user", rnd.choice("ab" if rnd.random() < 0.9 else ["é", None, "x"])) for c in range(-3, 150) for t in range(rnd.choice([1, 2, 3, 12, 30]))]
    rnd.shuffle(data)
    assert told(spark, data) and told(spark, data, most=1)


def test_hot_conversations(spark):
    """One conversation with a third of all turns, a third of conversations alike, one first turn for all."""
    data = [(0, t, "user", f"t{t}") for t in range(4000)]
    data += [(c, t, "user", f"t{t}" if t < 3 else "same") for c in range(1, 700) for t in range(5)]
    data += [(c, t, "user", f"t{t}") for c in range(700, 1300, 7) for t in range(c % 50)]
    assert told(spark, data) and told(spark, data, most=1)


def test_small_tries(spark):
    assert told(spark, [(7, 0, None, None)]) and told(spark, [(6, 0, "u", "x"), (8, 0, "u", "x")])
    assert rows(prefixtrie.trie_digest(spark.createDataFrame([], TURNS))) == []
    repeated = [(1, 0, "u", "x"), (1, 0, "u", "x"), (None, 0, "u", "y")]
    clash = spark.createDataFrame(repeated, TURNS).withColumns({c: F.lit("own") for c in ("at", "name", "bytes", "part", "depth", "path", "p", "h", "n")})
    got = rows(prefixtrie.prefix_trie(prefixtrie.as_rows(prefixtrie.turn_places(clash))))
    assert [r[:4] for r in got] == [(1, 0, None, 1), (1, 1, 1, 1), (1, 2, 1, 1)]
    long = [(c, t, "user", "é" * 300_000 if t else "") for c in (5, 10) for t in range(3)]
    assert told(spark, long, most=1)


def test_trie_query(spark, sf_dir):
    assert oracle.difference(queries.op13_prefix_trie(spark, sf_dir), queries.oracle_sql()["op13_prefix_trie"], sf_dir) == ""


# Registered token queries of other operators


def test_bpe_query(spark, sf_dir):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_bpe(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids = enc.encode_ordinary(text)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))


def test_file_query(spark, sf_dir):
    enc, at = brute.tokenizer(), 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_token_files(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d in sorted(docs):
        ids = [*enc(docs[d]), 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
