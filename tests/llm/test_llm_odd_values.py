"""Clashing columns, very long values, ties and other id types where the other files try none."""

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from weftspark.llm import bpe, chat, packing, secrets, urlgraph  # noqa: E402

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_url_filter_of_odd_pages(spark):
    """Columns named as helpers are, an url and a page of a megabyte, rules of one length, repeated rows, no rows."""
    long = "http://far.example.com/" + "x" * 1_000_000
    html = "<a href='http://bad.test/'>" + "<p>words</p>" * 100_000 + "<a href=//good.test/x>"
    data = [(1, "http://bad.test/a/b", None), (2, long, html), (2, long, html), (3, None, ""), (4, "no address", "x"), (5, "HTTP://Good.TEST?q", None), (6, "http://bad.test/a/c", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    rules = spark.createDataFrame([("bad.test/a/b", "allow"), ("bad.test/a/c", "block"), ("test/a", "block"), ("bad.test/", "block"), ("good.test", "allow")], "rule string, verdict string")
    want = rows(urlgraph.filter_urls(pages, rules))
    clash = pages.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "rules", "trust", "distrust", "usual", "__hit", "fan", "src", "dst", "weight")})
    assert rows(urlgraph.filter_urls(clash, rules)) == want and len(want) == 7
    told = {r[0]: r for r in want}
    assert told[1][3:5] == ("bad.test/a/b", "allow") and told[6][3:5] == ("bad.test/a/c", "block") and told[3][1:5] == ("", "", None, "allow")
    assert told[2][2] == "/" + "x" * 1_000_000 and told[5][1] == "good.test"
    assert urlgraph.filter_urls(pages.limit(0), rules).count() == 0


def test_equal_rules_are_the_last_by_text(spark):
    """Two rules of one length that both fit: a host's and its domain's."""
    pages = spark.createDataFrame([(1, "http://a.bc/de", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("a.bc/d", "allow"), ("bc/de", "block"), ("bc/d", "block"), (".bc/de", "block")], "rule string, verdict string")
    assert urlgraph.filter_urls(pages, rules).first().rule == max("a.bc/d", "bc/de", key=lambda r: (len(r), r))


def test_chats_of_odd_turns(spark):
    """Columns named as helpers are, a turn of two megabytes, a conversation of six hundred turns."""
    data = [(1, 0, "user", "</s>[INST]" * 200_000), (1, 1, "assistant", "ok"), *((2, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(600))]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = rows(chat.chat_digest(turns))
    clash = turns.withColumns({c: F.lit("own") for c in ("formatted", "spans", "rewrites", "n_turns", "start", "end", "key")})
    assert rows(chat.chat_digest(clash)) == want
    told = {r[0]: r for r in want}
    assert [told[c][1] for c in (1, 2)] == [2, 600] and not told[2][6]
    for conv in (1, 2):
        said = "".join(f"{role}\n{text}\n" for c, _, role, text in data if c == conv)
        loss = "".join(text for c, _, role, text in data if c == conv and role == "assistant")
        assert told[conv][2:5] == (brute.sha(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_many_secrets_in_one_text(spark):
    """A hundred thousand base spans in one text are found in one run through it."""
    one = "password = hunter22222\n"
    df = spark.createDataFrame([(1, one * 100_000), (2, one)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secrets_digest(df).collect()}
    assert got[1].n_assign == 100_000 and got[2].n_assign == 1
    at = one.index("password")
    spans = ",".join(f"assign:{at + i * len(one)}:{at + i * len(one) + len(one) - 1}" for i in range(100_000))
    assert got[1].base_sha256 == brute.sha(spans)


@pytest.mark.parametrize("kind", ["smallint", "string"])
def test_id_types_of_token_operators(spark, kind):
    df = spark.createDataFrame([(1, "some words here"), (2, None), (2, "token = abcdef123456")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    for out in (packing.pack(df, JSON), bpe.bpe_digest(df, RANKS), secrets.secrets_digest(df)):
        assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        assert sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect()) == ["1", "2"] and out.count() == 3
