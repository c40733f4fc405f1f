"""Operator 4: quality rules whose cutoffs are certified on labelled holdouts.

Each rule compares one measure of a text with a cutoff.  A stratum's cutoffs are
chosen together from one fixed sequence of vectors, lenient to strict: it moves
on for as long as an exact binomial test shows that the rules together reject a
good document with at most the allowed risk.  Testing in a fixed order needs no
correction within the sequence; across strata the error rate is divided
(Bonferroni).  Strata too small for any test are tested as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialise, shape, slices, text_bytes, text_key

#: Fixed value of the contract.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``value`` (SQL over the measures) is above, or if ``below`` under, the cutoff; cutoffs run from lenient to strict."""

    name: str
    value: str
    cutoffs: tuple[float, ...]
    below: bool = False


RULES = (
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", tuple(x / 1000 for x in (500, 400, 300, 200, 150, 100, 80, 60, 50, 40, 30, 20, 10))),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", tuple(x / 100 for x in range(90, 10, -5))),
    Rule("repeated_word_share", "n_repeat_words / greatest(n_words, 1)", tuple(x / 100 for x in range(48, 4, -4))),
    Rule("long_words", "word_chars / greatest(n_words, 1)", tuple(x / 2 for x in range(40, 11, -1))),
    Rule("short_words", "word_chars / greatest(n_words, 1)", tuple(x / 4 for x in range(4, 17)), below=True),
)


def _repeated(ids: np.ndarray) -> int:
    """Words that stand in a window of three found twice or more."""
    if len(ids) < 4:
        return 0
    width = np.int64(ids.max()) + 1
    if width < 2_000_000:
        windows = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
    else:  # too many distinct words for one integer: number the pairs first
        pairs = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * width + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= again
    return int(covered.sum())


class _Numbers(dict):
    """Numbers in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def text_measures(text: bytes) -> tuple[int, ...]:
    """The values named in MEASURES."""
    words = text.split()
    bare = text.translate(None, SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode())
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip(SPACE)]
    numbers = _Numbers()
    repeated = _repeated(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))) if len(words) > 3 else 0
    return len(words), chars, len(bare) - len(bare.translate(None, SYMBOLS)), len(filled) - len(set(filled)), repeated, len(lines)


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the measures of each whole text; null counts as empty.  One pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [text_measures(t) for t in text_bytes(part)]
                cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], names=[*keep, *MEASURES])

    source = docs.select(*keep, "text")
    return source.mapInArrow(run, shape(source.select(*keep, *(F.lit(0).cast("long").alias(m) for m in MEASURES))))


def base_failed() -> F.Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials of probability p: the incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    value = d
    for m in range(1, 100_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + numerator * d) or 1e-300)
            c = (1 + numerator / c) or 1e-300
            step = c * d
            value *= step
        if abs(step - 1) < 1e-14:
            break
    return 1 - front * value if swap else front * value


def chain_of(rules: tuple[Rule, ...]) -> list[tuple[Rule, float]]:
    """All (rule, cutoff) in the one order in which they are tested: lenient to strict, the rules abreast.

    The first so many of them are a vector of cutoffs: of each rule the last one counts.
    """
    places = sorted(((i + 1) / len(r.cutoffs), at, i) for at, r in enumerate(rules) for i in range(len(r.cutoffs)))
    return [(rules[at], float(rules[at].cutoffs[i])) for _, at, i in places]


def certified_cutoffs(labelled: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) of the strictest certified cutoff; no row where none is.

    ``labelled``: measures, ``stratum`` and ``good`` (boolean, null: no holdout)
    of documents that pass the base rules.  With probability 1 - ``error`` at
    least, in every stratum at once, all rules together falsely reject at most
    ``risk`` of such good documents.  Strata with too few good documents to
    certify even a cutoff that rejects none are tested, and hold the risk, as one.
    Null is a stratum of its own.  Only counts by stratum and place in the chain
    are gathered; strata may be many, none of them meets in one task.
    """
    chain = chain_of(rules)
    # The first place in the chain that rejects a document: all stricter vectors do so too.
    first = F.least(F.lit(len(chain)), *(F.when(_beyond(r, F.lit(c)), F.lit(at)) for at, (r, c) in enumerate(chain)))
    counts = labelled.filter("good").groupBy(F.struct(F.col(stratum)).alias("s"), first.alias("place")).agg(F.count(F.lit(1)).alias("k"))
    counts = materialise(counts, "places")
    sizes = counts.groupBy("s").agg(F.sum("k").alias("n"))
    strata = sizes.count()
    # Which strata are one is told by their sizes alone, never by what would be rejected.
    least = math.ceil(math.log(error / max(strata, 1)) / math.log(1 - risk))
    alone = F.col("n") >= least
    sizes = materialise(sizes.select("s", "n", F.struct(alone.alias("alone"), F.when(alone, F.col("s")).alias("s")).alias("tested")), "strata")
    pooled = sizes.agg(F.count_if("tested.alone").alias("alone"), F.max(F.when(~F.col("tested.alone"), F.lit(1))).alias("pooled")).first()
    tests = (pooled["alone"] or 0) + (pooled["pooled"] or 0)
    groups = sizes.groupBy("tested").agg(F.sum("n").alias("n"))
    by_place = counts.join(sizes.select("s", "tested"), counts.s.eqNullSafe(sizes.s)).groupBy("tested", "place").agg(F.sum("k").alias("k"))
    steps = F.array(*(F.struct(F.lit(at).alias("place"), F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff")) for at, (r, c) in enumerate(chain)))
    so_far = W.partitionBy("tested").orderBy("place")
    rows = groups.select("tested", "n", F.inline(steps))
    t, p = by_place.select(F.col("tested").alias("t"), F.col("place").alias("p"), "k"), rows
    told = p.join(t, p.tested.eqNullSafe(t.t) & (p.place == t.p), "left").drop("t", "p").withColumn("k", F.coalesce(F.sum("k").over(so_far), F.lit(0)))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), risk) for a, b in zip(k, n, strict=True)])

    passed = told.withColumn("passed", tail("k", "n") <= F.lit(error / max(tests, 1)))
    found = passed.withColumn("all", F.min("passed").over(so_far)).filter("all").groupBy("tested", "rule").agg(F.max_by("cutoff", "place").alias("cutoff")).withColumnRenamed("tested", "t")
    return sizes.join(found, sizes.tested.eqNullSafe(found.t)).select(F.col(f"s.{stratum}").alias(stratum), "rule", "cutoff")


def _beyond(rule: Rule, cutoff: F.Column) -> F.Column:
    value = F.expr(rule.value)
    return F.coalesce(value < cutoff if rule.below else value > cutoff, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, rejected_by (names of rules), kept.

    Null texts count as empty and fail the base rules.  A null stratum is a
    stratum, and not that of empty names.  Of several labels of one doc_id the
    best counts; labels of unknown documents and null labels are left out.
    Repeated rows are judged alike.  For the holdout, rows of one stratum with the
    same text are one trial, good if any of them is: copies tell nothing new.
    Where labels are too few to certify anything, even with all small strata as
    one, nothing but the base rules rejects; so too in a stratum without any
    good label, and without labels at all.  An empty table gives none.  A text of
    any length is measured whole.  Extra columns are ignored, whatever their names.
    """
    found = docs.select("doc_id", F.col(stratum).cast("string").alias("__stratum"), text_key().alias("__text"), "text")
    found = materialise(measures(found, ["doc_id", "__stratum", "__text"]).withColumn("base_failed", base_failed()), "measures")
    best = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    holdout = found.filter("not base_failed").join(best, "doc_id")
    holdout = holdout.groupBy("__stratum", "__text").agg(F.max("good").alias("good"), *(F.first(m).alias(m) for m in MEASURES))
    cutoffs = materialise(certified_cutoffs(holdout, "__stratum", rules, risk, error), "cutoffs")
    wide = cutoffs.groupBy("__stratum").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"__{r.name}") for r in rules)).withColumnRenamed("__stratum", "__s")
    names = F.array_compact(F.array(*(F.when(_beyond(r, F.col(f"__{r.name}")), F.lit(r.name)) for r in rules)))
    told = found.join(wide, found["__stratum"].eqNullSafe(wide["__s"]), "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(names))
    return told.select("doc_id", *MEASURES, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    told = judge(docs, labels)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects.

    Verdicts are joined by doc_id; of rows that share one, or have none, each is
    kept if any row of that doc_id is.  Columns stay as they are.
    """
    kept = judge(docs, labels, **how).filter("kept").select(F.col("doc_id").alias(name := free_name(docs, "__kept"))).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept[name]), "left_semi")
