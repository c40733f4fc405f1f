"""Operator 6: secrets by patterns and by the entropy of sliding windows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shape, slices

#: Fixed values of the contract: what each kind matches, and the fewest characters of it.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: long runs of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A stretch worth a look: it has a digit, or small and large letters mixed more than names written in humps have them.
_DIGIT = re.compile(r"[0-9]")
_HUMPS = re.compile(r"[A-Z]?[a-z]+(?:[A-Z]{1,4}[a-z]{2,})*[A-Z]{0,4}|[A-Z]+")
#: Classes, narrowest first: what a string is made of, and bits a character that a window must reach.
CLASSES = ((re.compile(r"[0-9a-fA-F]+"), 3.0), (re.compile(r"[A-Z0-9]+"), 3.5), (re.compile(r"[A-Za-z0-9]+"), 3.7), (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8))
#: Strings that look random but are known to be harmless.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9_=+/-]+"),  # numbers, dates, rules
    re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))+"),  # words joined, paths
    re.compile(r"(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/=]+"),  # published checksums
)
WINDOW = 20


def entropy_windows(s: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal stretches of ``s`` covered by windows of at least ``least`` bits a character.

    Counts of characters change by one in and one out a step, and with them the
    sum of n log n: linear in the string.
    """
    if len(s) < window:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _NLOGN(n + 1) - _NLOGN(n)
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += _NLOGN(n - 1) - _NLOGN(n)
            counts[old] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = spans[-1][0], i + 1
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def _NLOGN(n: int) -> float:  # noqa: N802
    return n * math.log2(n) if n > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _free(at: int, end: int, base: list[tuple[int, int, int]], place: int) -> tuple[list[tuple[int, int]], int]:
    """Stretches of [at, end) outside of ``base``, and the first of its spans that may reach beyond; spans before ``place`` end before ``at``."""
    out = []
    while place < len(base) and base[place][2] <= at:
        place += 1
    k = place
    while k < len(base) and base[k][0] < end:
        if base[k][0] > at:
            out.append((at, base[k][0]))
        at = max(at, base[k][2])
        k += 1
    if at < end:
        out.append((at, end))
    return out, place


def merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order of their start, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for a, k, b in base:
        if out and a < out[-1][2]:
            out[-1] = out[-1][0], out[-1][1], max(b, out[-1][2])
        else:
            out.append((a, k, b))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches of high entropy in candidate strings, outside of what patterns match and of what the allow-list covers.

    What patterns match is cut out of a candidate and the rest still scanned.
    Both run through the text once.
    """
    out, place, known = [], 0, merged(base)
    for m in CANDIDATE.finditer(text):
        if any(a.fullmatch(m[0]) for a in ALLOWED):
            continue
        free, place = _free(m.start(), m.end(), known, place)
        for at, end in free:
            s = text[at:end]
            if len(s) < WINDOW or any(a.fullmatch(s) for a in ALLOWED):
                continue
            if not _DIGIT.search(s) and all(_HUMPS.fullmatch(x) for x in re.split(r"[+/_=-]+", s) if x):
                continue
            least = next(bits for kind, bits in CLASSES if kind.fullmatch(s))
            out += [(at + a, 3, at + b) for a, b in entropy_windows(s, least)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_assign, n_access, n_hex, n_entropy, base_spans and spans of the whole texts.

    Places are code points, ends exclusive.  Null and empty texts have none;
    rows are judged one by one, repeated ones alike; an empty table has no rows.
    A window counts when its characters' entropy reaches its class's bits.  A text
    or string of any length is scanned whole, in time that grows with it.  Columns
    of ``docs`` named like a result give way to it.  One pass, no shuffle.
    """
    names = ["n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans"]
    keep = [c for c in docs.columns if c not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    base = base_spans(t or "")
                    more = entropy_spans(t or "", base)
                    rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), len(more), joined(base), joined(sorted(base + more))))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(cols))], names=[*keep, *names])

    source = docs.select(*keep, F.col(text))
    zero = [F.lit(0).cast("long").alias(n) for n in names[:4]] + [F.lit("").alias(n) for n in names[4:]]
    return source.mapInArrow(run, shape(source.select(*keep, *zero)))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; all rows and columns stay, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = [t and without(t, mark) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else part.column(c) for c in part.schema.names], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def without(text: str, mark: str) -> str:
    base = base_spans(text)
    spans = sorted(base + entropy_spans(text, base))
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secrets_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_entropy")
