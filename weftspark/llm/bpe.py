"""Operator 5: byte-level BPE by Aho-Corasick matches and token compatibility.

A row of ids is the BPE encoding of its bytes just when each adjacent pair of
ids is the encoding of its own bytes.  So a piece is encoded from the left by
the longest matching token that is compatible with the one before, going back
where none is; positions that failed are remembered, which keeps the work
linear in the piece.  Compatibility of two tokens is decided once, by merging
their bytes, and memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shape, slices
from .pieces import SLICE, Memo, shared_memo

_NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: join the adjacent pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joined = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while joined and (best := min(joined)) < _NEVER:
        i = joined.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
    return [ranks[p] for p in parts]


class PairCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], memo_limit: int = 1_000_000) -> None:
        self.ranks, self.limit = ranks, memo_limit
        self.tokens = {i: b for b, i in ranks.items()}
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens encode to just these two; ``a`` may be -1 for the start."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > self.limit:
                self.fits.clear()
            pair = [b] if a < 0 else [a, b]
            got = self.fits[a, b] = merge_bytes(b"".join(self.tokens[i] for i in pair), self.ranks) == pair
        return got

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        got = self.shorter.get(token)
        if got is None:
            b = self.tokens[token]
            got = self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest: dict[int, int] = {}  # by the place before a token; longer ones come later
        for end, (n, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n] = i
        fits, lengths, stop = self.fits, self.lengths, len(piece)
        out: list[int] = []
        dead: set[int] = set()  # ends behind which the rest can't be encoded
        at, last, token = 0, -1, longest[-1]
        while at < stop:
            while token >= 0:
                end = at + lengths[token]
                if (fit := fits.get((last, token))) is None:
                    fit = self.compatible(last, token)
                if fit and end not in dead:
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at - 1] if at < stop else -1
            else:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]
                token = self.next_shorter(token)
        return out

    def encode_pieces(self, pieces: list[str]) -> Iterable[bytes]:
        one = self.encode_piece
        return [np.array(one(p.encode()), "<u4").tobytes() for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[str, PairCodec] = {}


def _codec(ranks_path: str) -> PairCodec:
    """A worker's codec for a vocabulary; it outlives tasks."""
    if ranks_path not in _codecs:
        _codecs[ranks_path] = PairCodec(load_ranks(ranks_path))
    return _codecs[ranks_path]


def _pair_memo(ranks_path: str) -> Memo:
    return Memo(_codec(ranks_path).encode_pieces)


def bpe_encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``ids``: little-endian unsigned 32-bit token ids of the whole text.

    Null and empty texts have no ids.  Names of special tokens in a text are
    text like any other.  Other columns are kept as they are, save that a column
    named ``ids`` is replaced; repeated rows stay, an empty table has no rows, and
    a text of any length is one value.  One pass, no shuffle.
    """
    keep = [c for c in docs.columns if c not in (text, "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared_memo(_pair_memo, ranks_path)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids = memo.encode([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])

    source = docs.select(*keep, F.col(text))
    return source.mapInArrow(run, shape(source.select(*keep, F.lit(b"").alias("ids"))))


def bpe_decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """``df`` with ``bytes`` for ``ids``: what the ids stand for.  A null row of ids gives no bytes."""
    keep = [c for c in df.columns if c not in ("ids", "bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "bytes"])

    source = df.select(*keep, "ids")
    return source.mapInArrow(run, shape(source.select(*keep, F.lit(b"").alias("bytes"))))


def bpe_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, after encoding and decoding.

    Both in one pass, so that a task has one Python worker and one codec.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, codec = shared_memo(_pair_memo, ranks_path), _codec(ranks_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for data in memo.encode([t or "" for t in part.column("text").to_pylist()]):
                    ids = np.frombuffer(data, "<u4")
                    told = " ".join(map(str, ids.tolist())).encode()
                    rows.append((len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
                n, told, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
