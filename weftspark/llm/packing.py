"""Operator 1: pack neighbouring documents along a space-filling curve.

A document's token ids are hashed into a vector, projected to few dimensions
and numbered along the Hilbert curve.  Documents are range-sorted by that
number and cut, one behind the other, into sequences of one length; only the
very last sequence holds padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partition_count, shape, slices, task_number
from .pieces import SLICE, largest_id, library_memo, shared_memo

#: Width of the hashed vectors, dimensions and bits a dimension of the curve.
WIDTH, DIMENSIONS, BITS = 256, 3, 10


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``points`` (integers of ``bits`` bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the rotations and reflections of each level, from the largest cubes down.
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            flip = (x[d] >> level & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    # Gray decoding across dimensions.
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


class Projector:
    """Points of documents: ids hashed into WIDTH signed bins, unit length, projected by a fixed random matrix."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.matrix = rng.standard_normal((WIDTH, DIMENSIONS))

    def points(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), WIDTH))
        for i, ids in enumerate(rows):
            if len(ids):
                h = ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(7)
                out[i] = np.bincount(h % WIDTH, weights=1.0 - 2.0 * (h >> np.uint32(20) & np.uint32(1)), minlength=WIDTH)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        scaled = (out @ self.matrix / 6 + 0.5) * (1 << BITS)  # a projection of a unit vector is within 3 nearly always
        return np.clip(scaled, 0, (1 << BITS) - 1).astype(np.int64)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, checksums: bool = False) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids (little-endian unsigned 16-bit, 32-bit beyond that), doc_tokens, sequence_id, offset, curve_key.

    A document is its ids by the tokenizer's library (added tokens in texts are
    one id each) and ``end_id``; null and empty texts are ``end_id`` alone.
    Repeated rows and rows that share a doc_id, null included, are packed each
    on its own; documents at one place of the curve stand by doc_id, then as
    read.  An empty table has no pieces.  A long text is tokenised whole, alone
    in its slice.  Extra columns are left out whatever their names.  Every id is
    in exactly one piece; sequences are full but the last.  With ``checksums``,
    ids_crc32 stands in place of ids.

    Tokenising is one narrow pass, written once.  Only keys and counts are
    range-sorted to find where each document begins; ids then move in one
    shuffle at most.
    """
    width = 2 if max(largest_id(tokenizer_path), end_id) < 1 << 16 else 4

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, projector = shared_memo(library_memo, tokenizer_path), Projector()
        kind, row = np.dtype(f"<u{width}"), task_number() << 33
        end, same = np.array([end_id], kind).tobytes(), memo.dtype == kind
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids = memo.encode([t or "" for t in part.column("text").to_pylist()])
                ids = [(x if same else np.frombuffer(x, memo.dtype).astype(kind).tobytes()) + end for x in ids]
                keys = hilbert_key(projector.points([np.frombuffer(x, kind)[:-1] for x in ids]))
                rows = pa.array(range(row, row + len(ids)), pa.int64())
                row += len(ids)
                yield pa.RecordBatch.from_arrays([rows, part.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "curve_key", "doc_tokens", "ids"])

    source = docs.select("doc_id", "text")
    made = source.mapInArrow(tokens, shape(source.select(F.lit(0).cast("long").alias("row"), "doc_id", F.lit(0).cast("long").alias("curve_key"), F.lit(0).cast("long").alias("doc_tokens"), F.lit(b"").alias("ids"))))
    made = materialise(made, "tokens")
    places = document_starts(made.select("row", "doc_id", "curve_key", "doc_tokens"))
    joined = made.join(places, "row")
    kind = made.schema["doc_id"].dataType.simpleString()
    told = "ids_crc32 long" if checksums else "ids binary"
    return joined.mapInArrow(_cutter(length, width, checksums), f"doc_id {kind}, start long, length long, {told}, doc_tokens long, sequence_id long, offset long, curve_key long")


def document_starts(made: DataFrame) -> DataFrame:
    """row, begin: the tokens before each document in the order of the curve.

    Sums within range partitions, then of whole partitions: nothing but one row
    a partition is gathered.
    """

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = task_number(), 0
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), number), pa.int64()), pa.array(ends - n), batch.column("doc_tokens")], names=["row", "part", "within", "doc_tokens"])
            total = int(ends[-1]) if len(n) else total

    order = ["curve_key", "doc_id", "row"]
    ordered = made.repartitionByRange(partition_count(made), *order).sortWithinPartitions(*order)
    placed = materialise(ordered.mapInArrow(running, "row long, part long, within long, doc_tokens long"), "places")
    parts = placed.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, "part").select("row", (F.col("before") + F.col("within")).alias("begin"))


def _cutter(length: int, width: int, checksums: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                out: list[tuple] = []
                cols = [part.column(c).to_pylist() for c in ("doc_id", "ids", "doc_tokens", "begin", "curve_key")]
                for doc, ids, n, begin, key in zip(*cols, strict=True):
                    at = 0
                    while at < n:
                        sequence, offset = divmod(begin + at, length)
                        size = min(n - at, length - offset)
                        own = ids[width * at : width * (at + size)]
                        out.append((doc, at, size, wide_crc(own, width) if checksums else own, n, sequence, offset, key))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 8, [part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64() if checksums else pa.binary(), *[pa.int64()] * 4], strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32" if checksums else "ids", "doc_tokens", "sequence_id", "offset", "curve_key"],
                )

    return run


def wide_crc(ids: bytes, width: int = 2) -> int:
    """Crc32 of ids of so many bytes as little-endian unsigned 32-bit ones."""
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def pack_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """The pieces of :func:`pack` with a checksum in place of their ids."""
    return pack(docs, tokenizer_path, end_id, length, checksums=True)
