"""Operator 12: best-fit packing under several capacities at once.

A piece of a document needs tokens, one of the documents that a sequence may
hold, and attention (the square of its length).  Pieces come longest first; each
goes to the open sequence with room in every respect that is left with the
smallest residual (or whose residual points most along the piece's needs).
Pieces are dealt at random to tasks of bounded size; what the emptiest sequences
of each task hold is dealt again to fewer tasks, until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partition_count, slices, task_number
from .packing import wide_crc
from .pieces import SLICE, largest_id, shared_memo
from .wordpieces import word_memo

#: Pieces that one task packs, about.
TASK_PIECES = 1 << 15
#: Sequences of each task that are packed anew, the emptiest ones, and tasks of which one takes them over.
REOPENED, FAN_IN = 8, 16


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents, and attention cost (the sum of its pieces' squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048

    @property
    def piece(self) -> int:
        """Length of the longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.cost))


#: By what residuals of tokens, documents and attention count: tokens decide, the others only between nearly equal ones.
WEIGHTS = (1.0, 1e-4, 1e-4)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Sequence of each piece; ``lengths`` fall.

    ``norm``: the sequence with the smallest weighted squared norm of what is left
    (each as a share of its capacity); ``dot``: the one with the greatest weighted
    dot-product of the piece's needs and what is left.  Ties: the older sequence.
    """
    caps = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    w = np.array(weights, np.float64)
    out = np.empty(len(lengths), np.int64)
    left, names, used, made = np.empty((64, 3)), np.empty(64, np.int64), 0, 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        if i & 255 == 0 and used:  # pieces only get shorter: what has no room for the last one is full
            alive = (left[:used] >= [lengths[-1], 1, float(lengths[-1]) ** 2]).all(1)
            kept = int(alive.sum())
            left[:kept], names[:kept], used = left[:used][alive], names[:used][alive], kept
        room = left[:used]
        fits = np.flatnonzero((room[:, 0] >= n) & (room[:, 1] >= 1) & (room[:, 2] >= need[2]))
        if len(fits):
            shares = room[fits] / caps
            score = ((shares - need / caps) ** 2) @ w if rule == "norm" else -(shares @ (w * need / caps))
            at = fits[int(np.argmin(score))]
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            left[used], names[used] = caps, made
            at, used, made = used, used + 1, made + 1
        left[at] -= need
        out[i] = names[at]
    return out


_PIECES = "row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, alone long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: Capacity, with_ids: bool) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, alone (a sequence's number where nothing fits beside the piece), and ids where asked for."""
    size = capacity.piece
    fills = size == capacity.tokens or size * size == capacity.cost
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = 2 if max(largest_id(tokenizer_path), end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, row, alone = shared_memo(word_memo, tokenizer_path), task_number() << 33, 1 << 62 | task_number() << 36
        dtype = np.dtype(f"<u{width}")
        end, same = np.array([end_id], dtype).tobytes(), memo.dtype == dtype
        names = ["row", "piece", "start", "length", "ids_crc32", "alone"]
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                out: list[tuple] = []
                held, at = [], []
                for k, ids in enumerate(memo.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids = (ids if same else np.frombuffer(ids, memo.dtype).astype(dtype).tobytes()) + end
                    n = len(ids) // width
                    for piece, start in enumerate(range(0, n, size)):
                        own = ids[width * start : width * min(n, start + size)]
                        length = len(own) // width
                        full = fills and length == size
                        out.append((row, piece, start, length, wide_crc(own, width), alone if full else None))
                        alone += full
                        at.append(k)
                        if with_ids:
                            held.append(own)
                    row += 1
                docs_ = part.column("doc_id").take(pa.array(at, pa.int64()))
                cols = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)]
                told = dict(zip(names, cols, strict=True)) | {"doc_id": docs_}
                order = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "alone"]
                arrays = [told[x] for x in order] + ([pa.array(held, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=order + (["ids"] if with_ids else []))

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES.format(kind=kind) + (", ids binary" if with_ids else ""))


def _packer(level: int, last: bool, capacity: Capacity, weights: tuple[float, float, float], rule: str):
    """Packs all pieces of a task, which come longest first; the emptiest sequences stay open for the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths, capacity, weights, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        begins = np.repeat((ends - lengths[order])[first], np.diff([*first, len(bins)]))
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = ends - lengths[order] - begins
        fill = np.bincount(bins, weights=lengths)
        again = np.zeros(len(fill), bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[:REOPENED]
            again[emptiest[fill[emptiest] < capacity.tokens]] = True
        number = (level << 56) + (task_number() << 24)
        keep = table.select([c for c in table.column_names if c not in ("sequence_id", "offset", "reopened")])
        for name, values in (("sequence_id", number + bins), ("offset", offsets), ("reopened", again[bins])):
            keep = keep.append_column(name, pa.array(values))
        yield from keep.to_batches(max_chunksize=10_000)

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` ids (little-endian unsigned 16-bit, 32-bit beyond that).

    A document is its ids by the tokenizer's library (added tokens in texts are
    one id each) and ``end_id``; null and empty texts are ``end_id`` alone.  Only
    documents beyond the longest piece are cut, into pieces of that length; the
    last may be shorter.  Repeated rows and rows that share a doc_id, null
    included, are packed each on its own; of equally long pieces the one read
    first goes first.  An empty table has no pieces.  Extra columns are left out.
    A long text is tokenised whole, alone in its slice.

    Full pieces are sequences as they stand.  Others are dealt by a hash, so that
    tasks of about TASK_PIECES hold like mixtures, and no key can be hot.  Pieces
    of the REOPENED emptiest sequences of each task (where most of the waste is) go
    on to a FAN_IN-th of the tasks.  Only numbers move; ids are joined at the end.
    """
    if capacity.piece < 1 or capacity.documents < 1:
        raise ValueError("a sequence must hold a token of a document")
    told = materialise(cut_pieces(docs, tokenizer_path, end_id, capacity, with_ids), "pieces")
    loose = told.filter("alone is null").drop("alone", "ids")
    whole = told.filter("alone is not null").withColumns({"sequence_id": F.col("alone"), "offset": F.lit(0).cast("long")}).drop("alone", "ids")
    count = loose.count()
    tasks = max(1, min(count // 256, max(partition_count(docs), -(-count // TASK_PIECES))))
    done, level = [whole], 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in loose.schema) + ", sequence_id long, offset long, reopened boolean"
    while True:
        dealt = loose.repartition(tasks, "row", "piece").sortWithinPartitions(F.desc("length"), "row", "piece")
        packed = materialise(dealt.mapInArrow(_packer(level, tasks == 1, capacity, weights, rule), schema), "packed")
        done.append(packed.filter("not reopened").drop("reopened"))
        if tasks == 1:
            break
        loose = packed.filter("reopened").drop("sequence_id", "offset", "reopened")
        tasks, level = -(-tasks // FAN_IN), level + 1
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    if with_ids:
        placed = placed.join(told.select("row", "piece", "ids"), ["row", "piece"])
    return placed.drop("row")


def best_fit_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0, tokens: int = 2048) -> DataFrame:
    """The pieces of :func:`pack_best_fit`, as few sequences as it can, without their ids."""
    return pack_best_fit(docs, tokenizer_path, end_id, Capacity(tokens, tokens, tokens * tokens), with_ids=False)
