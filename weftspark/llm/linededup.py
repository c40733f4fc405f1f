"""Operator 2: drop lines that an earlier document holds, told by keep bitmaps.

Hashes of line keys are range-partitioned with documents and positions as
secondary sort keys, so that the occurrences of one frequent line spread over
as many partitions as they fill.  Each partition is streamed once; only a
partition's first run of a hash may have begun in one before, and those rows
wait for the smallest document that any partition saw of the hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialise, partition_count, shape, slices, task_number, text_bytes, text_key

_LINES = "doc_id {doc}, text_key long, n_lines long, position long, h1 long, h2 long"


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """A row for each line whose key is long enough, and one at position -1 for each document; ``h1``, ``h2``: its key's 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row: list[int] = []
                counts: list[int] = []
                positions: list[int] = []
                hashes: list[bytes] = []
                for i, text in enumerate(text_bytes(part)):
                    lines = text.split(b"\n")
                    row.append(i)
                    positions.append(-1)
                    hashes.append(_NONE)
                    for k, line in enumerate(lines):
                        key = line.strip(SPACE).lower()
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            row.append(i)
                            positions.append(k)
                            hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                    counts.append(len(lines))
                at = pa.array(row, pa.int64())
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("text_key").take(at), pa.array(counts, pa.int64()).take(at), pa.array(positions, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                    names=["doc_id", "text_key", "n_lines", "position", "h1", "h2"],
                )

    source = docs.select("doc_id", text_key().alias("text_key"), "text")
    return source.mapInArrow(run, _LINES.format(doc=source.schema["doc_id"].dataType.simpleString()))


_NONE = bytes(16)


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: those certainly dropped, and all of the partition's first hash with what must still be learnt.

    kind 0: dropped; 1: waits, of the first run; 2: ``doc_id`` is the smallest
    document that this partition has of its first or last hash.
    """
    part, first, last, doc, seen = task_number(), None, None, None, False
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        if not len(h1):
            continue
        new = np.empty(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last != (h1[0], h2[0])
        docs = batch.column("doc_id").to_pylist()
        starts = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        kinds = []
        if first is None:
            first = h1[0], h2[0]
        heads = (h1 == first[0]) & (h2 == first[1])
        for i, s in enumerate(starts.tolist()):
            smallest = docs[s] if s >= 0 else doc
            kinds.append(1 if heads[i] else 0 if docs[i] != smallest else -1)
        if not seen:
            yield _with_kind(batch.slice(0, 1), 2, part)
            seen = True
        s = int(starts[-1])
        if s >= 0:
            doc, tail = docs[s], batch.slice(s, 1)
        last = h1[-1], h2[-1]
        kinds_array = np.array(kinds)
        chosen = np.flatnonzero(kinds_array >= 0)
        if len(chosen):
            out = batch.take(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kinds_array[chosen], pa.int64()), pa.array(np.full(len(chosen), part), pa.int64())], names=[*out.schema.names, "kind", "part"])
    if seen and last != first:
        yield _with_kind(tail, 2, part)


def _with_kind(batch: pa.RecordBatch, kind: int, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind], pa.int64()), pa.array([part], pa.int64())], names=[*batch.schema.names, "kind", "part"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep: a compressed bitmap of the lines that stay, first line in the highest bit.

    A key of at least ``min_chars`` code points in two or more documents stays
    in the smallest doc_id alone, with all its repeats there.  Rows that share a
    doc_id count as one document; a null doc_id is a document that sorts after
    all others.  Null and empty texts are one empty line.  Rows that repeat
    doc_id and text have one result row.  ``keep`` is null where all lines stay.
    An empty table gives none.  A text or line of any length is read whole; only
    hashes of lines are shuffled.  Other columns are ignored.
    """
    lines = materialise(line_keys(docs, min_chars), "lines")
    found = lines.filter("position >= 0").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "position", "h1", "h2")
    order = ["h1", "h2", "no_id", "doc_id", "position"]
    ordered = found.repartitionByRange(partition_count(docs), *order).sortWithinPartitions(*order)
    schema = ordered.select("*", F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("part"))
    streamed = materialise(ordered.mapInArrow(_first_runs, shape(schema)), "runs")
    # At most two rows a shuffle partition, each of a few numbers: the smallest document that each saw of the hashes at
    # its edges.  They go to all tasks, so that the waiting rows of a frequent line stay dealt as they are.
    edges = streamed.filter("kind = 2").groupBy("h1", "h2").agg(F.min(F.struct("no_id", "doc_id")).alias("owner"))
    waiting = streamed.filter("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).filter(~F.col("owner.doc_id").eqNullSafe(F.col("doc_id")))
    dropped = streamed.filter("kind = 0").select("doc_id", "text_key", "position").unionByName(waiting.select("doc_id", "text_key", "position"))
    per_doc = dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("position")).alias("gone")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "gone")
    each = lines.filter("position = -1").select("doc_id", "text_key", "n_lines").distinct()
    joined = each.join(per_doc, each.doc_id.eqNullSafe(per_doc.d) & (each.text_key == per_doc.k), "left").select("doc_id", "text_key", "n_lines", "gone")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = [], []
            for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                counts.append(len(gone or []))
                if gone:
                    bits = np.ones(n, bool)
                    bits[gone] = False
                    maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                else:
                    maps.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "n_lines")), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    return joined.mapInArrow(bitmaps, shape(joined.select("doc_id", "text_key", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.lit(b"").alias("keep"))))


def read_bitmap(keep: bytes | None, n_lines: int) -> np.ndarray:
    """The bitmap as booleans, one a line."""
    if keep is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with the bitmap of each row, and the names of the new columns: number of lines, of dropped lines, bitmap.  Every row stays."""
    n, gone, keep, doc, key = (free_name(docs, x) for x in ("__n_lines", "__n_dropped", "__keep", "__doc", "__key"))
    right = maps.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("n_lines").alias(n), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    joined = docs.join(right, docs.doc_id.eqNullSafe(right[doc]) & (text_key() == right[key]), "left")
    return joined.drop(doc, key), n, gone, keep


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join([x for x, k in zip(lines, read_bitmap(keep, len(lines)).tolist(), strict=True) if k])


def keep_lines(docs: DataFrame, maps: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with only the lines that stay in ``text``; null texts stay null, rows and other columns as they are."""
    names = docs.columns
    joined, _, _, keep = with_bitmaps(docs, maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = [None if t is None else kept_text(t, k).decode() for t, k in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column(keep).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else part.column(c) for c in names], names=names)

    return joined.select(*names, keep).mapInArrow(run, shape(docs))


def line_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 of the text that its bitmap leaves."""
    joined, n, gone, keep = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(kept_text(t, k)).hexdigest() for t, k in zip(text_bytes(batch), batch.column(keep).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(n), batch.column(gone), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, shape(joined.select("doc_id", F.col(n).alias("n_lines"), F.col(gone).alias("n_dropped"), F.lit("").alias("kept_sha256"))))
