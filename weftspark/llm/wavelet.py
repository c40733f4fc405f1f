"""Operator 8: token ids in files that are wavelet matrices.

A file holds one shard: the bit planes of its ids, most significant first, each
stably sorted by the planes before it.  Planes are cut into frames, compressed
each on its own, with counts of ones at intervals; the file tells where frames
begin and how many ones stand before each.  So one compressed file answers which
id stands at a place, how often an id stands before a place, and where its k-th
occurrence is, by reading a frame or two of each plane.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, materialise, partition_count, shared_path, slices, task_number, text_key
from .pieces import SLICE, largest_id, library_memo, shared_memo

MAGIC = b"WVLT2\n"
#: Bits between two stored counts of ones, and of a frame.
STEP, FRAME = 512, 1 << 15


class Planes:
    """Bit planes in memory, with counts of ones at intervals."""

    def __init__(self, packed: list[np.ndarray]) -> None:
        self.packed = packed
        self.counts = [_counted(p) for p in packed]

    def bit(self, plane: int, at: int) -> int:
        return int(self.packed[plane][at // 8] >> (7 - at % 8) & 1)

    def ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        return int(self.counts[plane][at // STEP]) + _within(self.packed[plane], at // STEP * STEP, at)

    def select(self, plane: int, one: bool, k: int) -> int:
        """Place of a plane's k-th one or zero, counted from 0."""
        counts = self.counts[plane]
        before = counts if one else np.arange(len(counts)) * STEP - counts
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * STEP + _find(self.packed[plane][block * (STEP // 8) : (block + 1) * (STEP // 8)], one, k - int(before[block]))

    def whole(self, plane: int) -> np.ndarray:
        return self.packed[plane]


def _counted(packed: np.ndarray) -> np.ndarray:
    """Ones before each STEP-th bit, and of all."""
    ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STEP // 8))).view(np.uint64))
    return np.concatenate([[0], np.cumsum(ones.reshape(-1, STEP // 64).sum(axis=1, dtype=np.int64))])


def _planes(values: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The bit planes of unsigned integers, packed, and the zeros of each."""
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        bit = (values >> level & 1) != 0
        planes.append(np.packbits(bit))
        zeros.append(len(bit) - int(np.count_nonzero(bit)))
        if level:  # by indices: on bits without runs several times faster than by a mask
            values = np.concatenate([np.compress(~bit, values), np.compress(bit, values)])
    return planes, zeros


def _within(packed: np.ndarray, begin: int, end: int) -> int:
    """Ones from ``begin``, the first bit of a byte, to before ``end``."""
    n, rest = int(_POPCOUNT[packed[begin // 8 : end // 8]].sum()), end % 8
    return n + (int(_POPCOUNT[packed[end // 8] >> (8 - rest)]) if rest else 0)


def _find(packed: np.ndarray, one: bool, k: int) -> int:
    return int(np.flatnonzero(np.unpackbits(packed) == one)[k])


class FramedPlanes:
    """Bit planes in a file, of which only frames that are asked for are read; the last ones stay in memory."""

    def __init__(self, read: Callable[[int, int], bytes], begins: np.ndarray, before: np.ndarray, held: int = 64) -> None:
        """``read`` gives bytes of the file by place and number; ``begins`` and ``before`` tell per plane where frames begin and the ones before them."""
        self.read, self.begins, self.before = read, begins, before
        self.frame = lru_cache(held)(self._frame)

    def _frame(self, plane: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ones within a frame, and its bits."""
        a, b = int(self.begins[plane, number]), int(self.begins[plane, number + 1])
        data = zstandard.ZstdDecompressor().decompress(self.read(a, b - a))
        n = FRAME // STEP + 1
        return np.frombuffer(data, "<u2", n), np.frombuffer(data, np.uint8, offset=2 * n)

    def bit(self, plane: int, at: int) -> int:
        number, at = divmod(at, FRAME)
        return int(self.frame(plane, number)[1][at // 8] >> (7 - at % 8) & 1)

    def ones(self, plane: int, at: int) -> int:
        number, rest = divmod(at, FRAME)
        if not rest:
            return int(self.before[plane, number])
        counts, packed = self.frame(plane, number)
        return int(self.before[plane, number]) + int(counts[rest // STEP]) + _within(packed, rest // STEP * STEP, rest)

    def select(self, plane: int, one: bool, k: int) -> int:
        ones = self.before[plane]
        before = ones if one else np.arange(len(ones)) * FRAME - ones
        number = int(np.searchsorted(before, k, side="right")) - 1
        counts, packed = self.frame(plane, number)
        k -= int(before[number])
        inside = counts.astype(np.int64) if one else np.arange(len(counts)) * STEP - counts
        block = int(np.searchsorted(inside, k, side="right")) - 1
        return number * FRAME + block * STEP + _find(packed[block * (STEP // 8) : (block + 1) * (STEP // 8)], one, k - int(inside[block]))

    def whole(self, plane: int) -> np.ndarray:
        """All frames of a plane, by one reading."""
        begins = self.begins[plane].tolist()
        data, loose, skip = self.read(begins[0], begins[-1] - begins[0]), zstandard.ZstdDecompressor(), 2 * (FRAME // STEP + 1)
        return np.frombuffer(b"".join(loose.decompress(data[a - begins[0] : b - begins[0]])[skip:] for a, b in zip(begins, begins[1:], strict=False)), np.uint8)


class WaveletMatrix:
    """Rank and select over the bit planes of a row of unsigned integers."""

    def __init__(self, size: int, planes: Planes | FramedPlanes, zeros: list[int]) -> None:
        self.size, self.planes, self.zeros, self.bits = size, planes, zeros, len(zeros)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = _planes(values, bits)
        return cls(len(values), Planes(planes), zeros)

    def access(self, at: int) -> int:
        """The value at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for p in range(self.bits):
            bit, ones = self.planes.bit(p, at), self.planes.ones(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for p in range(self.bits):
            a, b = self.planes.ones(p, start), self.planes.ones(p, stop)
            if value >> (self.bits - 1 - p) & 1:
                start, stop = self.zeros[p] + a, self.zeros[p] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, value: int, stop: int, start: int = 0) -> int:
        """Occurrences of a value in [start, stop)."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, start, stop)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of a value, counted from 0."""
        start, stop = self._range(value, 0, self.size) if not value >> self.bits else (0, 0)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        at = start + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - p) & 1)
            at = self.planes.select(p, one, at - self.zeros[p] if one else at)
        return at

    def values(self) -> np.ndarray:
        """All values in order, by undoing each plane's sort from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.size, kind)
        for p in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes.whole(p), count=self.size).astype(bool)
            back = np.empty_like(out)
            # by indices: on bits without runs several times faster than by a mask
            back[np.flatnonzero(~bit)] = out[: self.zeros[p]]
            back[np.flatnonzero(bit)] = out[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            out = back
        return out


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dump_shard(ids: np.ndarray, doc_ids: list, lengths: list[int], bits: int) -> bytes:
    """A shard as bytes: magic, header length, header (JSON), compressed index, lengths and doc_ids, then the frames of each plane.

    The index tells for each plane where frames begin and the ones before them.
    A frame is its counts of ones at each STEP-th bit (16-bit) and its bits.
    """
    planes, zeros = _planes(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames, begins, before, at = [], [], [], 0
    size, blocks = FRAME // 8, FRAME // STEP
    for packed in planes:
        counts = _counted(packed)
        own = range(0, len(packed), size)
        before.append([int(counts[k // (STEP // 8)]) for k in own] + [int(counts[-1])])
        begins.append([])
        for n, k in enumerate(own):
            part = counts[n * blocks : (n + 1) * blocks + 1]
            part = np.pad(part, (0, blocks + 1 - len(part)), mode="edge") - part[0]
            frames.append(squeeze(part.astype("<u2").tobytes() + packed[k : k + size].tobytes()))
            begins[-1].append(at)
            at += len(frames[-1])
        begins[-1].append(at)
    sections = [squeeze(x) for x in (np.array([begins, before], "<u8").tobytes(), np.array(lengths, "<u8").tobytes(), json.dumps(doc_ids).encode())]
    header = json.dumps({"size": len(ids), "bits": bits, "zeros": zeros, "documents": len(lengths), "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections, *frames])


class Shard:
    """One file: the matrix, of which lookups read only what they touch, and its documents."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        """``read`` gives bytes of the file by place and number."""
        head = read(0, len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        at = len(MAGIC) + 4
        n = struct.unpack("<I", head[len(MAGIC) :])[0]
        header = json.loads(read(at, n))
        self.header, self.read, at = header, read, at + n
        self.places = [at]
        for size in header["sections"]:
            self.places.append(self.places[-1] + size)
        begins, before = np.frombuffer(self._section(0), "<u8").astype(np.int64).reshape(2, header["bits"], -1)
        self.matrix = WaveletMatrix(header["size"], FramedPlanes(read, begins + self.places[-1], before), header["zeros"])

    def _section(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(self.places[k], self.places[k + 1] - self.places[k]))

    def documents(self) -> tuple[list, np.ndarray]:
        """The documents' ids and their lengths."""
        return json.loads(self._section(2)), np.frombuffer(self._section(1), "<u8").astype(np.int64)


def open_shard(file: pa.NativeFile) -> Shard:
    """A shard in a file that can be read at any place."""
    return Shard(lambda at, n: file.read_at(n, at))


def load_shard(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix of a shard in memory, the documents' ids and their lengths."""
    shard = Shard(lambda at, n: data[at : at + n])
    return shard.matrix, *shard.documents()


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, shard_tokens: int = 2_000_000) -> DataFrame:
    """Write the ids of all texts, in ascending doc_id order, to shard files in ``folder``; return their manifest.

    Manifest: part, shard (both ascend with doc_id), path, documents, tokens,
    bytes.  A document is its ids (added tokens in texts are one id each) and
    ``end_id``; null and empty texts are ``end_id`` alone.  doc_id is an integer
    or a string.  Null doc_ids come first; rows that share a doc_id, repeated
    rows among them, stand side by side, by a hash of their text, each with ids of its own (so one doc_id may span tasks).  An
    empty table makes no file.  A shard ends with the document that fills it, so
    one very long document makes a shard of its own length.  Extra columns are
    left out.  A file gets its name only when it is whole, and a repeated task
    makes the same files: lost executors and second attempts do no harm.
    """
    most = max(largest_id(tokenizer_path), end_id)
    bits, kind = max(1, most.bit_length()), "<u2" if most < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = shared_memo(library_memo, tokenizer_path), np.array([end_id], kind).tobytes()
        width, same = np.dtype(kind).itemsize, memo.dtype == np.dtype(kind)
        store, base = _filesystem(folder)
        part, shard, tokens = task_number(), 0, 0
        ids: list[bytes] = []
        names: list = []

        def flush() -> pa.RecordBatch:
            data = dump_shard(np.frombuffer(b"".join(ids), kind), names, [len(x) // width for x in ids], bits)
            path = f"{base}/shard-{part:06d}-{shard:06d}.wvlt"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as out:
                out.write(data)
            store.move(draft, path)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "documents": len(ids), "tokens": tokens, "bytes": len(data)}], schema=_MANIFEST)

        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                for doc, x in zip(piece.column("doc_id").to_pylist(), memo.encode([t or "" for t in piece.column("text").to_pylist()]), strict=True):
                    own = (x if same else np.frombuffer(x, memo.dtype).astype(kind).tobytes()) + end
                    ids.append(own)
                    names.append(doc)
                    tokens += len(own) // width
                    if tokens >= shard_tokens:
                        yield flush()
                        shard, tokens = shard + 1, 0
                        ids.clear()
                        names.clear()
        if ids:
            yield flush()

    source = docs.select("doc_id", "text")
    key = free_name(source, "key")
    order = ["doc_id", key, "text"]
    ordered = source.withColumn(key, text_key()).repartitionByRange(partition_count(docs), *order[:2]).sortWithinPartitions(*order).drop(key)
    return materialise(ordered.mapInArrow(run, "part long, shard long, path string, documents long, tokens long, bytes long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def read_shards(manifest: DataFrame, folder: str, checksums: bool = False, doc_type: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """doc_id (of ``doc_type``), start, n_tokens, ids (little-endian unsigned 32-bit; with ``checksums`` their ids_crc32) of every document, from the files."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("begin"))

    name, doc_kind = "ids_crc32" if checksums else "ids", to_arrow_type(doc_type)

    def told(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        own = (ids[a:b] for a, b in zip(starts, ends, strict=True))
        return pa.array([zlib.crc32(x) for x in own], pa.int64()) if checksums else pa.array([x.tobytes() for x in own], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for batch in batches:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    matrix, docs, lengths = load_shard(file.read())
                ids, ends = matrix.values().astype("<u4"), np.cumsum(lengths)
                for i in range(0, len(docs), 500):
                    e = ends[i : i + 500]
                    s = e - lengths[i : i + 500]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 500], doc_kind), pa.array(begin + s), pa.array(e - s), told(ids, s, e)], names=["doc_id", "start", "n_tokens", name])

    # one task for a few shards: files are small jobs of much work
    return placed.repartition(partition_count(manifest), "path").mapInArrow(run, f"doc_id {doc_type.simpleString()}, start long, n_tokens long, {name} {'long' if checksums else 'binary'}")


def shards_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 2_000_000) -> DataFrame:
    """Per document, as read back from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_path(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, tokenizer_path, folder, end_id, shard_tokens), folder, checksums=True, doc_type=docs.schema["doc_id"].dataType)
