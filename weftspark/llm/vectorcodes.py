"""Operator 11: product-quantised vector codes with integer codebooks, nearest entries by exponion search.

Each vector becomes integers and is cut into parts; each part position has a
codebook.  A part starts at the entry that it had the round before and looks
only at entries in a ball around that one: an entry as near as the start is, by
the triangle inequality, within twice the start's distance of it.  The entry's
neighbours are sorted by distance, so the ball is a beginning of one list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, partition_count

#: Sums are shipped as digits of this base, so that long ones add up exactly.
DIGIT = 1 << 30
#: Neighbours that are looked at first; then twice as many, and so on.
RING = 16
#: Vectors that a task works on at once.
ROWS = 4096


@dataclass(frozen=True)
class Layout:
    """What all vectors share: their length, where parts begin and end, the scale, the digits of a sum."""

    bounds: tuple[tuple[int, int], ...]
    scale: int
    digits: int

    @property
    def widest(self) -> int:
        return max(b - a for a, b in self.bounds)


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers: int64 where all fit, else exact Python integers."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < 1 << 52:
        return scaled.astype(np.int64)
    exact = lambda x: math.floor(x * scale) if abs(x) < 1 << 60 else int(x) * scale  # noqa: E731  (numbers of that size are whole)
    return np.array([[exact(x) for x in row] for row in vectors.astype(np.float64).tolist()], object).reshape(vectors.shape)


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Codebook:
    """Entries of one part position, and each entry's neighbours by distance."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.k, self.width = len(entries), len(entries[0])
        self.entries = np.array(entries, object).reshape(self.k, self.width)
        self.most = _most(self.entries)
        self.kinds: dict[type, tuple] = {}

    def kind(self, most: int) -> type:
        """Numbers in which every distance, joined with an index, is exact."""
        bound = self.width * (most + self.most + 1) ** 2 * 4 * (self.k + 1)
        return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object

    def tables(self, kind: type) -> tuple:
        """Entries, their squared lengths, neighbours of each by distance (then index), and those distances."""
        if kind not in self.kinds:
            c = self.entries.astype(kind)
            squares = (c * c).sum(1)
            apart = squares[:, None] - 2 * (c @ c.T) + squares[None, :]
            near = np.argsort(apart, axis=1, kind="stable")
            self.kinds[kind] = c, squares, near, np.take_along_axis(apart, near, 1)
        return self.kinds[kind]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (ties: the lower) and the squared distance, from ``start`` on."""
        kind = self.kind(_most(x))
        c, squares, near, apart = self.tables(kind)
        x = x.astype(kind)
        own = ((x - c[start]) ** 2).sum(1)
        best = own * self.k + start
        lengths = (x * x).sum(1)
        order = np.argsort(start, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(start[order])) + 1) if len(order) else ():
            a = start[rows[0]]
            # All entries that can be as near as the start: those within twice its distance, four times its square.
            reach = np.searchsorted(apart[a], 4 * own[rows], side="right")
            low, high = 0, RING
            while True:
                rows, reach = rows[reach > low], reach[reach > low]
                if not len(rows):
                    break
                js = near[a, low:high]
                keys = (lengths[rows, None] - 2 * (x[rows] @ c[js].T) + squares[None, js]) * self.k + js[None, :]
                best[rows] = np.minimum(best[rows], keys.min(1))
                low, high = high, 2 * high
        index = best % self.k
        return index.astype(np.int64), (best - index) // self.k


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _codes(batch: pa.RecordBatch, parts: int, known: bool) -> np.ndarray:
    """Entries of the round before; nothing is known before the first."""
    return batch.column("codes").flatten().to_numpy().reshape(-1, parts).astype(np.int64) if known else np.zeros((batch.num_rows, parts), np.int64)


def _lists(codes: list[np.ndarray]) -> pa.Array:
    rows = np.stack(codes, 1).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int32()))


def _split(x: int, digits: int) -> list[int]:
    out = []
    for _ in range(digits - 1):
        out.append(x % DIGIT)
        x //= DIGIT
    return [*out, x]


class _Sums:
    """Counts and sums of the parts of each entry, in one task."""

    def __init__(self, books: list[Codebook], layout: Layout) -> None:
        self.layout = layout
        self.n = [np.zeros(b.k, np.int64) for b in books]
        self.sums = [np.zeros((b.k, b.width), np.int64 if layout.digits == 1 else object) for b in books]

    def add(self, p: int, x: np.ndarray, index: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        found, at = np.unique(index[order], return_index=True)
        self.n[p] += np.bincount(index, minlength=len(self.n[p]))
        self.sums[p][found] += np.add.reduceat(x[order], at, axis=0)

    def rows(self) -> Iterator[tuple[int, int, int, list[int]]]:
        for p, n in enumerate(self.n):
            for e in np.flatnonzero(n):
                yield p, int(e), int(n[e]), [d for s in self.sums[p][e] for d in _split(int(s), self.layout.digits)]


_SUMS = "part int, entry int, n long, digits array<long>"


def _round(books: list[Codebook], layout: Layout, known: bool):
    """Assigns parts; yields vectors with their codes, then what this task's parts add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = _Sums(books, layout), None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, were = to_integers(_matrix(part, "vector"), layout.scale), _codes(part, len(books), known)
                codes = []
                for p, (book, (a, b)) in enumerate(zip(books, layout.bounds, strict=True)):
                    codes.append(book.nearest(x[:, a:b], were[:, p])[0])
                    sums.add(p, x[:, a:b], codes[-1])
                n = part.num_rows
                told = _lists(codes)
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                out = pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), part.column("label"), told, *empty], names=["id", "vector", "label", "codes", "part", "entry", "n", "digits"])
                schema = out.schema
                yield out
        rows = list(sums.rows()) if schema is not None else []
        for i in range(0, len(rows), ROWS):
            some = [pa.array(v, t) for v, t in zip(zip(*rows[i : i + ROWS], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some[0]), f.type) for f in list(schema)[:4]), *some], schema=schema)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all tasks, entry by entry; digits add up without carrying."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for p, e, n, digits in zip(*(batch.column(k).to_pylist() for k in ("part", "entry", "n", "digits")), strict=True):
            have = found.setdefault((p, e), [0, np.zeros(len(digits), np.int64)])
            have[0] += n
            have[1] += np.array(digits, np.int64)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1].tolist() for v in found.values()], pa.list_(pa.int64()))], names=["part", "entry", "n", "digits"])


def _means(books: list[list[list[int]]], told: list, digits: int) -> list[list[list[int]]]:
    """Codebooks with each used entry replaced by the floor of its parts' mean."""
    new = [[list(e) for e in book] for book in books]
    for row in told:
        values = [sum(int(d) * DIGIT**k for k, d in enumerate(row.digits[i : i + digits])) for i in range(0, len(row.digits), digits)]
        new[row.part][row.entry] = [v // row.n for v in values]
    return new


def _kept(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, vector, label of rows whose vector is there, is not empty and holds finite numbers alone."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        rows = rows.withColumn("vector", v.cast("array<double>"))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~bad)


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes (id, label, codes: an index per part, error) of all vectors that can be coded, and the codebooks (part, entry, component).

    Vectors that are null, empty, or hold null or non-finite components are left
    out; so are those of another length than most have (of equally frequent
    lengths the longest counts).  A length that ``parts`` doesn't divide gives the
    first parts one component more.  The first ``entries`` vectors by id (null
    last; of one id by their components) are the first codebooks; with fewer
    vectors codebooks are as small.  Repeated rows count each.  Every step is
    exact, however large components are: numbers are doubles, 64-bit or Python
    integers by a bound on the distances; an error beyond a long is null.  An
    empty table gives no rows and no codebooks.  Extra columns are left out.

    A round is one narrow pass that writes vectors with their codes, and each
    task's sums beside them (an entry's sum is one row a task).  Codebooks, of
    fixed size, are all that the driver gets.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, id_column, vector_column, label_column)
    lengths = kept.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most"))
    told = lengths.orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    if not told:
        return spark.createDataFrame([], schema), []
    n, rows, most = told[0]
    cuts = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(n), parts))]).tolist()
    bounds = tuple((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
    # A task adds up fewer than `rows` digits below DIGIT.
    sum_bits = (int(most) * scale + 1).bit_length() + int(rows).bit_length()
    layout = Layout(bounds, scale, 1 if sum_bits < 62 else -(-sum_bits // 30) + 1)
    kept = kept.filter(F.size("vector") == n)
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    whole = to_integers(np.array([r.vector for r in first], np.float64), scale).astype(object)
    books = [[[int(v) for v in row[a:b]] for row in whole] for a, b in bounds]
    table, made = kept.withColumn("codes", F.lit(None).cast("array<int>")), None
    vector = kept.schema["vector"].dataType.simpleString()
    for turn in range(rounds):
        run = _round([Codebook(b) for b in books], layout, known=turn > 0)
        found = table.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, vector {vector}, label {kept.schema['label'].dataType.simpleString()}, codes array<int>, {_SUMS}")
        found = materialise(found, "codes")
        if made is not None:
            discard(made)
        made = found
        sums = found.filter("part is not null").select("part", "entry", "n", "digits")
        books = _means(books, sums.repartition(partition_count(vectors), "part", "entry").mapInArrow(_added, _SUMS).collect(), layout.digits)
        table = found.filter("part is null").select("id", "vector", "label", "codes")
    coded = materialise(table.mapInArrow(_last([Codebook(b) for b in books], layout, known=rounds > 0), schema), "coded")
    if made is not None:
        discard(made)
    return coded, books


def _last(books: list[Codebook], layout: Layout, known: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, were = to_integers(_matrix(part, "vector"), layout.scale), _codes(part, len(books), known)
                codes, error = [], [0] * len(x)
                for p, (book, (a, b)) in enumerate(zip(books, layout.bounds, strict=True)):
                    index, far = book.nearest(x[:, a:b], were[:, p])
                    codes.append(index)
                    error = [e + int(f) for e, f in zip(error, far.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), _lists(codes), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], names=["id", "label", "codes", "error"])

    return run


def vector_digest(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal labels; null if one of the errors is, or beyond a long), codebooks_sha256."""
    coded, books = encode_vectors(vectors, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= F.lit((1 << 63) - 1))
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.when(fits, total.cast("long")).alias("label_error"))
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    code = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
