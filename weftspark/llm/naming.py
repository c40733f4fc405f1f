"""Operator 10: exact duplicates by deterministic block naming.

Texts, less their white space, are cut into blocks of one size.  Sorting the
blocks names each distinct one by an integer; then adjacent pairs of names are
named again and again until one name is left of a text.  Texts have equal names
at equal levels just when they are equal: names come from comparing blocks and
pairs themselves, so there are no collisions.

A task first numbers the distinct blocks (or pairs) of each slice of its rows.
Only those are sorted together with other slices' and named; their occurrences
then fetch the name by the slice's number, of which one slice alone has rows.  So
a block that a third of all texts share is one row a slice, in the sort and
wherever rows meet by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, discard, materialise, partition_count, shape, slices, task_number, text_bytes

#: Bytes of a block.
BLOCK = 4096


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a number (``local``) for each distinct block of a slice, with the block; and the block's occurrences, with the number.

    An occurrence at place 0 carries what is told of the document.
    """
    schema = pa.schema([("local", pa.int64()), ("block", pa.binary()), ("row", pa.int64()), ("place", pa.int64()), ("blocks", pa.int64()), ("doc_id", kind), ("n_chars", pa.int64()), ("sha", pa.string())])
    row = local = task_number() << 33
    for batch in batches:
        for part in slices(batch):
            found: dict[bytes, int] = {}
            uses: list[tuple] = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), text_bytes(part), strict=True):
                text = raw.translate(None, SPACE)
                n = max(1, -(-len(text) // size))
                for k in range(n):
                    number = found.setdefault(text[k * size : (k + 1) * size], local + len(found))
                    uses.append((number, None, row, k, n, None, None, None) if k else (number, None, row, 0, n, doc, len(raw.decode()), hashlib.sha256(text).hexdigest()))
                row += 1
            local += len(found)
            rows = [(number, block, None, None, None, None, None, None) for block, number in found.items()] + uses
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for pairs (a, b) of names."""
    schema = pa.schema([(c, pa.int64()) for c in ("local", "a", "b", "row", "place", "blocks")])
    local = task_number() << 33
    for batch in batches:
        found: dict[tuple[int, int], int] = {}
        uses: list[tuple] = []
        for row, place, blocks, a, b in zip(*(batch.column(c).to_pylist() for c in ("row", "place", "blocks", "a", "b")), strict=True):
            uses.append((found.setdefault((a, b), local + len(found)), None, None, row, place, blocks))
        local += len(found)
        rows = [(number, a, b, None, None, None) for (a, b), number in found.items()] + uses
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)


def _number(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(local, name) for sorted rows: one name for equal keys, which stand together in one partition."""
    name, last = task_number() << 38, None
    for batch in batches:
        names = []
        for key in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
            if key != last:
                name, last = name + 1, key
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("local"), pa.array(names, pa.int64())], names=["local", "name"])


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The occurrences of ``rows`` (of both kinds, written) with an integer ``name`` for their key: sorted within hash partitions and numbered while streaming."""
    distinct = rows.filter("row is null").select("local", *keys)
    ordered = distinct.repartition(partition_count(rows), *keys).sortWithinPartitions(*keys)
    names = ordered.mapInArrow(lambda it: _number(it, keys), "local long, name long")
    return rows.filter("row is not null").drop(*keys).join(names, "local").drop("local")


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_chars, sha (of the text without white space), level, name.

    Null texts count as empty and are equal to all texts without other
    characters.  A very long text has more blocks and levels; none of its rows is
    longer than a block.  Extra columns are ignored.
    """
    doc = docs.schema["doc_id"].dataType
    kind = to_arrow_type(doc)
    source = docs.select("doc_id", "text")
    made = materialise(source.mapInArrow(lambda it: _blocks(it, kind, size), f"local long, block binary, row long, place long, blocks long, doc_id {doc.simpleString()}, n_chars long, sha string"), "blocks")
    level = materialise(named(made, ["block"]), "names")
    discard(made)
    about = level.filter("place = 0").select("row", "doc_id", "n_chars", "sha")
    most = level.agg(F.max("blocks")).first()[0] or 1
    names = level.select("row", "place", "blocks", "name")
    done = names.filter("blocks = 1").select("row", F.lit(0).alias("level"), "name")
    step = 0
    while most > 1:
        step, most = step + 1, (most + 1) // 2
        half = F.shiftright("place", 1)
        pairs = (
            names.filter("blocks > 1")
            .groupBy("row", half.alias("place"), F.shiftright(F.col("blocks") + 1, 1).alias("blocks"))
            .agg(F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        made = materialise(pairs.mapInArrow(_pairs, "local long, a long, b long, row long, place long, blocks long"), f"pairs-{step}")
        names = materialise(named(made, ["a", "b"]), f"names-{step}")
        discard(made)
        done = done.unionByName(names.filter("blocks = 1").select("row", F.lit(step).alias("level"), "name"))
    return about.join(done, "row")


def exact_groups(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one of most code points in the original, then of smallest
    doc_id (null after all), then the row read first, stays: repeated rows keep
    one.  An empty table gives none.

    Groups are summed up within tasks and written before they meet their rows
    again, so that the join of a hot group can be split (AQE).
    """
    ids = materialise(identities(docs, size), "identities")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = materialise(ids.groupBy("level", "name").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
