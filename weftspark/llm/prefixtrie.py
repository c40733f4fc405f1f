"""Operator 13: the trie of conversations' beginnings, from a Cartesian tree over common prefix lengths.

Conversations are sorted so that those with a common beginning stand together.
Between neighbours stands a boundary with the depth to which both agree.  A
node where conversations part is a run of boundaries that are nowhere lower
than its depth; where it ends is told by the nearest lower boundary on each
side.  Blocks of the sorted order find those with a stack, each for itself; what
reaches beyond a block is a staircase of falling and rising boundaries with the
sums between them.  Staircases of neighbouring blocks are joined in the same
way, some blocks at a time, until one is left.  Boundaries of one depth in one
run are one node; depths between a node and its parent are filled in at the end.

A conversation's sort key holds only the nodes where conversations part or end.
Each such node costs another conversation that reaches so deep, so with N turns a
key has at most about sqrt(2 N) entries, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, partition_count, task_number

#: Blocks that are joined at a time.
FAN_IN = 64
#: Depths that one row is spread to at a time.
DEPTHS = 1024
#: Characters of ends that are handed on at a time.
CHUNK = 1 << 20
_MASK = (1 << 128) - 1
_NOTHING = hashlib.sha256(b"").hexdigest()


def _carries(summary: list, combine: Callable, nothing):
    """What partitions of a sorted table take over from those before: part to (key, value).

    ``summary`` rows have part, first and last key, and the value of the last key within the part.
    """
    out, key, value = {}, None, nothing
    for row in sorted(summary, key=lambda r: r.part):
        if key is not None and row.first == key:
            out[row.part] = (key, value)
            value = combine(value, row.value) if row.last == key else row.value
        else:
            value = row.value
        key = row.last
    return out


def turn_places(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), name (16 bytes that tell role and text), bytes (of the text).

    Turns stand by turn (null first), then role, then a hash of role and text;
    null roles and texts are empty; repeated rows all stay; rows without conv_id
    are left out.  Rows are dealt by range, so a long conversation spans tasks,
    which count on from one another.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), name.alias("name"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "name"]
    ordered = turns.repartitionByRange(partition_count(conversations), *order).sortWithinPartitions(*order).select("conv_id", "name", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, 0
        for batch in batches:
            convs = batch.column("conv_id").to_numpy()
            if not len(convs):
                continue
            places = np.arange(len(convs))
            begins = np.flatnonzero(np.diff(convs, prepend=convs[0] - 1 if key is None else key))
            start = np.full(len(convs), -count)
            start[begins] = begins
            at = places - np.maximum.accumulate(start)
            key, count = int(convs[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(convs), task_number()), pa.int64()), batch.column("conv_id"), pa.array(at, pa.int64()), batch.column("name"), batch.column("bytes")], names=["part", "conv_id", "at", "name", "bytes"])

    placed = materialise(ordered.mapInArrow(run, "part long, conv_id long, at long, name binary, bytes long"), "places")
    last = F.max(F.struct("conv_id", "at"))
    summary = placed.groupBy("part").agg(F.min("conv_id").alias("first"), last["conv_id"].alias("last"), (last["at"] + 1).alias("value")).collect()
    return _added_up(placed, _carries(summary, lambda a, b: a + b, 0), "at")


def _added_up(placed: DataFrame, carries: dict, column: str) -> DataFrame:
    """``column`` and what its partition takes over (at most one row a partition is told)."""
    spark = placed.sparkSession
    if carries:
        told = F.broadcast(spark.createDataFrame([(p, k, v) for p, (k, v) in carries.items()], "part long, conv_id long, more long"))
        placed = placed.join(told, ["part", "conv_id"], "left").withColumn(column, F.col(column) + F.coalesce("more", F.lit(0))).drop("more")
    return placed.drop("part")


def rebuild(places: DataFrame, period: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth, name, bytes, length: each conversation anew, a row a turn and one of depth 0.

    Conversation c gets the first h turns of conversation c - c mod period and then
    its own behind its first h, where h is crc32 of decimal c modulo ``most``.
    """
    own = places.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    facts = own.withColumns({"h": head, "base": F.col("conv_id") - F.pmod("conv_id", F.lit(period))}).join(base, "base", "left")
    have = F.least("h", F.coalesce("base_n", F.lit(0)))
    facts = materialise(facts.select("conv_id", "h", have.alias("have"), (have + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "facts")
    lent = places.filter((F.pmod("conv_id", F.lit(period)) == 0) & (F.col("at") < most - 1)).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    lent = lent.select((F.col("conv_id") + F.col("to")).alias("conv_id"), "at", "name", "bytes", F.lit(True).alias("lent"))
    both = places.withColumn("lent", F.lit(False)).select("conv_id", "at", "name", "bytes", "lent").unionByName(lent).join(facts, "conv_id")
    both = both.filter(F.when(F.col("lent"), F.col("at") < F.col("h")).otherwise(F.col("at") >= F.col("h")))
    depth = F.col("at") + 1 - F.when(F.col("lent"), 0).otherwise(F.col("h") - F.col("have"))
    heads = facts.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("bytes"), "length")
    return both.select("conv_id", depth.alias("depth"), "name", "bytes", "length").unionByName(heads)


def as_rows(places: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of :func:`rebuild`."""
    lengths = places.groupBy("conv_id").agg(F.count("*").alias("length"))
    heads = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("bytes"), "length")
    return places.join(lengths, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "name", "bytes", "length").unionByName(heads)


def beginnings(rows: DataFrame) -> DataFrame:
    """conv_id, depth, length, p, before, cum_before, cum: each beginning's name and that of the beginning one turn shorter, and the bytes of both.

    A beginning's name is the sum modulo 2^128 of a hash of each turn with its
    depth, so tasks that hold parts of one conversation add up what came before.
    """
    ordered = rows.repartitionByRange(partition_count(rows), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, size = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, depth, name, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "name", "bytes")), strict=True):
                if conv != key:
                    key, total, size = conv, 0, 0
                old, before = total, size
                if depth:
                    total = total + int.from_bytes(hashlib.blake2b(name + depth.to_bytes(8, "little"), digest_size=16).digest(), "little") & _MASK
                    size += n
                out.append((old.to_bytes(16, "big"), total.to_bytes(16, "big"), before, size))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([task_number()] * len(out), pa.int64()), *(batch.column(c) for c in ("conv_id", "depth", "length")), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["part", "conv_id", "depth", "length", "before", "p", "cum_before", "cum"])

    schema = "part long, conv_id long, depth long, length long, before binary, p binary, cum_before long, cum long"
    table = materialise(ordered.mapInArrow(run, schema), "beginnings")
    last = F.max(F.struct("conv_id", "depth", "p", "cum"))
    summary = table.groupBy("part").agg(F.min("conv_id").alias("first"), last["conv_id"].alias("last"), F.struct(last["p"].alias("p"), last["cum"].alias("cum")).alias("value")).collect()
    number = lambda v: (int.from_bytes(v.p, "big"), v.cum) if hasattr(v, "p") else v
    carries = _carries(summary, lambda a, b: tuple(x + y for x, y in zip(number(a), number(b), strict=True)), (0, 0))
    carries = {p: (k, number(v)) for p, (k, v) in carries.items()}
    if not carries:
        return table.drop("part")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("part", "conv_id", "before", "p", "cum_before", "cum")}
            for i, (part, conv) in enumerate(zip(cols["part"], cols["conv_id"], strict=True)):
                more = carries.get(part)
                if more and more[0] == conv:
                    for c in ("before", "p"):
                        cols[c][i] = (int.from_bytes(cols[c][i], "big") + more[1][0] & _MASK).to_bytes(16, "big")
                    for c in ("cum_before", "cum"):
                        cols[c][i] += more[1][1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), batch.column("length"), pa.array(cols["before"], pa.binary()), pa.array(cols["p"], pa.binary()), pa.array(cols["cum_before"], pa.int64()), pa.array(cols["cum"], pa.int64())], names=["conv_id", "depth", "length", "before", "p", "cum_before", "cum"])

    done = materialise(table.mapInArrow(carry, schema.removeprefix("part long, ")), "beginnings")
    discard(table)
    return done


def paths(begun: DataFrame) -> DataFrame:
    """conv_id and path: the nodes (depth, p, cum) along a conversation at which conversations part or end; depth 0 always."""
    onward = begun.filter("depth > 0").select(F.col("before").alias("node"), F.col("p").alias("next"))
    ends = begun.filter("depth = length").select(F.col("p").alias("node"), F.lit(None).cast("binary").alias("next"))
    kinds = onward.unionByName(ends).groupBy("node").agg(F.count("*").alias("n"), F.count("next").alias("m"), F.min("next").alias("low"), F.max("next").alias("high"))
    # Written: what many conversations pass through can then be split where it is joined.
    parting = materialise(kinds.filter("m < n or low <> high").select(F.col("node").alias("p")), "parting")
    step = F.struct("depth", "p", "cum")
    steps = begun.filter("depth > 0").join(parting, "p").select("conv_id", step.alias("step")).unionByName(begun.filter("depth = 0").select("conv_id", step.alias("step")))
    return steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("step")).alias("path"))


Step = tuple[int, str, int]  # depth, p in hex, cum
_NODE = "p string, depth long, above long, above_p string, conv_id long, n long, kids long, leaves long, shared long"


class Cartesian:
    """The stack of one block; yields nodes that end within it into ``found``.

    A run (n, least conv_id, leaves, shared bytes, lone) is what stands between two
    boundaries, complete; ``lone`` is a single conversation's last node and the
    one above it, as long as it is not known whether it hangs on a node that it
    ends in.  ``shared`` sums, over boundaries, the bytes to which both sides agree.
    """

    def __init__(self, begins: bool) -> None:
        self.begins, self.left, self.stack, self.run, self.found = begins, [], [], None, []

    def _emit(self, p, depth, above, above_p, low, n, kids, leaves, shared) -> None:
        self.found.append((p, depth, above, above_p, low, n, kids, leaves, shared))

    def _take(self, entry: dict, run: list | None) -> None:
        """``run`` hangs on ``entry`` or ends in it."""
        if run is None:
            return
        n, low, leaves, shared, lone = run
        if lone is None:
            entry["kids"] += 1
        elif lone[0] != entry["depth"]:
            self._emit(lone[1], lone[0], lone[2], lone[3], low, 1, 0, 1, 0)
            entry["kids"] += 1
            leaves = 1
        entry["n"] += n
        entry["low"] = low if entry["low"] is None else min(entry["low"], low)
        entry["leaves"] += leaves
        entry["shared"] += shared

    def _close(self, entry: dict, top: bool = False) -> list:
        leaves = entry["leaves"] if entry["kids"] else 1
        above, above_p = (-1, None) if top else (entry["above"], entry["above_p"])
        self._emit(entry["p"], entry["depth"], above, above_p, entry["low"], entry["n"], entry["kids"], leaves, entry["shared"])
        return [entry["n"], entry["low"], leaves, entry["shared"], None]

    def boundary(self, depth: int, p: str, above: int, above_p: str | None, shared: int) -> dict:
        """A boundary comes behind the current run; gives the entry of its node."""
        while self.stack and self.stack[-1]["depth"] > depth:
            entry = self.stack.pop()
            self._take(entry, self.run)
            if entry["open"]:  # what it begins with lies in blocks before
                self.left.append(entry)
                self.run = None
            else:
                self.run = self._close(entry)
        if self.stack and self.stack[-1]["depth"] == depth:
            entry = self.stack[-1]
            self._take(entry, self.run)
            entry["shared"] += shared
        else:
            entry = {"depth": depth, "p": p, "above": above, "above_p": above_p, "open": not self.stack and not self.begins, "first": None, "n": 0, "low": None, "kids": 0, "leaves": 0, "shared": shared}
            if entry["open"]:
                entry["first"] = self.run
            else:
                self._take(entry, self.run)
            self.stack.append(entry)
        self.run = None
        return entry

    def conversation(self, conv: int, path: list[Step]) -> None:
        depth, p, _ = path[-1]
        above = path[-2][:2] if len(path) > 1 else (-1, None)
        self.run = [1, conv, 0, 0, [depth, p, *above]]

    def between(self, last: list[Step], path: list[Step]) -> None:
        """The boundary between two neighbouring conversations."""
        k = 0
        while k < min(len(last), len(path)) and last[k][1] == path[k][1]:
            k += 1
        depth, p, cum = path[k - 1]
        above = path[k - 2][:2] if k > 1 else (-1, None)
        self.boundary(depth, p, *above, cum)

    def staircase(self) -> list:
        """What is not known to end in this block: entries from left to right, and the run behind them."""
        return [self.left + self.stack, self.run]

    def again(self, staircase: list) -> None:
        """Goes on with the staircase of the next block."""
        entries, run = staircase
        for e in entries:
            self.run = e["first"]
            mine = self.boundary(e["depth"], e["p"], e["above"], e["above_p"], 0)
            for k in ("n", "kids", "leaves", "shared"):
                mine[k] += e[k]
            if e["low"] is not None:
                mine["low"] = e["low"] if mine["low"] is None else min(mine["low"], e["low"])
        self.run = run

    def finish(self) -> None:
        """All blocks have been seen: everything ends here."""
        if not self.stack and self.run is not None and self.run[4]:
            depth, p, _, _ = self.run[4]
            self._emit(p, depth, -1, None, self.run[1], 1, 0, 1, 0)
        while self.stack:
            entry = self.stack.pop()
            self._take(entry, self.run)
            self.run = self._close(entry, top=not self.stack)


def _steps(path: list[dict]) -> list[Step]:
    return [(s["depth"], s["p"].hex(), s["cum"]) for s in path]


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["p", "depth", "above", "above_p", "conv_id", "n", "kids", "leaves", "shared"]
_BLOCK = f"{_NODE}, part long, seq long, chunk string, block string"


def _rows(nodes: list[tuple] = (), part: int | None = None, chunks: list[tuple[str, int, str]] = (), block: str | None = None) -> pa.RecordBatch:
    """Nodes, or chunks of ends (p, seq, text), or one block."""
    count = len(nodes) or len(chunks) or 1
    cols = [pa.array(v, t) for v, t in zip(zip(*nodes, strict=True), _KINDS, strict=True)] if nodes else [pa.nulls(count, t) for t in _KINDS]
    if chunks:
        cols[0] = pa.array([c[0] for c in chunks], pa.string())
    more = [pa.array([part] * count, pa.int64()), pa.array([c[1] for c in chunks], pa.int64()) if chunks else pa.nulls(count, pa.int64()), pa.array([c[2] for c in chunks], pa.string()) if chunks else pa.nulls(count, pa.string()), pa.array([block], pa.string()) if block else pa.nulls(count, pa.string())]
    return pa.RecordBatch.from_arrays([*cols, *more], names=[*_NAMES, "part", "seq", "chunk", "block"])


def _first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of sorted conversations: nodes that end in it, the ids of conversations that end in each node, and its staircase."""
    part, tree = task_number(), Cartesian(begins=False)
    first = last = None
    held: list[str] = []
    size = seq = 0
    chunks: list[tuple[str, int, str]] = []
    for batch in batches:
        for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
            steps = _steps(path)
            if last is None:
                first = steps
            else:
                tree.between(last, steps)
                if last[-1][1] != steps[-1][1] or size > CHUNK:
                    chunks.append((last[-1][1], seq, ",".join(held)))
                    seq, held, size = seq + 1, [], 0
            tree.conversation(conv, steps)
            last = steps
            held.append(str(conv))
            size += len(held[-1]) + 1
            if len(chunks) >= 5000 or size > CHUNK and chunks:
                yield _rows(chunks=chunks, part=part)
                chunks = []
        if tree.found:
            yield _rows(nodes=tree.found)
            tree.found = []
    if last is not None:
        yield _rows(chunks=[*chunks, (last[-1][1], seq, ",".join(held))], part=part)
        yield _rows(part=part, block=json.dumps([first, last, tree.staircase()]))


def _joined_blocks(start: int, whole: bool):
    """Staircases of neighbouring blocks become one; ``start`` is the first block there is, ``whole``: they are all of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = tree = first = last = None

        def ended() -> Iterator[pa.RecordBatch]:
            if whole:
                tree.finish()
            if tree.found:
                yield _rows(nodes=tree.found)
            if not whole:
                yield _rows(part=group, block=json.dumps([first, last, tree.staircase()]))

        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                opens, closes, staircase = json.loads(block)
                if part // FAN_IN != group:
                    if tree is not None:
                        yield from ended()
                    group, tree, first, last = part // FAN_IN, Cartesian(begins=part == start), opens, None
                if last is not None:
                    tree.between(last, opens)
                tree.again(staircase)
                last = closes
        if tree is not None:
            yield from ended()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, chunk by chunk."""
    node = state = None
    for batch in batches:
        done = []
        for p, chunk in zip(batch.column("p").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if p != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = p, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["p", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["p", "ends"])


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (see :func:`rebuild` and :func:`as_rows`), one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Conversations of equal turns are
    members of the same nodes; one without turns is a member of the root alone.
    No conversations, no nodes.
    """
    parts = partition_count(rows)
    begun = beginnings(rows)
    ways = paths(begun)
    key = F.transform("path", lambda s: s["p"])
    ordered = ways.withColumn("key", key).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "path")
    level = materialise(ordered.mapInArrow(_first_blocks, _BLOCK), "blocks")
    nodes, ends = [level.filter("depth is not null")], level.filter("chunk is not null")
    while True:
        blocks = level.filter("block is not null").select("part", "block")
        start, end = blocks.agg(F.min("part"), F.max("part")).first()
        if start is None:
            break
        whole = start // FAN_IN == end // FAN_IN
        dealt = blocks.withColumn("group", F.floor(F.col("part") / FAN_IN)).repartition(parts, "group").sortWithinPartitions("part").select("part", "block")
        level = materialise(dealt.mapInArrow(_joined_blocks(start, whole), _BLOCK), "blocks")
        nodes.append(level.filter("depth is not null"))
        if whole:
            break
    found = nodes[0]
    for n in nodes[1:]:
        found = found.unionByName(n)
    found = found.select(*_NAMES)
    digests = ends.select("p", "part", "seq", "chunk").repartition(parts, "p").sortWithinPartitions("p", "part", "seq").select("p", "chunk").mapInArrow(_digests, "p string, ends string")
    parents = found.select(F.col("p").alias("above_p"), F.col("conv_id").alias("parent"))
    told = found.join(digests, "p", "left").join(parents, "above_p", "left")
    # A node and the depths down to it from the one above, some at a time.
    spread = told.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("depth"), F.lit(DEPTHS).cast("long")))).repartition(parts, "p", "from")
    spread = spread.withColumn("d", F.explode(F.sequence("from", F.least("depth", F.col("from") + DEPTHS - 1))))
    turns = begun.select("conv_id", F.col("depth").alias("d"), "cum_before")
    node = F.col("d") == F.col("depth")
    parent = F.when(F.col("d") == F.col("above") + 1, F.col("parent")).otherwise(F.col("conv_id"))
    return spread.join(turns, ["conv_id", "d"]).select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, parent).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(node, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("cum_before")).alias("saved_tokens"),
        F.when(node, F.coalesce("ends", F.lit(_NOTHING))).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )


def trie_digest(conversations: DataFrame, period: int = 5, most: int = 9) -> DataFrame:
    """:func:`prefix_trie` of the conversations that :func:`rebuild` makes of ``conversations`` (conv_id, turn, role, text; other columns are ignored)."""
    return prefix_trie(rebuild(turn_places(conversations), period, most))
