"""Operator 7: near-duplicate documents by b-bit MinHash.

Sets of word shingles are hashed; rows with one set are one node.  Bands of
minima give buckets; within a bucket the packed low bits of the minima estimate
the similarity of two nodes, corrected for bits that agree by chance.  Chains of
pairs that may be similar enough make clusters, and within a cluster pairs are
compared on their full sets, so every link is exact.  Components come from links
by large and small stars.

No bucket is given up or cut short.  In buckets as in clusters, members are first
compared with one of them, dealt by number and bytes: that joins most of a group
of copies in time that grows with it.  Only what is still apart is then compared
pair by pair, in pairs of blocks of bounded bytes, and tasks tell only the links
that join something, so that rows grow with documents and not with pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import counted
from .common import discard, free_name, materialise, partition_count, shape, slices, text_bytes

HASHES, BANDS, ROWS, BITS = 128, 25, 5, 2
#: Most members, about, and bytes of a block: two blocks are in a task's memory at a time.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Rounds in which the members that are still alone are compared with one of them, before blocks are.
PIVOTS = 2
_RNG = np.random.default_rng(20_011)
_MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_FACTORS = (_RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, known: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles of a text; of its only one if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return _mixed((h * _FACTORS[size : size + len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - size + 1] * _FACTORS[0]
    for i in range(1, size):
        total += h[i : len(h) - size + 1 + i] * _FACTORS[i]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        np.minimum(least, (part[:, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The low bits of the minima, side by side."""
    bits = (least[:, None] >> np.arange(BITS, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(bits.ravel()).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each row of ``a`` to each of ``b`` (packed signatures as 64-bit words).

    Groups of bits agree by chance once in 2**BITS; the estimate takes that out.
    """
    differ = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        x = a[:, w, None] ^ b[None, :, w]
        differ += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).astype(np.uint8)
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are similar by estimate."""
    return estimates(a, b) >= least


def least_estimate(similarity: float, deviations: float = 4.0) -> float:
    """What a pair's estimate reaches but in one case of 30,000, if the pair is this similar."""
    chance = 2.0**-BITS
    p = similarity + (1 - similarity) * chance
    return similarity - deviations * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set), signature, bands: per row of ``docs``; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part in slices(batch):
                counts, hashes, sigs, bands = [], [], [], []
                for text in text_bytes(part):
                    s = shingle_set(text, known, size)
                    counts.append(len(s))
                    if not len(s):
                        hashes.append(None), sigs.append(None), bands.append(None)
                        continue
                    least = minima(s)
                    hashes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(packed(least))
                    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                    bands.append(_mixed((rows * _FACTORS[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _FACTORS[40]).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "signature", "bands"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_hash binary, signature binary, bands array<long>")


def _signatures(members: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(m[1] for m in members), np.uint64).reshape(len(members), -1)


class ByEstimate:
    """Members of buckets, (id, signature), are similar by estimate alone."""

    columns = ("signature",)

    def __init__(self, least: float) -> None:
        self.least = least

    def to_one(self, pivot: tuple, members: list[tuple]) -> np.ndarray:
        return near(_signatures(members), _signatures([pivot]), self.least)[:, 0]

    def links(self, members: list[tuple], comps: list) -> list[tuple]:
        """Links between ``comps``: each comp to the first that it reaches over similar members."""
        numbers: dict = {}
        own = np.array([numbers.setdefault(c, len(numbers)) for c in comps])
        sigs, label = _signatures(members), np.arange(len(numbers))
        close = np.concatenate([near(sigs[i : i + 256], sigs, self.least) for i in range(0, len(sigs), 256)])
        np.fill_diagonal(close, True)
        while True:
            now = label[own]
            low = np.concatenate([np.where(close[i : i + 256], now, len(now)).min(axis=1) for i in range(0, len(now), 256)])
            new = label.copy()
            np.minimum.at(new, own, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        first = {c: m[0] for m, c in zip(reversed(members), reversed(own.tolist()), strict=True)}
        return [(first[a], first[c]) for c, a in enumerate(label.tolist()) if a != c]


class BySets:
    """Members of clusters, (id, signature, hashes), are similar by their full sets; estimates only spare comparisons."""

    columns = ("signature", "hashes")

    def __init__(self, percent: int) -> None:
        self.percent, self.least = percent, least_estimate(percent / 100)

    def _alike(self, x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common > 0 and 100 * common >= self.percent * (len(x) + len(y) - common)

    def to_one(self, pivot: tuple, members: list[tuple]) -> np.ndarray:
        close, one = near(_signatures(members), _signatures([pivot]), self.least)[:, 0], np.frombuffer(pivot[2], np.uint64)
        return np.array([c and self._alike(one, np.frombuffer(m[2], np.uint64)) for c, m in zip(close.tolist(), members, strict=True)], bool)

    def links(self, members: list[tuple], comps: list) -> list[tuple]:
        """Links that hold the comps together: pairs in order of their estimate, compared unless already joined."""
        sets, sigs = [np.frombuffer(m[2], np.uint64) for m in members], _signatures(members)
        counts = np.array([len(x) for x in sets])
        numbers: dict = {}
        own = np.array([numbers.setdefault(c, len(numbers)) for c in comps])
        root = list(range(len(numbers)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in range(0, len(sets), 256):
            rows = slice(i, i + 256)
            est = estimates(sigs[rows], sigs)
            low, high = np.minimum(counts[rows, None], counts[None, :]), np.maximum(counts[rows, None], counts[None, :])
            apart = (own[rows, None] != own[None, :]) & (np.arange(len(sets))[None, :] < np.arange(i, i + len(est))[:, None])
            r, c = np.nonzero((est >= self.least) & apart & (100 * low >= self.percent * high))
            found.append((c, r + i, est[r, c]))
        a, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
        links = []
        for k in np.argsort(-e, kind="stable").tolist():
            p, q = find(int(own[a[k]])), find(int(own[b[k]]))
            if p != q and self._alike(sets[a[k]], sets[b[k]]):
                root[q] = p
                links.append((members[a[k]][0], members[b[k]][0]))
        return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[list[tuple]]:
    """Rows of ``rest`` by runs of equal ``keys`` of sorted batches."""
    key, group = None, []
    for batch in batches:
        for k, member in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in rest), strict=True), strict=True):
            if k != key:
                if group:
                    yield group
                key, group = k, []
            group.append(member)
    if group:
        yield group


def _weight(columns: tuple[str, ...]) -> F.Column:
    return F.sum(sum((F.octet_length(c) for c in columns), F.lit(0)).cast("long")).alias("bytes")


def _shares() -> F.Column:
    """How many blocks so many members of so many bytes make."""
    return F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")


def _joined(members: list[tuple], how: ByEstimate | BySets) -> list[tuple]:
    """Links that hold similar ``members`` together: over one of them first, as between tasks; the rest in pairs."""
    comp: dict = {}
    left = members
    for _ in range(PIVOTS):
        if not left:
            break
        pivot = left[0][0]
        for m, met in zip(left, how.to_one(left[0], left).tolist(), strict=True):
            if met or m[0] == pivot:
                comp.setdefault(m[0], pivot)
        left = [m for m in left if m[0] not in comp]
    links = [(c, i) for i, c in comp.items() if c != i]
    comps = [comp.get(m[0], m[0]) for m in members]
    return links + how.links(members, comps) if len(set(comps)) > 1 else links


def _sizes(rows: DataFrame, key: str, how: ByEstimate | BySets) -> tuple[DataFrame, int]:
    """(key, shares, pivot, last: the smallest and largest id) per key, and how many keys are of several shares."""
    # Written: sizes are summed up within tasks, and the join of a key with many rows can be split (AQE).
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), _weight(how.columns), F.min("id").alias("pivot"), F.max("id").alias("last"))
    return counted(each.select(key, _shares().alias("shares"), "pivot", "last"), "sizes", "shares > 1")


def _met_one(rows: DataFrame, sizes: DataFrame, key: str, how: ByEstimate | BySets, whole: bool) -> tuple[DataFrame, int]:
    """(key, id, comp and the columns of ``how``), and how many are large keys' rows without comp.

    Members of a key of several shares are compared with that of smallest id, which
    is their comp if they are similar (itself too, and all rows of its id).  If ``rows``
    are the ``whole`` keys, one of a single share is joined to its end: of it only
    links are told, from comp to id, with no key.
    """
    first = F.col("id") == F.col("pivot")
    share = F.when(first, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "shares").cast("int")))
    dealt = rows.join(sizes, key).select(key, F.explode(share).alias("share"), (~first).alias("later"), (F.col("shares") > 1).alias("large"), "id", *how.columns)
    dealt = dealt.repartition(partition_count(rows), key, "share").sortWithinPartitions(key, "share", "later", "id")
    out_type = shape(dealt.select(key, "id", F.col("id").alias("comp"), *how.columns))
    kinds = [to_arrow_type(f.dataType) for f in out_type]

    def told(links: list[tuple]) -> pa.RecordBatch:
        n = len(links)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kinds[0]), pa.array([i for _, i in links], kinds[1]), pa.array([c for c, _ in links], kinds[2]), *(pa.nulls(n, k) for k in kinds[3:])], names=out_type.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pivot = None, None
        held: list[tuple] = []
        found: dict[tuple, None] = {}
        for batch in batches:
            at = list(zip(batch.column(key).to_pylist(), batch.column("share").to_pylist(), strict=True))
            members = list(zip(batch.column("id").to_pylist(), *(batch.column(c).to_pylist() for c in how.columns), strict=True))
            large = batch.column("large").to_pylist()
            comp: list = [None] * len(at)
            keep = [False] * len(at)
            i = 0
            while i < len(at):
                if at[i] != here:
                    found.update(dict.fromkeys(_joined(held, how)))
                    held = []
                    here, pivot = at[i], members[i]
                end = i + 1
                while end < len(at) and at[end] == here:
                    end += 1
                if whole and not large[i]:
                    held += members[i:end]
                else:
                    for k, met in enumerate(how.to_one(pivot, members[i:end]).tolist(), i):
                        first = members[k][0] == pivot[0]
                        comp[k] = pivot[0] if met or first else None
                        keep[k] = not first or here[1] == 0  # the pivot is in every share
                i = end
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("id"), pa.array(comp, kinds[2]), *(batch.column(c) for c in how.columns)], names=out_type.names).filter(pa.array(keep, pa.bool_()))
            if len(found) > 50_000:
                yield told(list(found))
                found = {}
        found.update(dict.fromkeys(_joined(held, how)))
        yield told(list(found))

    return counted(dealt.mapInArrow(run, out_type), "met", f"{key} is not null and comp is null")


def links_within(rows: DataFrame, key: str, how: ByEstimate | BySets) -> DataFrame:
    """(a, b): links that join what similar members of each ``key`` of ``rows`` (key, id and the columns of ``how``; written) hold together.

    No pair of members stays unknown but of those that are joined already.  Keys of
    one block are joined in one task; only larger ones take the further steps.
    """
    sizes, _ = _sizes(rows, key, how)
    met, left = _met_one(rows, sizes.filter("pivot < last"), key, how, whole=True)
    discard(sizes)
    links = met.filter("comp <> id").select(F.col("comp").alias("a"), F.col("id").alias("b"))
    if not left:
        return links
    state = met.filter(F.col(key).isNotNull())
    for _ in range(1, PIVOTS):
        sizes, several = _sizes(state.filter("comp is null"), key, how)
        if several:  # else what is left of a key is a block at most
            met, _ = _met_one(state.filter("comp is null"), sizes, key, how, whole=False)
            links = links.unionByName(met.filter("comp <> id").select(F.col("comp").alias("a"), F.col("id").alias("b")))
            state = state.filter("comp is not null").unionByName(met)
        discard(sizes)
        if not several:
            break
    # Members of one large comp are not compared with each other; small comps are blocks together.
    state = state.withColumn("comp", F.coalesce("comp", "id"))
    sizes = state.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"), _weight(how.columns))
    large = (F.col("n") > BLOCK // 4) | (F.col("bytes") > BLOCK_BYTES // 4)
    owner = F.when(large, F.col("comp").cast("string")).otherwise("")
    kinds = materialise(sizes.select(key, "comp", large.alias("large"), F.concat(F.when(large, "1").otherwise("0"), owner).alias("kind"), "n", "bytes"), "comp-sizes")
    blocks = materialise(kinds.groupBy(key, "kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(key, "kind", _shares().alias("blocks")), "blocks")
    others = blocks.select(key, F.col("kind").alias("other"), F.col("blocks").alias("of"))
    meet = kinds.join(blocks, [key, "kind"]).join(others, key).filter("not large or kind <> other").select(key, "comp", "kind", "blocks", "other", "of")
    own = F.concat_ws("/", F.pmod(F.xxhash64("id"), "blocks").cast("int"), "kind").alias("own")
    each = state.join(meet, [key, "comp"]).select(key, own, F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("k"), "other", "id", "comp", *how.columns)
    each = each.withColumn("other", F.concat_ws("/", "k", "other")).select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp", *how.columns)
    dealt = each.repartition(partition_count(rows), key, "i", "j").sortWithinPartitions(key, "i", "j", "id")
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, None] = {}
        for group in _groups(batches, [key, "i", "j"], ["comp", "id", *how.columns]):
            comps = [m[0] for m in group]
            if len(set(comps)) > 1:
                found.update(dict.fromkeys(how.links([m[1:] for m in group], comps)))
            if len(found) > 50_000:
                yield _link_batch(list(found), kind)
                found = {}
        yield _link_batch([x for x in found if x[0] != x[1]], kind)

    last = materialise(dealt.mapInArrow(run, shape(rows.select(F.col("id").alias("a"), F.col("id").alias("b")))), "links")
    discard(kinds, blocks)
    return links.unionByName(last)


def _link_batch(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)], names=["a", "b"])


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, id) of the bands that two or more of ``nodes`` (id, bands) have, and a few of others: one shuffle, streamed in order.

    Range-partitioned by band and id, so that a band of many nodes fills several
    partitions.  Whether the rows at a partition's edges have neighbours beyond
    is not known here: they are told.
    """
    each = nodes.select(F.explode("bands").alias("band"), "id")
    ordered = each.repartitionByRange(partition_count(nodes), "band", "id").sortWithinPartitions("band", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, band_before = None, None  # the last row so far, not told yet, and the band before it
        for batch in batches:
            if not batch.num_rows:
                continue
            band = batch.column("band").to_numpy()
            keep = np.zeros(len(band), bool)
            same = band[1:] == band[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if held is None:
                keep[0] = True
            else:
                last = held.column("band")[0].as_py()
                keep[0] |= last == band[0]
                if band_before is None or last in (band_before, band[0]):
                    yield held
            yield batch.slice(0, len(band) - 1).filter(pa.array(keep[:-1]))
            if len(band) > 1:
                band_before = int(band[-2])
            elif held is not None:
                band_before = last
            held = batch.slice(len(band) - 1)
        if held is not None:
            yield held

    return ordered.mapInArrow(run, shape(each))


def candidate_clusters(nodes: DataFrame, least: float) -> DataFrame:
    """id, label: groups of nodes that chains of pairs similar by estimate hold together; nodes alone are left out."""
    buckets = materialise(shared_bands(nodes), "buckets")
    members = materialise(buckets.join(nodes.select("id", "signature"), "id").select("band", "id", "signature"), "members")
    links = links_within(members, "band", ByEstimate(least))
    found = components(links)
    discard(buckets, members, links)
    return found.unionByName(found.select(F.col("label").alias("id"), "label").distinct())


def confirmed_links(clusters: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links that join what is linked within ``clusters`` (id, label), each confirmed on the full sets of ``docs`` (doc_id, text).

    Texts move once; what meets in tasks are sets of hashes.
    """
    clusters = materialise(clusters, "clusters")
    # Neither side is small at scale: the same join at every size.
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(clusters.hint("merge"), "id").select("label", "id", "text")
    schema = shape(texts.select("label", "id", F.lit(b"").alias("signature"), F.lit(b"").alias("hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, known, size) for t in text_bytes(part)]
                out = pa.RecordBatch.from_arrays([part.column("label"), part.column("id"), pa.array([packed(minima(x)) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["label", "id", "signature", "hashes"])
                yield out.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))

    sets = materialise(texts.mapInArrow(run, schema), "sets")
    links = links_within(sets, "label", BySets(percent))
    discard(clusters, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over ``links`` (a, b), for each other id that is in one; large and small stars in turn.

    Each step moves rows in proportion to the links; no component meets in a task.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        both = edges.select("u", "v", F.lit(True).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("up")))
        # Written, so that the join of an id with many links can be split (AQE).
        told = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"))
        # Done when each id has one link, to an id that has none.
        least, open_ids = counted(told, "least", "ups > 1 or (ups = 1 and downs > 0)")
        if not open_ids:
            discard(least)
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        large = both.filter("not up").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialise(small.filter("u <> v").distinct(), "stars")
        discard(edges, least)
        edges = new


def near_groups(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Texts with fewer words than ``size`` are one shingle; null and empty texts
    have none and are linked with nothing.  Repeated rows are one node.  Rows that
    share a doc_id are one node, linked if any of its texts is; a row without
    doc_id is linked with nothing, has no component and is kept.  An empty table
    gives none.  Of a text of any length the whole set is compared.  Other columns
    are ignored.
    """
    sigs = materialise(signatures(docs, size), "signatures")
    live = sigs.filter("doc_id is not null and set_hash is not null")
    # Signature and bands follow from the set: any row's will do.
    nodes = materialise(live.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "nodes")
    clusters = candidate_clusters(nodes, least_estimate(percent / 100))
    links = confirmed_links(clusters, docs.select("doc_id", "text"), size, percent)
    labels = components(links)
    discard(links)
    # Copies hang on their node: they take its label without a link of their own.
    node_of = nodes.select("set_hash", "id").join(labels, "id", "left").select("set_hash", F.coalesce("label", "id").alias("component"))
    tied = materialise(_shared_ids(live, node_of), "tied")
    discard(nodes, labels)
    found = sigs.select("doc_id", "n_shingles", "set_hash").join(tied, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def _shared_ids(live: DataFrame, node_of: DataFrame) -> DataFrame:
    """``node_of``, with nodes joined that are texts of one doc_id."""
    several = live.groupBy("doc_id").agg(F.min(F.xxhash64("set_hash")).alias("lo"), F.max(F.xxhash64("set_hash")).alias("hi")).filter("lo <> hi").select("doc_id")
    tied = live.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(node_of, "set_hash")
    least = tied.groupBy("doc_id").agg(F.min("component").alias("to"))
    links = tied.join(least, "doc_id").filter("component <> to").select(F.col("component").alias("a"), F.col("to").alias("b"))
    merged = components(links)
    return node_of.join(merged, node_of.component == merged.id, "left").select("set_hash", F.coalesce("label", "component").alias("component"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest doc_id, with all rows of that id; rows without doc_id stay."""
    groups = near_groups(docs, size, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(name := free_name(docs, "__kept"))).distinct()
    return docs.join(groups, docs.doc_id == groups[name], "left_semi").unionByName(docs.filter("doc_id is null"))
