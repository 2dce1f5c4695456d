"""Exact Jaccard self-join of documents on word n-grams, by parity sketches.

1. A document's set: 64-bit hashes of its distinct shingles. Equal sets are one node.
2. Sizes lie in bands. A band has a number of segments; the leading bits of a hash name its
   segment, the last six a bit of the segment's 64-bit word, and every element flips its
   bit. The words are the set's parity sketch: an element that only one of two sets
   has flips one bit, so the Hamming distance of two sketches never exceeds the symmetric
   difference of the sets.
3. Pigeonhole: sets of a and b >= a elements that link differ in at most ``most_apart(a)``
   elements, so of one segment more at least one is equal. Each set joins by its first
   ``most_apart(a) + 1 + spare`` segments, a set just above a band also by those
   of the band below. A segment's key holds its word and the XOR of its hashes (64 more
   parity bits). ``spare`` more segments than needed are equal in every pair that
   links, so a set whose poor segments (fewer than two elements) are at most
   ``spare`` leaves them out: poor segments are what unlike sets share by chance.
4. Sets that share keys are verified on full sets, in two steps. First each set with
   its head, the smallest set of most of its keys; what links makes clusters. Then, only
   where a key holds sets of two clusters or more, the sketches of all pairs of different
   clusters are compared, in blocks. Pairs whose Hamming distance allows a link make
   families, whose sets of different clusters are verified in blocks. The largest cluster
   of a family is not compared with itself, so a group of n copies and k sets near it
   cost about n * k comparisons, not n * n.

No pair that links is lost: 3. holds for every pair, and 4. leaves out only pairs
whose sets are connected already, or whose sketches are too far apart. Clusters, families
and classes are connected components.

Defined results: NULL and empty texts, and texts without words, have empty sets and are
linked with nothing (their class is their own id); texts of fewer than ``words`` words have one
shingle; a class's id is the smallest of its rows' ids, NULL if none has one; repeated rows are
one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, cut_lineage, ship_package, whole_text
from zonelens.llm.components import connected_components
from zonelens.llm.near_dup import by_group, forest, in_blocks, shared_counts

WORDS = 4
PERCENT = 85
#: Sketches of one block of a key, about; pairs of them that are compared at a time.
KEY_BLOCK = 512
PAIRS = 8192
#: Sets and elements of one block of a family or of a head, about.
BLOCK = 96
BLOCK_ELEMENTS = 1 << 20
#: Sets that a task remembers as done, and the keys that it emits at a time.
MEMORY = 100_000
EMIT = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(30))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The set of a text as sorted hashes; only A-Z are lowered, words end at the six ASCII spaces."""
    cut = text.encode().lower().split()
    if not cut:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut))
    size = min(words, len(cut))
    rolled = np.full(len(cut) - size + 1, size, np.uint64)
    for i in range(size):
        rolled = _mixed(rolled * _MIX + hashed[i : len(cut) - size + 1 + i])
    return np.unique(rolled)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of a set of ``size`` elements and a larger one that it links with."""
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


@lru_cache
def _edges(percent: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return tuple(edges)


def band_of(size: int, percent: int = PERCENT) -> int:
    return bisect_right(_edges(percent), size) - 1


@lru_cache(maxsize=4096)
def _band(band: int, percent: int) -> tuple[int, int, int]:
    """Largest size, spare segments, segments of a band."""
    high = _edges(percent)[band + 1] - 1
    apart = most_apart(high, percent)
    spare = 1 + apart // 8
    return high, spare, apart + 1 + spare


@lru_cache(maxsize=256)
def _bounds(segments: int) -> np.ndarray:
    """Smallest hash of each segment: equal ranges of all hashes."""
    return np.array([-(-(i << 64) // segments) for i in range(segments)], np.uint64)


def _by_segment(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """XOR of the values of each segment; 0 for segments without any."""
    out = np.zeros(len(starts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = np.bitwise_xor.reduceat(values, starts[full])
    return out


def width(size: int) -> int:
    """Words of a compared sketch: a power of two, with more than two bits per element."""
    return max(4, 1 << (max(size // 24, 1) - 1).bit_length())


def sketch(found: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of ``words`` (a power of two) 64-bit words: one flipped bit per element."""
    bits = np.bincount((found & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(bool)).view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) of fewer words: every element still flips one bit."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def segment_keys(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys that a set joins by."""
    size, out = len(found), []
    own = band_of(size, percent)
    for band in (own, own - 1):
        if band < 0:
            continue
        high, spare, segments = _band(band, percent)
        if band < own and size > 100 * high // percent:
            continue
        bounds = _bounds(segments)
        joined = min(segments, most_apart(min(size, high), percent) + 1 + spare)
        starts = np.searchsorted(found, bounds[: joined + 1])
        starts, counts = starts[:joined], np.diff(starts, append=len(found))[:joined]
        inside = found[: starts[-1] + counts[-1]]
        words = _by_segment(np.uint64(1) << (inside & np.uint64(63)), starts, counts)
        place = np.arange(joined, dtype=np.uint64) + np.uint64(band << 40)
        keys = _mixed(_mixed(_by_segment(inside, starts, counts) + place * _MIX) + words)
        poor = counts < 2
        out.append(keys[~poor] if poor.sum() <= spare else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_ROWS = "doc_id long, text_key long, n_shingles long, node long"


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: its id, its text's key, the size of its set, its node (NULL without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in column_chunks(batches, text=2):
            found = [shingle_hashes(t, words) for t in texts.to_pylist()]
            nodes = pa.array([node_of(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array([len(s) for s in found], pa.int64()), nodes], names=["doc_id", "text_key", "n_shingles", "node"])

    return _texts(docs).mapInArrow(run, _ROWS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))


def keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, node``: the segment keys of all sets; a task leaves out sets that it has just done."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            key = np.concatenate([k for k, _ in held]).view(np.int64)
            node = np.repeat(np.array([n for _, n in held], np.int64), [len(k) for k, _ in held])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

        for (texts,) in column_chunks(batches, text=0):
            for text in texts.to_pylist():
                found = shingle_hashes(text, words)
                node = node_of(found)
                if not len(found) or node in done:
                    continue
                if len(done) >= MEMORY:
                    done.clear()
                done.add(node)
                held.append((segment_keys(found, percent), node))
                size += len(held[-1][0])
                if size >= EMIT:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return docs.select(whole_text().alias("text")).mapInArrow(run, "key long, node long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key, node, head`` of the keys that two nodes or more have, each node once; the head is a key's smallest node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = node = None  # of the key that the batch before ended with
        told = False  # whether its head has been emitted
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            first = np.append(True, k[1:] != k[:-1])
            first[0] = last is None or k[0] != last
            new = np.append(True, n[1:] != n[:-1]) | first
            new[0] = first[0] or n[0] != node
            run_of = np.cumsum(first) - first[0]  # 0: goes on from the batch before, if it does
            heads = n[first] if first[0] else np.append(head, n[first])
            of = heads[run_of]
            more = new & ~first
            if told and not first[0]:
                # The head of the run that goes on is out already.
                with_head = np.unique(run_of[more & (run_of > 0)])
            else:
                with_head = np.unique(run_of[more])
            run_keys = k[first] if first[0] else np.append(k[0], k[first])
            columns = [np.append(k[more], run_keys[with_head]), np.append(n[more], heads[with_head]), np.append(of[more], heads[with_head])]
            ends = int(run_of[-1])
            told = bool((more & (run_of == ends)).any()) or (told and not first.any())
            last, head, node = k[-1], heads[ends], n[-1]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "node", "head"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, head long")


def _sets_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``node, size, shingles`` of given nodes, from one text of each."""
    wanted = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    # Rows with one text give its set once: the join is of different texts.
    texts = _texts(docs).join(wanted.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in column_chunks(batches, text=0):
            found = [shingle_hashes(t, words) for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            columns = [pa.array([node_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), values]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "shingles"])

    return texts.select("text").mapInArrow(run, "node long, size long, shingles array<long>")


def _set_arrays(table: pa.Table) -> list[np.ndarray]:
    column = table.column("shingles").combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets link, counted on full sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _units(unit: np.ndarray) -> Iterator[slice]:
    starts = np.flatnonzero(np.diff(unit, prepend=-1))
    yield from map(slice, starts.tolist(), [*starts[1:].tolist(), len(unit)])


def _with_heads(units: Iterator[tuple[np.ndarray, pa.Table]], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Links of the sets of a unit with their head."""
    for unit, table in units:
        node, head, found = table.column("node").to_numpy(), table.column("head").to_numpy(), _set_arrays(table)
        linked = []
        for rows in _units(unit):
            first = next((i for i in range(rows.start, rows.stop) if node[i] == head[i]), None)
            if first is not None:
                linked += [(node[i], head[i]) for i in range(rows.start, rows.stop) if i != first and links(found[i], found[first], percent)]
        if linked:
            yield _batch(linked)


def _sketches(found: DataFrame) -> DataFrame:
    """``node, size, sketch`` of all sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _set_arrays(pa.Table.from_batches([batch]))
            words = pa.array([sketch(s, width(len(s))).tobytes() for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), words], names=["node", "size", "sketch"])

    return found.mapInArrow(run, "node long, size long, sketch binary")


def _near(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets (by place) may link, by their sizes and the distance of their sketches."""
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    out = 100 * low >= percent * high
    words = np.array([len(x) // 8 for x in sketches])
    used = np.minimum(words[i], words[j])
    apart = (100 - percent) * (low + 100 * low // percent) // (100 + percent)
    for w in np.unique(used[out]).tolist():
        pairs = np.flatnonzero(out & (used == w))
        for at in range(0, len(pairs), PAIRS):
            part = pairs[at : at + PAIRS]
            rows, place = np.unique(np.append(i[part], j[part]), return_inverse=True)
            cut = np.stack([folded(np.frombuffer(sketches[r], np.uint64)[None, :], w)[0] for r in rows.tolist()])
            distance = np.bitwise_count(cut[place[: len(part)]] ^ cut[place[len(part) :]]).sum(axis=1, dtype=np.int64)
            out[part] = distance <= apart[part]
    return out


class Joined:
    """The components of the pairs that a task has emitted; starts anew beyond ``limit`` nodes."""

    def __init__(self, limit: int):
        self.limit, self.above = limit, {}

    def root(self, node: int) -> int:
        above = self.above
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs, taken in order, join two components; these are joined."""
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.root(x), self.root(y)
            if x != y:
                if len(self.above) > self.limit:
                    self.above.clear()
                    x, y = int(a[i]), int(b[i])
                self.above[x] = self.above[y] = min(x, y)
                out[i] = True
        return out


#: Up to this many rows, a unit's pairs are made together with those of other units.
_SMALL = 8


def _candidates(units: Iterator[tuple[np.ndarray, pa.Table]], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Pairs of different clusters whose sketches allow a link: of each task a spanning forest of them.

    Families are all that comes of the pairs, so nodes that the task's pairs connect already are not
    compared again, whatever number of keys they share.
    """
    joined = Joined(MEMORY)
    for unit, table in units:
        node, cluster, block, size = (table.column(c).to_numpy() for c in ("node", "cluster", "block", "size"))
        same_block = table.column("low").to_numpy() == table.column("high").to_numpy()
        sketches = table.column("sketch").to_pylist()
        rows_in = np.bincount(unit)[unit]
        root = np.array([joined.root(x) for x in node.tolist()], np.int64)

        def compared(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (cluster[i] != cluster[j]) & (root[i] != root[j]) & (same_block[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            ok = _near(i, j, size, sketches, percent)
            return i[ok], j[ok]

        found = []
        for lag in range(1, _SMALL):
            i = np.flatnonzero((unit[lag:] == unit[:-lag]) & (rows_in[lag:] <= _SMALL))
            i, j = compared(i, i + lag)
            found.append((node[i], node[j]))
        for rows in _units(unit):
            n = rows.stop - rows.start
            if n > _SMALL:
                linked = np.zeros((n, n), bool)
                i, j = compared(*(x + rows.start for x in np.triu_indices(n, 1)))
                linked[i - rows.start, j - rows.start] = linked[j - rows.start, i - rows.start] = True
                found += [(node[[rows.start + x]], node[[rows.start + y]]) for x, y in forest(linked)]
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        new = joined.new(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _across(units: Iterator[tuple[np.ndarray, pa.Table]], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Links between sets of different clusters, and different blocks of a unit of two."""
    for unit, table in units:
        node, cluster, block = (table.column(c).to_numpy() for c in ("node", "cluster", "block"))
        same_block = table.column("low").to_numpy() == table.column("high").to_numpy()
        found = _set_arrays(table)
        linked = []
        for rows in _units(unit):
            own = found[rows]
            size = np.array([len(s) for s in own])
            open_ = cluster[rows][:, None] != cluster[rows][None, :]
            if not same_block[rows.start]:
                open_ &= block[rows][:, None] != block[rows][None, :]
            if len(own) < 2 or not open_.any():
                continue
            i, j = np.nonzero(np.triu(open_))
            near = _near(i, j, size, [sketch(s, width(len(s))).tobytes() for s in own], percent)
            i, j = i[near], j[near]
            open_[:] = False
            open_[i, j] = open_[j, i] = True
            if len(i) <= 4 * len(own):
                linked += [(node[rows][x], node[rows][y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if links(own[x], own[y], percent)]
                continue
            both = shared_counts(own)
            open_ &= 100 * both >= percent * (size[:, None] + size[None, :] - both)
            linked += [(node[rows][x], node[rows][y]) for x, y in forest(open_)]
        if linked:
            yield _batch(linked)


def _head_links(shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each node linked with the head of most of its keys, where the full sets link."""
    votes = shared.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    voted = cut_lineage(votes.groupBy("node").agg(F.max_by("head", F.struct("n", F.col("head"))).alias("head")))
    heads = voted.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    members = voted.join(heads, "head").select("node", "head", own.alias("low"))
    copies = heads.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("low"))
    units = members.unionByName(copies).join(found, "node").select("head", "low", F.col("low").alias("high"), "node", "shingles")

    def work(rows: Iterator[tuple[np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        return _with_heads(rows, percent)

    return by_group(units, "head", work)


def _near_pairs(shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b``: sets of different clusters that share a key and whose sketches allow a link."""
    mixed = shared.groupBy("key").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.count("*").alias("n")).where("least <> most")
    rows = in_blocks(shared.join(mixed.select("key", "n"), "key"), "key", F.ceil(F.col("n") / KEY_BLOCK))
    rows = rows.join(_sketches(found), "node").select("key", "low", "high", "block", "node", "cluster", "size", "sketch")

    def work(units: Iterator[tuple[np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        return _candidates(units, percent)

    return by_group(rows, "key", work)


def _cross_links(shared: DataFrame, clusters: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between sets of different clusters that share a key."""
    placed = shared.select("key", "node").join(clusters, "node", "left").select("key", "node", F.coalesce("component", "node").alias("cluster"))
    families = connected_components(_near_pairs(cut_lineage(placed), found, percent)).withColumnRenamed("component", "family")
    members = families.join(clusters, "node", "left").select("node", "family", F.coalesce("component", "node").alias("cluster"))
    members = cut_lineage(members)
    # A family's largest cluster needs no comparison with itself.
    sizes = members.join(found.select("node", "size"), "node").groupBy("family", "cluster").agg(F.count("*").alias("n"), F.sum("size").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS))
    largest = sizes.groupBy("family").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"))
    sizes = sizes.join(largest, "family").groupBy("family", "largest", (F.col("cluster") == F.col("largest")).alias("big")).agg(F.sum("n").alias("n"), F.sum("elements").alias("elements"))
    sizes = sizes.withColumn("blocks", blocks.cast("long")).groupBy("family", "largest")
    sizes = sizes.agg(F.sum(F.when(~F.col("big"), F.col("blocks"))).alias("rest"), F.sum(F.when(F.col("big"), F.col("blocks"))).alias("main"))
    rows = members.join(sizes, "family").withColumn("big", F.col("cluster") == F.col("largest"))
    hashed = F.xxhash64("node", "family")
    own = F.when(F.col("big"), F.col("rest") + F.pmod(hashed, F.col("main"))).otherwise(F.pmod(hashed, F.col("rest")))
    others = F.when(F.col("big"), F.col("rest")).otherwise(F.col("rest") + F.col("main"))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    rows = rows.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "cluster")
    units = rows.join(found, "node").select("family", "low", "high", "block", "node", "cluster", "shingles")

    def work(rows: Iterator[tuple[np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        return _across(rows, percent)

    return by_group(units, "family", work)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = cut_lineage(sets(docs, words))
    shared = cut_lineage(shared_keys(keys(docs, words, percent)))
    found = cut_lineage(_sets_of(shared.select("node").distinct(), rows, docs, words))
    with_heads = cut_lineage(_head_links(shared, found, percent))
    clusters = connected_components(with_heads)
    across = _cross_links(shared, clusters, found, percent)
    classes = connected_components(with_heads.unionByName(across)).withColumnRenamed("component", "class")
    # Ids of classes: by node first, so that copies are added up before the joins.
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = nodes.groupBy("class").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(nodes.select("node", "class").join(least, "class").select("node", "component_id"))
    out = rows.join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
