"""Near-duplicate classes by MinHash with tensored banding, confirmed on full sets.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with
   equal sets are one node from here on.
2. Tensored banding: instead of ``tables**2`` independent tables of
   ``2 * ROWS`` minhashes each, two collections A and B of ``tables`` short
   keys (``ROWS`` minhashes) are drawn; table (i, j) has the key (A_i, B_j).
   So ``2 * tables * ROWS`` minhashes give all tables. Rows are shuffled by
   A_i only; pairs must also meet in some B_j, looked up where they meet.
3. Pairs that meet and whose signatures agree in ``agree`` of the minhashes
   link nodes to families. Buckets, like families below, are dealt in blocks:
   every pair of blocks is one unit of work, so a hot bucket is neither cut nor
   held in one task. Units emit a spanning forest, never all pairs.
4. Within a family all pairs are confirmed on the full sets, by counting
   shared shingles (a matrix product over the shingles that occur twice). The
   confirmed links' components are the classes.

A pair at the threshold (``Scheme.percent``: 85, or 80 for ``STAGE``) shares no table
with probability 2e-5 and fails ``agree`` with probability below 1e-6; no pair below
the threshold is linked.

Defined results: NULL and empty texts, and texts without words, have empty sets
and are linked with nothing; texts of fewer than ``WORDS`` words have one
shingle; a row without ``doc_id`` takes part and is kept only if its class has
no id; repeated rows are one node; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, cut_lineage, ship_package, whole_text
from zonelens.llm.components import connected_components

WORDS = 5
#: Minhashes of a short key.
ROWS = 3


@dataclass(frozen=True)
class Scheme:
    """A threshold (linked: 100 * intersection >= percent * union), its tables, and the minhashes that candidates agree in."""

    percent: int
    tables: int
    agree: int

    @property
    def hashes(self) -> int:
        return 2 * self.tables * ROWS


#: Of the query, and of the pipeline's stage.
QUERY = Scheme(85, 12, 43)
STAGE = Scheme(80, 16, 55)
#: Nodes of a bucket in one block, about.
BUCKET_BLOCK = 256
#: Nodes, and shingles, of a family in one block, about.
FAMILY_BLOCK = 96
FAMILY_SHINGLES = 1 << 20
#: Rows without an id get nodes from here on.
NO_ID = 1 << 62

_MULTIPLIERS = np.random.default_rng(20_240_229).integers(1, 2**63, max(QUERY.hashes, STAGE.hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    rolled = np.full(n, size, np.uint64)
    for i in range(size):
        rolled = _mixed(rolled * _MIX + hashed[i : i + n])
    return np.unique(rolled)


def minhashes(found: np.ndarray, hashes: int) -> np.ndarray:
    least = np.full(hashes, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        x = found[None, at : at + 4096] * _MULTIPLIERS[:hashes, None]
        x ^= x >> np.uint64(31)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def table_keys(least: np.ndarray) -> np.ndarray:
    """The short keys: those of A, then as many of B."""
    keys = np.arange(len(least) // ROWS, dtype=np.uint64)
    for part in least.reshape(-1, ROWS).T:
        keys = _mixed(keys * _MIX + part)
    return keys


def node_id() -> Column:
    """A row's ``doc_id``, or a large number made from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(whole_text()), F.lit(NO_ID >> 1)))


_SKETCH = "doc_id long, node long, n_shingles long, digest string, signature binary, a array<long>, b array<int>"


def sketch(docs: DataFrame, scheme: Scheme = QUERY) -> DataFrame:
    """Per row: set size, digest of the set, low bytes of the minhashes, table keys of A and B."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nodes, texts in column_chunks(batches, text=2):
            rows = []
            for text in texts.to_pylist():
                found = shingles(text)
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                least = minhashes(found, scheme.hashes)
                keys = table_keys(least)
                digest = xxhash.xxh3_128_hexdigest(found.tobytes())
                rows.append((len(found), digest, least.astype(np.uint8).tobytes(), keys[: scheme.tables].view(np.int64), keys[scheme.tables :].astype(np.uint32).view(np.int32)))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, nodes, *columns], names=["doc_id", "node", "n_shingles", "digest", "signature", "a", "b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_id().alias("node"), whole_text().alias("text"))
    return rows.mapInArrow(run, _SKETCH)


def in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks (``low`` <= ``high``) of its group that its own block is in."""
    own = F.pmod(F.xxhash64("node", group), F.col("blocks"))
    rows = rows.withColumn("blocks", blocks.cast("long")).withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")


def by_group(rows: DataFrame, group: str, work: Callable[[Iterator[list[pa.Array]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run ``work`` on whole units (group, low, high), many at a time; it emits edges ``a, b``."""
    dealt = rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(whole_units(batches))

    return dealt.mapInArrow(run, "a long, b long")


def whole_units(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows of sorted batches with the number of their unit (first three columns); a unit is never split."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([table.column(i).to_numpy() for i in range(3)])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(new):
            yield _numbered(new[:-1], table.slice(0, int(new[-1])).combine_chunks())
            table = table.slice(int(new[-1])).combine_chunks()
        held = table
    if held is not None and held.num_rows:
        yield _numbered(np.zeros(0, np.int64), held.combine_chunks())


def _numbered(new: np.ndarray, table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    flags = np.zeros(table.num_rows, np.int64)
    flags[new] = 1
    return np.cumsum(flags), table


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            i = front.pop()
            near = np.flatnonzero(linked[i] & left)
            left[near] = False
            edges += [(i, j) for j in near.tolist()]
            front += near.tolist()
    return edges


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


#: Up to this many rows, a unit's pairs are made together with those of other units.
_SMALL = 8


def _candidates(units: Iterator[tuple[np.ndarray, pa.Table]], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for unit, table in units:
        node, block = (table.column(c).to_numpy() for c in ("node", "block"))
        same_block = table.column("low").to_numpy() == table.column("high").to_numpy()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, scheme.hashes)
        b = table.column("b").combine_chunks().flatten().to_numpy().reshape(-1, scheme.tables)
        size = np.bincount(unit)[unit]
        found = []
        for lag in range(1, _SMALL):
            i = np.flatnonzero((unit[lag:] == unit[:-lag]) & (size[lag:] <= _SMALL))
            j = i + lag
            ok = (node[i] != node[j]) & (same_block[i] | (block[i] != block[j])) & (b[i] == b[j]).any(axis=1)
            i, j = i[ok], j[ok]
            ok = (signature[i] == signature[j]).sum(axis=1) >= scheme.agree
            found.append((node[i[ok]], node[j[ok]]))
        starts = np.flatnonzero(np.diff(unit, prepend=-1))
        for first in starts[size[starts] > _SMALL].tolist():
            rows = slice(first, first + int(size[first]))
            agree, meet = np.zeros((size[first],) * 2, np.uint8), np.zeros((size[first],) * 2, bool)
            for column in signature[rows].T:
                agree += column[:, None] == column[None, :]
            for column in b[rows].T:
                meet |= column[:, None] == column[None, :]
            linked = meet & (agree >= scheme.agree)
            if not same_block[first]:
                linked &= block[rows][:, None] != block[rows][None, :]
            if edges := forest(linked):
                i, j = np.array(edges).T
                found.append((node[rows][i], node[rows][j]))
        yield _edge_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections: a product over the elements that occur twice or more."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    twice = times[element] > 1
    owner, element = owner[twice], place[element[twice]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24 per block of columns
    total = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        rows = slice(*np.searchsorted(element, [at, at + columns]))
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[rows], element[rows] - at] = 1
        np.matmul(has, has.T, out=shared)
        total += shared.astype(np.int64)
    return total


def _confirmed(units: Iterator[tuple[np.ndarray, pa.Table]], percent: int) -> Iterator[pa.RecordBatch]:
    for unit, table in units:
        node, block = (table.column(c).to_numpy() for c in ("node", "block"))
        same_block = table.column("low").to_numpy() == table.column("high").to_numpy()
        column = table.column("shingles").combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        starts = np.flatnonzero(np.diff(unit, prepend=-1))
        found = []
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
            if last - first < 2:
                continue
            size = np.array([len(s) for s in sets[first:last]])
            both = shared_counts(sets[first:last])
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if not same_block[first]:
                linked &= block[first:last, None] != block[None, first:last]
            found += [(node[first + i], node[first + j]) for i, j in forest(linked)]
        if found:
            yield _edge_batch(*np.array(found, np.int64).T)


def _sets_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` (with ``node`` and ``digest``) and the shingles of each node's text."""
    rows = docs.select(node_id().alias("node"), whole_text().alias("text"))
    rows = members.join(rows, "node").select("family", "blocks", "node", "digest", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, blocks, node, digests, texts in column_chunks(batches, text=4):
            found = [shingles(t) for t in texts.to_pylist()]
            # Several texts may share an id; the node's is the one with its digest.
            own = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) == d for s, d in zip(found, digests.to_pylist(), strict=True)], pa.bool_())
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([family, blocks, node, sets], names=["family", "blocks", "node", "shingles"]).filter(own)

    return rows.mapInArrow(run, "family long, blocks long, node long, shingles array<long>")


def _classes(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``classes`` with the column ``node``."""
    ship_package(docs.sparkSession)
    sketched = cut_lineage(sketch(docs, scheme))
    nodes = sketched.where("digest is not null").groupBy("digest")
    nodes = cut_lineage(nodes.agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "a", "b"))))
    # Buckets of A: only keys that two nodes or more share go on.
    keys = nodes.select("node", F.explode("a").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = in_blocks(keys.join(shared, "key"), "key", F.ceil(F.col("size") / BUCKET_BLOCK))
    met = met.join(nodes.select("node", "signature", "b"), "node").select("key", "low", "high", "block", "node", "signature", "b")
    families = connected_components(by_group(met, "key", partial(_candidates, scheme=scheme))).withColumnRenamed("component", "family")
    # Families: every pair on full sets.
    members = families.join(nodes.select("node", "digest", "n_shingles"), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES)).alias("blocks"))
    members = cut_lineage(members.join(sizes, "family").select("family", "blocks", "node", "digest"))
    units = in_blocks(_sets_of(members, docs), "family", F.col("blocks")).select("family", "low", "high", "block", "node", "shingles")
    linked = connected_components(by_group(units, "family", partial(_confirmed, percent=scheme.percent)))
    labels = nodes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sketched.select("doc_id", "node", "n_shingles", "digest").join(labels, "digest", "left")
    component = F.coalesce("component", "node")
    # Before large node numbers become NULL: a class without any id keeps one text, too.
    return out.select("doc_id", "node", "n_shingles", F.when(component < NO_ID, component).alias("component_id"), (F.col("node") == component).alias("kept"))


def classes(docs: DataFrame, scheme: Scheme = QUERY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    return _classes(docs, scheme).drop("node")


def keep_one(docs: DataFrame, scheme: Scheme = QUERY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one document of each class, and of repeated rows one."""
    stay = _classes(docs, scheme).where("kept").select("node").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node_id().alias("node"), F.xxhash64(whole_text()).alias("text_hash"))
    copies = Window.partitionBy("node", "text_hash").orderBy(F.xxhash64("row"))
    rows = packed.join(stay, "node", "left_semi").withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
