"""Packing of documents into token sequences by Karmarkar-Karp differencing.

A document's ids (its text's, then the end id) are cut into pieces: full
sequences first, then the rest in near-equal parts of at most ``grain`` ids.
Full pieces are sequences by themselves. The parts are dealt into groups of
about ``group_parts``; each group is packed alone, so no task ever holds more
than one group. Only lengths and checksums travel, never the ids.

Within a group the parts go to ``k`` windows by multiway differencing: a
partial partition is a descending list of at most ``k`` sums; the two whose
sums differ most are merged, the largest sums of one onto the smallest of the
other, until one is left. Its windows are near-equal. ``k`` starts at the
least that the ids need and rises while a window is over capacity.

Defined results: a NULL or empty text has only the end id (one piece of length
1); repeated rows are packed each for itself; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, cut_lineage, id_and_text
from zonelens.llm.tokens import token_bytes

CAPACITY = 2048
#: Longest part of a document's rest: smaller parts balance better, larger ones keep more text together.
GRAIN = 512
#: Parts that are packed together, about.
GROUP_PARTS = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def piece_lengths(n_tokens: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of a document's pieces: full ones, then near-equal parts of the rest."""
    full, rest = divmod(n_tokens, capacity)
    parts = -(-rest // grain)
    return [capacity] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN, memory: int | None = None
) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the CRC-32 of its ids."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_bytes(tokenizer_path, memory)
        for ids, texts in column_chunks(batches):
            rows: list[tuple] = []
            for doc_id, tokens in zip(ids.to_pylist(), encoder.encode(texts.to_pylist()), strict=True):
                tokens += end
                n, start = len(tokens) // 4, 0
                for length in piece_lengths(n, capacity, grain):
                    rows.append((doc_id, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)]), n))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=PIECES.replace(" long", "").split(", "))

    return id_and_text(docs).mapInArrow(cut, PIECES)


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Indexes of ``lengths`` in ``k`` near-equal windows (Karmarkar-Karp, multiway)."""
    heap = [(-n, i, [n], [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # Empty windows are not listed: a's largest sums meet them first, b's smallest next.
        over = max(0, len(a) + len(b) - k)
        keep = len(a) - over
        sums = a[:keep] + [x + y for x, y in zip(a[keep:], reversed(b[len(b) - over :]), strict=True)] + b[: len(b) - over]
        held = in_a[:keep] + [x + y for x, y in zip(in_a[keep:], reversed(in_b[len(b) - over :]), strict=True)] + in_b[: len(b) - over]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, held = [sums[i] for i in order], [held[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), turn, sums, held))
        turn += 1
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises until none is over it."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        packed = differencing(lengths, k)
        if max((sum(lengths[i] for i in w) for w in packed), default=0) <= capacity:
            return packed
        k += 1


def pack_group(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        window, offset = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lengths = parts["length"].tolist()
        for w, members in enumerate(windows(lengths, capacity)):
            at = 0
            for i in sorted(members):
                window[i], offset[i] = w, at
                at += lengths[i]
        # Even ids are packed windows, odd ids are full pieces.
        return parts.assign(sequence_id=2 * ((parts["group"].to_numpy(np.int64) << 32) + window), offset=offset).drop(columns="group")

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    grain: int = GRAIN,
    group_parts: int = GROUP_PARTS,
    memory: int | None = None,
) -> DataFrame:
    """``PACKED`` rows: the pieces of all documents with their sequence and place in it.

    ``memory``: pre-tokens that a worker remembers (see ``tokens``).
    """
    # The row number salts the groups: copies, and rows that share an id, spread.
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, end_id, capacity, grain, memory)).withColumn("row", F.monotonically_increasing_id())
    is_part = F.col("length") < capacity
    groups = max(1, round(pieces.where(is_part).count() / group_parts))
    names = PIECES.replace(" long", "").split(", ")
    full = pieces.where(~is_part).select(*names, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(is_part).select(*names, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    return full.unionByName(parts.groupBy("group").applyInPandas(pack_group(capacity), PACKED))
