"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A BPE result has a local law: a sequence of tokens is the encoding of its bytes
exactly when each neighbouring pair is the encoding of the pair's bytes. So
every prefix of a pre-token has one last token, found from the last tokens of
shorter prefixes. The transducer reads a pre-token byte by byte. Its state is
the last emitted token and the bytes that are still open: those after the
last boundary on which all continuations agree. A token can only be continued
as far as some vocabulary entry goes, so a boundary settles after a bounded
lookahead and its token is emitted. States and transitions are made when first
met and kept as integers in a table; rank merges run only on pairs of tokens
when a transition is made.

Decoding joins the tokens' bytes; its state is the unfinished UTF-8 character
(at most three bytes), its transitions by token are made lazily too.

Defined results: a NULL or empty text has no ids; repeated rows are encoded
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from zonelens.llm.common import column_chunks, id_and_text

#: Transitions and pre-tokens that a worker remembers; beyond them it starts anew.
MEMORY = 1_000_000
_RUN = 500_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Bytes of a pre-token to token ids, one byte at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.openings = {t[:n] for t in ranks for n in range(1, len(t))}  # what a longer token can begin with
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        #: Of each state: the last emitted token, the open bytes, and where the last token of each open prefix starts.
        self.content: list[tuple[bytes, bytes, tuple[int, ...]]] = [(b"", b"", (0,))]
        self.next: dict[int, int] = {}
        self.emits: dict[int, bytes] = {}
        self.ends: dict[int, bytes] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token's last merge; None for a single byte."""
        if token not in self.halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay as they are.

        Merges are undone from the last one back; what then touches the
        boundary must not have had a merge across it that came first. Of
        equal merges the left one comes first.
        """
        rank, before = self.ranks, 1 << 40
        while True:
            if rank.get(left + right, before) < before:
                return False
            a, b = self._split(left), self._split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and rank[left] > rank[right]:
                before, left = rank[left], a[1]
            else:
                before, right = rank[right] + 1, b[0]

    def _pack(self, tokens: list[bytes]) -> bytes:
        return array("I", [self.ranks[t] for t in tokens]).tobytes()

    def _last(self, left: bytes, data: bytes, starts: tuple[int, ...]) -> int:
        """Where the last token of ``data`` starts, given that of each shorter prefix."""
        for k in range(max(0, len(data) - self.longest), len(data)):
            token = data[k:]
            if token in self.ranks:
                pair = (data[starts[k] : k] if k else left, token)
                fits = self.pairs.get(pair)
                if fits is None:
                    fits = self.pairs[pair] = self._fits(*pair) if pair[0] else True
                if fits:
                    return k
        raise ValueError("the vocabulary has not all single bytes")

    @staticmethod
    def _bounds(starts: tuple[int, ...], end: int) -> list[int]:
        """Ends of the tokens of the prefix that is ``end`` bytes long."""
        out = []
        while end:
            out.append(end)
            end = starts[end]
        return out[::-1]

    def _step(self, state: int, byte: int) -> int:
        left, pending, starts = self.content[state]
        data = pending + bytes((byte,))
        n = len(data)
        starts = (*starts, self._last(left, data, starts))
        settled: list[int] = []
        if data not in self.openings:
            # A later token starts at the end, or inside where what follows can still open one.
            settled = self._bounds(starts, n)
            for j in range(1, n):
                if data[j:] in self.openings:
                    other = self._bounds(starts, j)
                    settled = [x for x, y in zip(settled, other, strict=False) if x == y]
                    if not settled:
                        break
        at, out = 0, []
        for b in settled:
            out.append(data[at:b])
            at = b
        key = (out[-1] if out else left, data[at:])
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.content)
            self.content.append((*key, tuple([x - at if x > at else 0 for x in starts[at:]]) if at else starts))
        move = state << 8 | byte
        self.next[move] = found
        if out:
            self.emits[move] = self._pack(out)
        return found

    def _end(self, state: int) -> bytes:
        _, data, starts = self.content[state]
        bounds = self._bounds(starts, len(data))
        made = self.ends[state] = self._pack([data[a:b] for a, b in zip([0, *bounds], bounds, strict=False)])
        return made

    def run(self, data: bytes) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        if len(self.next) > MEMORY:
            self._forget()
        state, out, moves, emits = 0, b"", self.next, self.emits
        for byte in data:
            move = state << 8 | byte
            state = moves.get(move)
            if state is None:
                state = self._step(move >> 8, byte)
            if move in emits:
                out += emits[move]
        last = self.ends.get(state)
        return out + (self._end(state) if last is None else last)


class Encoder:
    """Texts to ids: the public pattern cuts pre-tokens, the transducer reads each."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.cut = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = pieces
        run = self.transducer.run
        for p in new:
            self.known[p] = run(p.encode())

    def encode(self, text: str) -> bytes:
        if len(text) <= 10 * _RUN:
            pieces = self.cut.findall(text)
            self._learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))
        found, out = (m[0] for m in self.cut.finditer(text)), []
        while pieces := list(islice(found, _RUN)):
            self._learn(set(pieces))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)


class StreamDecoder:
    """Ids to text piece by piece; an unfinished character waits for its bytes."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.whole: dict[int, str] = {}  # tokens that are whole characters
        for i, t in tokens.items():
            try:
                self.whole[i] = t.decode()
            except UnicodeDecodeError:
                pass
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def _step(self, pending: bytes, token: int) -> tuple[bytes, str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        machine.setstate((pending, 0))
        text = machine.decode(self.tokens[token])
        made = self.steps[pending, token] = (machine.getstate()[0], text)
        return made

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; bytes that never get whole become U+FFFD."""
        pending, whole, steps = b"", self.whole, self.steps
        for i in ids:
            if not pending and (text := whole.get(i)) is not None:
                yield text
            else:
                pending, text = steps.get((pending, i)) or self._step(pending, i)
                if text:
                    yield text
        if pending:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            return "".join(self.pieces(ids))


@lru_cache(maxsize=2)
def machines(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One pair for each worker process and vocabulary."""
    encoder = Encoder(path, pattern)
    return encoder, StreamDecoder(encoder.transducer.tokens)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = machines(path, pattern)
        for ids, texts in column_chunks(batches):
            tokens = [encoder.encode(t) for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(tokens), "<i4"))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` (NULL ids: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(path, pattern)
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``DIGESTS`` of each text's ids and of the text that they decode to, in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(path, pattern)
        for ids, texts in column_chunks(batches):
            count, of_ids, of_text = [], [], []
            for text in texts.to_pylist():
                tokens = encoder.encode(text)
                back = hashlib.sha256()
                if len(tokens) <= 4 * _RUN:
                    back.update(decoder.decode(np.frombuffer(tokens, "<u4").tolist()).encode())
                else:  # a very long text is never held as pieces
                    for piece in decoder.pieces(map(int, np.frombuffer(tokens, "<u4"))):
                        back.update(piece.encode())
                count.append(len(tokens) // 4)
                of_ids.append(hashlib.sha256(tokens).hexdigest())
                of_text.append(back.hexdigest())
            columns = [ids, pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, DIGESTS)
