"""Transducer, packing and token files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from zonelens.llm import bpe_transducer, packing, queries, token_files
from zonelens.llm.tokens import TokenBytes

from .conftest import AWKWARD, SF

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def random_texts(n):
    rng = random.Random(4)
    common = list("abcdeghinorst   \n\t'.,%19_é\xa0\x85\x1c汉𝄞")
    for _ in range(n):
        yield "".join(rng.choice(common) if rng.random() < 0.8 else chr(rng.randrange(0x250)) for _ in range(rng.randrange(40)))


def test_transducer_equals_library(reference):
    encoder, decoder = bpe_transducer.machines(RANKS, P.PATTERN)
    for text in [*random_texts(4000), "a" * 3000, "ab" * 2000, " " * 500, "\n\n  x"]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert decoder.decode(ids) == "".join(decoder.pieces(ids)) == text


def test_streaming_decoder_waits_for_whole_characters():
    _, decoder = bpe_transducer.machines(RANKS, P.PATTERN)
    single = {t: i for i, t in decoder.tokens.items() if len(t) == 1}
    ids = [single[bytes([b])] for b in "é𝄞".encode()]
    assert list(decoder.pieces(ids)) == ["é", "𝄞"]
    assert list(decoder.pieces(ids[:-1]))[-1] == "�"


def test_memory_limit_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "MEMORY", 20)
    encoder = bpe_transducer.Encoder(RANKS, P.PATTERN)
    for text in random_texts(300):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_very_long_text_in_runs(reference, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "_RUN", 50)
    text = "Some words, and more of them. " * 200
    assert np.frombuffer(bpe_transducer.Encoder(RANKS, P.PATTERN).encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_op3_rows(spark, reference, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_bpe_transducer"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array(reference.encode_ordinary(text), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert want == (rows[doc_id].n_tokens, rows[doc_id].ids_sha256, rows[doc_id].decoded_sha256)


def test_encode_then_decode_awkward(awkward, nothing, reference):
    encoded = bpe_transducer.encode(awkward, RANKS, P.PATTERN)
    back = sorted((r.doc_id or 0, r.text) for r in bpe_transducer.decode(encoded, RANKS, P.PATTERN).collect())
    assert back == sorted((v[0] or 0, v[1] or "") for v in AWKWARD)
    assert bpe_transducer.round_trip_digests(nothing, RANKS, P.PATTERN).count() == 0


def test_cached_ids_equal_library(library):
    encoder = TokenBytes(JSON)
    every = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("a", "b"), (" ", " "), ("1", "'s"))]
    for text in [*random_texts(4000), *every, "汉字 <|endoftext|>", "x" * 5000]:
        assert encoder.encode([text])[0] == library(text).tobytes()


def test_cached_ids_with_little_memory(library, monkeypatch):
    import zonelens.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMORY", 10)
    monkeypatch.setattr(tokens, "_RUN", 7)
    batch = ["word " * 50 + "é", "", "汉字", "short", "another text of some words " * 9]
    assert TokenBytes(JSON).encode(batch) == [library(t).tobytes() for t in batch]


def check_packed(rows, want, capacity):
    """Every id of every document in one piece; sequences gapless and within capacity. Returns the padding's share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (doc_id, n), pieces in by_doc.items():
        ids = want[doc_id]
        copies = sum(p.start == 0 for p in pieces)
        assert len(ids) == n and sum(p.length for p in pieces) == n * copies
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padded += at if at & (at - 1) == 0 else capacity
    return 1 - sum(r.length for r in rows) / max(padded, 1)


def test_op4_rows(spark, library, texts):
    rows = queries.QUERIES["op4_packing"](spark, SF).collect()
    want = {d: np.append(library(t), 1).astype("<u4") for d, t in texts.items()}
    assert {r.doc_id for r in rows} == texts.keys()
    assert check_packed(rows, want, packing.CAPACITY) < 0.03


def test_packing_awkward(awkward, nothing, library):
    rows = packing.pack(awkward, JSON, 1, capacity=64, grain=16, group_parts=8).collect()
    want = {v[0]: np.append(library(v[1]), 1).astype("<u4") for v in AWKWARD}
    check_packed(rows, want, 64)
    assert sum(r.length for r in rows) == sum(len(library(v[1])) + 1 for v in AWKWARD)
    assert packing.pack(nothing, JSON, 1).count() == 0


def test_differencing_is_a_partition_and_balances():
    rng = random.Random(1)
    for k in (1, 2, 7, 40):
        lengths = [rng.randint(1, 512) for _ in range(200)]
        windows = packing.differencing(lengths, k)
        assert sorted(i for w in windows for i in w) == list(range(200)) and len(windows) <= k
        sums = [sum(lengths[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= max(lengths)
    assert [sum(w) for w in ([8, 7], [6, 5, 4])] == [15, 15]
    assert sorted(sorted([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) in ([[4, 5, 7], [6, 8]], [[4, 5, 6], [7, 8]], [[4, 6, 7], [5, 8]])


def test_window_count_rises_with_capacity():
    assert len(packing.windows([60, 60, 60], 100)) == 3
    assert len(packing.windows([100] * 5, 100)) == 5
    assert packing.windows([], 100) == []
    assert packing.piece_lengths(2048 * 2 + 1000) == [2048, 2048, 500, 500]


def test_op9_rows(spark, library, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_token_files"](spark, SF).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = np.append(library(texts[doc_id]), 2).astype("<u4")
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_awkward(spark, awkward, nothing, library, tmp_dir):
    token_files.write(awkward, f"{tmp_dir}/a", JSON, 2)
    stored = token_files.read(spark, f"{tmp_dir}/a").collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in stored) == sorted((v[0] or 0, (*library(v[1]).tolist(), 2)) for v in AWKWARD)
    rows = sorted(token_files.summary(spark, f"{tmp_dir}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id or 0 for r in rows] == sorted(v[0] or 0 for v in AWKWARD)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert [r.doc_id for r in token_files.find(spark, f"{tmp_dir}/a", 5).collect()] == [5]
    token_files.write(nothing, f"{tmp_dir}/b", JSON, 2)
    assert token_files.summary(spark, f"{tmp_dir}/b").count() == 0
