"""Token ids of the ``tokenizers`` library, looked up per pre-token.

Byte-level BPE cuts a text into pre-tokens and merges each by itself, and a
pre-token that stands alone is cut in the same way. So the library encodes
each *different* pre-token once and a text's ids are the joined ids of its
pre-tokens. Texts with characters outside U+0000..U+024F, for which the cut is
not restated here, go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import islice

from tokenizers import Tokenizer

#: Pre-tokens that a worker remembers unless told otherwise (about 200 bytes each); beyond them it starts anew.
MEMORY = 1_200_000

#: The public byte-level pattern, for characters up to U+024F: letters (which cannot start
#: a contraction, so they come first), contractions, numbers, others, white space.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_MORE_NUMBERS = "²³¹¼½¾"
_CUT = re.compile(
    rf" ?[^\W\d_{_MORE_NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[\d{_MORE_NUMBERS}]+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_FOREIGN = re.compile("[^\x00-ɏ]")
#: Pre-tokens of a very long text that are held at a time.
_RUN = 500_000


def _byte_names() -> dict[int, str]:
    """Code point of a byte -> the character that stands for it in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the others for U+0100 onwards.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("unsigned int is not 32 bits wide here")
    return out.tobytes()


class TokenBytes:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memory: int | None = None) -> None:
        self.memory = memory or MEMORY
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = pieces
        for p in new:
            named = p.encode().decode("latin-1").translate(_BYTE_NAMES)
            self.known[p] = _little_endian([t.id for t in self.merge(named)])

    def _long(self, text: str) -> bytes:
        found = (m[0] for m in _CUT.finditer(text))
        out = []
        while run := list(islice(found, _RUN)):
            self._learn(set(run))
            out.append(b"".join(map(self.known.__getitem__, run)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for t in texts:
            cut.append(None if len(t) > 10 * _RUN or not t.isascii() and _FOREIGN.search(t) else _CUT.findall(t))
        self._learn(set().union(*filter(None, cut)))
        get = self.known.__getitem__
        out = []
        for t, pieces in zip(texts, cut, strict=True):
            if pieces is not None:
                out.append(b"".join(map(get, pieces)))
            elif _FOREIGN.search(t):
                out.append(_little_endian(self.tokenizer.encode(t, add_special_tokens=False).ids))
            else:
                out.append(b"")  # encoded below: it may clear what is known
        for i, pieces in enumerate(cut):
            if pieces is None and not out[i] and texts[i]:
                out[i] = self._long(texts[i])
        return out


@lru_cache(maxsize=4)
def token_bytes(path: str, memory: int | None = None) -> TokenBytes:
    """One encoder for each worker process and vocabulary."""
    return TokenBytes(path, memory)
