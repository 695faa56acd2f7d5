"""Byte-level BPE ids of whole texts, with a cache of space-delimited chunks.

The pre-tokeniser of this vocabulary never joins characters on both sides of a
lone space, so the ids of a text are the ids of its space-led chunks in order.
Texts in which white space follows white space are encoded whole. Strings of
special tokens are ordinary text, or with ``control`` the tokens that they name.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Chunks kept in one worker; the cache starts anew beyond it, which changes no result.
CACHE_CHUNKS = 250_000
#: White space other than a space or a line end: such texts are encoded whole.
_OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        found = self[chunk] = self._encode(chunk)
        return found


class ByteBpe:
    """Encodes texts to packed ids; one object for each worker and vocabulary file."""

    def __init__(self, path: str, control: bool = False):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._named = [token.content for token in self._whole.get_added_tokens_decoder().values()] if control else []
        self._whole.encode_special_tokens = not control
        self._merge = _fast_encoder(path) or (lambda chunk: self._whole.encode(chunk, add_special_tokens=False).ids)
        self._first = _Chunks(lambda chunk: _packed(self._merge(chunk)))
        self._spaced = _Chunks(lambda chunk: _packed(self._merge(" " + chunk)))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(name in text for name in self._named) or text[0] == " " or "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
            return _packed(self._whole.encode(text, add_special_tokens=False).ids)
        first, *spaced = text.split(" ")
        return self._first[first] + b"".join(map(self._spaced.__getitem__, spaced))


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


def _fast_encoder(path: str):
    """The same vocabulary as ranks beside the JSON file, if it lies there."""
    import base64
    import os

    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("driftline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None, control: bool = False) -> ByteBpe:
    return ByteBpe(path or default_path(), control)
