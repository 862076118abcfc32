"""Byte-level BPE of a ``tokenizers`` .json file, compiled for fast work inside tasks.

The file's vocabulary and merge order are turned into rank tables once per Python
worker; a bounded table remembers words already encoded.  Results equal the
library's (``tests/llm/test_tokens.py`` compares them, special strings included).
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: Fixed value: the pre-tokenisation pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write each byte as one printable character: bytes that print stand for themselves, the rest
    follow from U+0100 in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Ranks and special strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        # merges in id order make rank = id; anything else would need the merge list itself
        order = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in order]
        if ids != sorted(ids):
            raise ValueError(f"{path}: merges are not in id order")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        return self.encoding.encode_ordinary(text)


class _Pieces(dict):
    """Piece -> little-endian ids; holds a bounded number of pieces, the rest are encoded anew."""

    def __init__(self, bpe: Bpe, most: int = 300_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> bytes:
        # a piece stands after a space, see _plain(); letters alone are one token group
        piece_ids = self.bpe.encoding._encode_single_piece(" " + piece) if piece.isascii() and piece.isalpha() else self.bpe.encode(" " + piece)
        got = array("I", piece_ids).tobytes()
        if len(self) < self.most:
            self[piece] = got
        return got


# white space of either definition after a space, or a space at the end: then a space need not start a token
_UNSAFE = regex.compile(r" [\s\x1c-\x1f\x85]| $")


class Encoder:
    """``ids(text)``: the ids of a whole text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.pieces = _Pieces(self.bpe)

    def _plain(self, text: str) -> bytes:
        # A token starts at each space that a non-space follows, so such a text can be cut there.
        if _UNSAFE.search(text):
            return np.asarray(self.bpe.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.asarray(self.bpe.encode(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.pieces.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        if not self.bpe.special_re or not self.bpe.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.bpe.special_re.finditer(text):
            out += [self._plain(text[at:m.start()]), int(self.bpe.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


@lru_cache(maxsize=4)
def compiled(path: str) -> Bpe:
    return Bpe(path)
