"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import xxhash

#: Path of the vocabulary (ranks of a byte-level BPE), and the pattern that cuts a text before the merges.
VOCABULARY = os.environ.get("MATCHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of that vocabulary
_open: dict = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, opened once in each worker."""
    if path not in _open:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _open[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


FULL_PATTERN = regex.compile(PATTERN)
#: The same cut in classes that are quicker to match; alike unless a text holds a sign of ``unlike()``.
QUICK_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


SEPARATORS = "\x1c\x1d\x1e\x1f"


@lru_cache
def unlike() -> frozenset[str]:
    """Signs that the two patterns class differently: numbers that are no digits, and separators that count as space in one only."""
    return frozenset([*SEPARATORS, *(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))])


def cut(text: str) -> list[str]:
    """The pieces of a text, within which alone tokens are merged."""
    alike = not any(c in text for c in SEPARATORS) if text.isascii() else unlike().isdisjoint(text)
    return (QUICK_PATTERN if alike else FULL_PATTERN).findall(text)


class Pieces(dict):
    """Tokens of a piece, and the hash of the word it holds: ``tokens << 33 | has a word << 32 | hash``.

    Kept for the next time; emptied when grown to ``room`` pieces.
    """

    def __init__(self, path: str = VOCABULARY, room: int = 200_000):
        super().__init__()
        self.room, self.encoding = room, encoding(path)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.room:
            self.clear()
        word = piece.strip().lower()
        value = len(self.encoding.encode_ordinary(piece)) << 33
        if word[:1].isalnum():
            value |= 1 << 32 | xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        self[piece] = value
        return value


def counted(text: str | None, pieces: Pieces) -> tuple[int, np.ndarray]:
    """Number of tokens of a text, and the hashes of its words in order; unpaired surrogates count as the replacement character."""
    if not text:
        return 0, np.zeros(0, np.uint32)
    found = np.fromiter(map(pieces.__getitem__, cut(text)), np.int64)
    return int((found >> 33).sum()), (found[(found >> 32) & 1 == 1] & 0xFFFFFFFF).astype(np.uint32)


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Number of tokens by the whole text at once; 0 for null and empty texts."""
    return len(encoding(path).encode_ordinary(text)) if text else 0
