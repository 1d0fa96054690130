"""Hashed byte n-grams of many texts at once, as index arrays into a fixed number of buckets."""

from __future__ import annotations

import numpy as np

_MUL = np.uint32(0x9E3779B1)


def letters_table() -> bytes:
    """ASCII letters, digits and bytes above 127 stay; all else becomes a space."""
    return bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def shape_table() -> bytes:
    """Classes: lower-case and other letters a, capitals A, digits 0; white space is a space; the rest stays."""
    return bytes(
        65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13, 32) else c for c in range(256)
    )


LETTERS, SHAPE = letters_table(), shape_table()


def joined(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space before each text and after the last; where each text starts."""
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(table), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return data, np.concatenate(([0], np.cumsum(lengths + 1)))


def gram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the n bytes from each position (n up to 8)."""
    size = max(0, len(data) - n + 1)
    h = np.full(size, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= data[k : k + size]
        h *= _MUL
        h ^= h >> np.uint32(15)
    return h


def inside_word(data: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes from each position hold no space but at either end, and not only spaces."""
    space = data == 32
    size = max(0, len(data) - n + 1)
    ok = np.ones(size, bool)
    for k in range(1, n - 1):
        ok &= ~space[k : k + size]
    if n == 1:
        ok &= ~space[:size]
    elif n == 2:
        ok &= ~(space[:size] & space[1 : 1 + size])
    return ok


class Passages:
    """Texts cut into passages of ``size`` consecutive words; a text without words has one empty passage.

    starts: byte position in ``data`` of the space before each passage; doc: the passage's text.
    """

    def __init__(self, texts: list[bytes], table: bytes, size: int):
        self.data, self.at = joined(texts, table)
        space = self.data == 32
        begin = np.flatnonzero(~space[1:] & space[:-1])  # the space before each word
        doc = np.searchsorted(self.at, begin, "right") - 1
        first = np.searchsorted(begin, self.at[:-1])
        counts = np.diff(np.append(first, len(begin)))
        chosen = (np.arange(len(begin)) - first[doc]) % size == 0
        empty = np.flatnonzero(counts == 0)
        starts = np.concatenate([begin[chosen], self.at[empty]])
        docs = np.concatenate([doc[chosen], empty])
        order = np.lexsort((starts, docs))
        self.starts, self.doc = starts[order], docs[order]
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))

    def counts(self, orders: tuple[int, ...], dims: int, whole_words: bool) -> np.ndarray:
        """Hashed n-gram counts, a row for each passage."""
        passage = np.repeat(np.arange(len(self.starts), dtype=np.int64) * dims, np.diff(np.append(self.starts, len(self.data))))
        out = np.zeros(len(self.starts) * dims, np.float32)
        skip = self.starts[0] if len(self.starts) else 0
        for n in orders:
            h = (gram_hash(self.data, n) % np.uint32(dims)).astype(np.int64)[skip:]
            h += passage[: len(h)]
            if whole_words:
                h = h[inside_word(self.data, n)[skip:]]
            out += np.bincount(h, minlength=len(out))
        return out.reshape(-1, dims)

    def bytes_of(self, i: int, raw: bytes) -> bytes:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.data)
        return raw[self.starts[i] : end]
