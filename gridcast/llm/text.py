"""Words and hashes of whole Arrow texts, computed a chunk of documents at a time in numpy.

A text's UTF-8 bytes decide its words, so both word classes used here are sets of bytes: `SPACED` is
`[^\\x20\\x09-\\x0D]+`, `ALNUM` is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (every byte of a non-ASCII character
belongs to a word). Lower-casing changes A-Z only. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, U), "inv": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64; a long text's tables aren't kept."""
    if n <= len(_tables["pow"]):
        return _tables["pow"][:n], _tables["inv"][:n]
    size = max(n, 2 * CHUNK_BYTES)
    made = []
    for base in (_BASE, _INVERSE):
        a = np.full(size, U(base))
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if size <= 4 * CHUNK_BYTES:
        _tables["pow"], _tables["inv"] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Every output bit depends on every input bit."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more entry for the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def ranges(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `limit` bytes together, or of one document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words(NamedTuple):
    """Words of some documents: bytes, each word's begin and end, each document's first word (and the end)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words."""
        data, at = self.data, 0
        pw, inv = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * pw[: len(data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.begin]) * inv[self.begin - at])

    def strings(self, doc: int) -> list[bytes]:
        """The words of one document."""
        a, b = self.first[doc], self.first[doc + 1]
        raw = self.data.tobytes() if doc < 0 else self.data[self.begin[a] : self.end[b - 1]].tobytes() if b > a else b""
        base = self.begin[a] if b > a else 0
        return [raw[x - base : y - base] for x, y in zip(self.begin[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def split(data: np.ndarray, at: np.ndarray, word: np.ndarray, lower: bool) -> Words:
    """Words of the documents that lie at `at` in `data`; no word spans two documents."""
    if lower:
        data = LOWER[data]
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, begin, end, np.searchsorted(begin, at))


def words(texts: pa.Array, word: np.ndarray = SPACED, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for run after run of documents."""
    data, at = buffer(texts)
    for i, j in ranges(at, limit):
        yield i, j, split(data[at[i] : at[j]], at[i : j + 1] - at[i], word, lower)


class Rolling:
    """Hashes of runs of consecutive items, any length, from one prefix sum."""

    def __init__(self, items: np.ndarray):
        self.pow, self.inv = powers(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, U)
        np.cumsum(items * self.pow[: len(items)], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: np.ndarray | int, salt: int = 0) -> np.ndarray:
        end = begin + length
        return mix((self.sums[end] - self.sums[begin]) * self.inv[begin] + np.asarray(length).astype(U) * U(0xD6E8FEB86659FD93), salt)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct runs of k words, sorted; with fewer words the whole sequence, with none nothing."""
    counts = w.counts
    size = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), size)
    begin = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    h = Rolling(w.hashes()).of(begin, np.minimum(counts, k)[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
