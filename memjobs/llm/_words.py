"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Everything
works on the UTF-8 buffer of an Arrow column, about a megabyte at a time, so
memory follows the block and the longest single text, not the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
LONG = 64  # bytes of a word beyond which it is hashed on its own
_PRIME = 4294967291
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEQUENCE_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them); nulls have no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    hash: np.ndarray  # uint64 of each word
    doc: np.ndarray  # row in the block
    start: np.ndarray  # byte offsets
    end: np.ndarray


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time through the finaliser; words over ``LONG`` bytes by xxh3."""
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(seed))
    eights = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)), (len(data) + 1, 8), (1, 1))
    live, done = np.flatnonzero(length <= LONG), 0
    while len(live):
        left = length[live] - done
        piece = eights[start[live] + done].view("<u8").ravel() & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ piece) * np.uint64(WORD_BASES[1]) + np.uint64(seed))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, base: int = WORD_BASES[0]) -> Words:
    """The words of a block; a word never crosses a row.  Words hashed under two bases have 128 bits together."""
    n = len(data)
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(word & ~after) + 1
    h = _hash_words(data, start, end, base)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(h, doc, start, end)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)))
    return out[:n]


class Sequences:
    """Hashes of word sequences in constant time each, from prefix sums.

    Sums modulo 2**64 serve short grams.  Spans of any length add a sum modulo
    a prime: long sequences of two alternating words can cancel under every odd
    base modulo a power of two.
    """

    def __init__(self, h: np.ndarray, base: int = SEQUENCE_BASES[0]):
        n = len(h)
        self.h, self.base = h, base % _PRIME
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(base, n + 1)[:n], out=self.prefix[1:])

    @functools.cached_property
    def _by_prime(self) -> tuple[np.ndarray, np.ndarray]:
        n, p = len(self.h), np.uint64(_PRIME)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h % p * _prime_powers(self.base, n) % p, out=prefix[1:])
        return prefix, _prime_powers(pow(self.base, -1, _PRIME), n + 1)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a..b-1."""
        prefix, inverse = self._by_prime
        second = (prefix[b] - prefix[a]) % np.uint64(_PRIME) * inverse[a] % np.uint64(_PRIME)
        return mix((self.prefix[b] - self.prefix[a]) * self.inverse[a] + mix((second << np.uint64(32)) + (b - a).astype(np.uint64)))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
