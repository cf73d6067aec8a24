"""Words of many texts at once: byte scans, rolling hashes and shingles in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A-Z to a-z on UTF-8 bytes; all others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that part words: space and 09-0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: All ASCII bytes but letters: what parts runs of letters.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[[*range(65, 91), *range(97, 123)]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
#: Bytes that one numpy pass looks at; what passes keep of longer texts are their words, not temporaries of their length.
BLOCK = 1 << 18


def _steps(base: int, count: int) -> np.ndarray:
    """base^i modulo 2^64 for i < count."""
    out = np.full(count, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASES = (0x9E3779B97F4A7C15, int(_INVERSE))
_UP, _DOWN = (_steps(b, BLOCK) for b in _BASES)


def _block_steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse at the first byte of each block of n bytes."""
    return tuple(_steps(pow(b, BLOCK, 1 << 64), n // BLOCK + 1) for b in _BASES)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64; those of one block are kept between calls, no more."""
    if n < BLOCK:
        return _UP, _DOWN
    return tuple((far[:, None] * near[None, :]).ravel() for far, near in zip(_block_steps(n), (_UP, _DOWN), strict=True))


@dataclass
class Words:
    """Words of a slice of texts, in order. ends are exclusive; doc is the text's number; first[d]:first[d+1] are its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def between(self, a: int, b: int) -> Words:
        """The words a..b as those of one text."""
        low, high = self.starts[a], self.ends[b - 1]
        return Words(self.data[low:high], self.starts[a:b] - low, self.ends[a:b] - low, np.zeros(b - a, np.int64), np.array([0, b - a]), np.array([0, high - low]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; prefix sums run on from block to block, so words may cross their borders."""
        n, carry = len(self.data), np.uint64(0)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        far_up, far_down = _block_steps(n)
        at_start, at_end = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts), np.uint64)
        for k, a in enumerate(range(0, n, BLOCK)):
            b = min(n, a + BLOCK)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[self.data[a:b]] * _UP[: b - a], out=sums[1:])
            sums = sums * far_up[k] + carry
            i, j = np.searchsorted(self.starts, (a, b))
            at_start[i:j] = sums[self.starts[i:j] - a]
            i, j = np.searchsorted(self.ends, (a + 1, b + 1))
            at_end[i:j] = sums[self.ends[i:j] - a]
            carry = sums[-1]
        raw = (at_end - at_start) * (far_down[self.starts // BLOCK] * _DOWN[self.starts % BLOCK])
        return mix(raw ^ (self.ends - self.starts).astype(np.uint64))


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool = True, parts: np.ndarray = SPACE) -> Words:
    """The words of the texts whose bytes are data[offsets[i]:offsets[i+1]]: runs without the bytes that parts marks. A-Z lower-cased if asked for."""
    data = LOWER[data] if lower else data
    n, docs, starts, ends = len(data), len(offsets) - 1, [], []
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        # One byte more on either side tells whether a run goes on there.
        low, high = max(0, a - 1), min(n, b + 1)
        word = np.zeros(b - a + 2, bool)
        word[low - a + 1 : high - a + 1] = ~parts[data[low:high]]
        edge = np.zeros(b - a + 1, bool)
        i, j = np.searchsorted(offsets, (a, b + 1))
        edge[offsets[i:j] - a] = True
        starts.append(np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + (a + 1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    starts, ends = join(starts), join(ends)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    return Words(data, starts, ends, np.repeat(np.arange(docs), np.diff(first)), first, offsets)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hashes of each text's k-word shingles, repeats included; fewer than k words make one, none make none."""
    h, counts = words.hashes(), np.diff(words.first)
    docs = len(counts)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    out = np.zeros(len(h), np.uint64)
    for j in range(k):
        out[: len(h) - j] = out[: len(h) - j] * _BASE + h[j:]
    out = mix(out, k)
    kept = np.zeros(len(h), bool)
    if len(h) >= k:
        kept[: len(h) - k + 1] = words.doc[: len(h) - k + 1] == words.doc[k - 1 :]
    for n in range(1, k):
        at = words.first[:-1][counts == n]
        value = np.full(len(at), n, np.uint64)
        for j in range(n):
            value = mix(value ^ h[at + j], 64)
        out[at], kept[at] = value, True
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return out[kept], np.concatenate([[0], np.cumsum(made)])
