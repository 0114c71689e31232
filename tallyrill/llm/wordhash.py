"""Vectorised word splitting and hashing of UTF-8 texts with numpy.

A batch of texts becomes one byte buffer; word borders, ASCII lower-casing and a
64-bit multilinear hash of every word are whole-array operations, so no Python
code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but white space [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False

#: Word bytes: ASCII letters and digits and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        start = np.uint64((salt * 0x9E3779B97F4A7C15) & MASK)
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) | np.uint64(1)


class Words:
    """The words of a batch of texts; document d owns words first[d]:first[d + 1]."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(buffer, dtype=np.uint8)
        self.low = LOWER[raw]
        inside = word_bytes[raw]
        flips = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, self.ends = flips[::2], flips[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        with np.errstate(over="ignore"):
            factor = seeds(int(lengths.max()), 1)
            parts = (self.low[inside].astype(np.uint64) + np.uint64(1)) * factor[place]
            return mix(np.add.reduceat(parts, begin) + lengths.astype(np.uint64))

    def prefix_hashes(self, width: int) -> np.ndarray:
        """Hash of the first ``width`` bytes of every word; shorter words hash whole."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            factor = seeds(width, 2)
            total = np.zeros(len(self.starts), dtype=np.uint64)
            for k in range(width):
                at = np.minimum(self.starts + k, len(self.low) - 1)
                total += np.where(self.starts + k < self.ends, (self.low[at].astype(np.uint64) + np.uint64(1)) * factor[k], np.uint64(0))
            return mix(total + np.uint64(width))

    def text(self, at: int, n: int) -> bytes:
        """Words at:at+n, lower-cased and joined by single blanks."""
        low = self.low.data
        return b" ".join(bytes(low[self.starts[i] : self.ends[i]]) for i in range(at, at + n))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive words (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        factor = seeds(width, 3)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : k + n] * factor[k]
        return mix(total + np.uint64(width))


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Per document its sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    every = window_hashes(words.hashes, width)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield window_hashes(words.hashes[a:b], int(b - a))
        else:
            yield every[:0]


def chunks(texts: Iterable[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8) in pieces of about ``limit`` bytes; null counts as empty."""
    first, at, held, size = 0, 0, [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        held.append(raw)
        size += len(raw) + 1
        at += 1
        if size >= limit:
            yield first, held
            first, held, size = at, [], 0
    if held:
        yield first, held
