"""Sets of word shingles as sorted 64-bit numbers, computed over whole chunks of documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed together.
_SLICE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_slice(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a slice that ends at a word's end."""
    space = _SPACE[part]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, end = edge[::2], edge[1::2]
    bits = max(int(len(part)).bit_length(), _SLICE.bit_length())
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(part)])]
        own = (total[end] - total[start]) * _powers(_INVERSE, bits)[start]
        return start, mixed(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word ``[^\\x20\\x09-\\x0D]+`` of a lower-cased text."""
    whole = np.frombuffer(blob, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(whole):
        stop = min(at + _SLICE, len(whole))
        while stop < len(whole):
            gap = np.flatnonzero(_SPACE[whole[stop : stop + _SLICE]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + _SLICE, len(whole))
        start, own = _hash_slice(whole[at:stop])
        starts.append(start + at)
        hashes.append(own)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of so many words, ascending. Only A-Z are lower-cased. A text of
    fewer words has one shingle, all of it; a text without words has none."""
    raw = [t.encode() for t in texts]
    starts, own = word_hashes(b" ".join(raw).lower())
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        full = max(0, len(own) - words + 1)
        sums = np.zeros(full, np.uint64)
        for j in range(words):
            sums += own[j : j + full] * np.uint64(_BASE ^ (0x5851F42D4C957F2D * (j + 1) & 0xFFFFFFFFFFFFFFF) | 1)
        sums = mixed(sums)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(sums[a : b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in own[a:b]:
                    short = mixed(np.array([short * np.uint64(_BASE) + h]))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
