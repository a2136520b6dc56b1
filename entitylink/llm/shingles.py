"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are the longest runs of characters other than the ASCII white space \\x20 and \\x09-\\x0D,
with A-Z lower-cased.
"""

from __future__ import annotations

import functools

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN) | np.uint64(1)


@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, which bytes are white space, and powers of the base and of its inverse."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    inverse = pow(_BASE, -1, 1 << 64)
    powers = []
    for factor in (_BASE, inverse):
        steps = np.full(size + 1, factor, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return constants(256, 1), space, *powers


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in a row, and how many each text has."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    data = np.frombuffer(b" ".join([t or b"" for t in texts]).lower() + b" ", np.uint8)
    size = 1 << max(20, len(data).bit_length())
    values, space, powers, inverse = _tables(size)
    white = space[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], white))))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * powers[: len(data)], dtype=np.uint64)))
    hashed = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
    each = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes + 1)))))
    return hashed, each


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text (sorted, in a row), and how many there are.  A text with
    fewer words than `width` has all of them as one shingle; a text without words has none."""
    hashed, each = words(texts)
    steps = constants(width, 2)
    whole = len(hashed) - width + 1
    rolled = np.zeros(max(0, whole), np.uint64)
    for k in range(width):
        rolled += hashed[k : k + max(0, whole)] * steps[k]
    rolled = mix(rolled)
    ends = np.cumsum(each)
    sets = []
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(mix((hashed[a:b] * steps[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.array([len(s) for s in sets], np.int64)


def plain_set(text: bytes | None, width: int) -> frozenset:
    """The shingles themselves, to confirm on."""
    own = (text or b"").lower().split()
    if len(own) < width:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[k:] for k in range(width)), strict=False))
