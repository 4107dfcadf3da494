"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(1 << bits, factor, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, out=steps))
    return out[0], out[1]


def word_hashes(parts: list[bytes], word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where the words of each text begin (one entry more).

    A word is a run of bytes marked in ``word_byte``; a space must not be marked.  Its hash is a polynomial of its bytes, taken as a
    difference of running sums, so the work is a few passes over all bytes and none over single words.
    """
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    inside = word_byte[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers(max(20, int(len(data)).bit_length()))
    sums = (data + np.uint64(1)) * power[: len(data)]
    np.cumsum(sums, out=sums)
    hashes = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes + 1))])
