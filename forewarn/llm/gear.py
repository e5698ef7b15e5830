"""A gear rolling hash, at every byte of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A random-looking number for each byte, from a rule.
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint64)


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """At each byte a 32-bit hash of the ``window`` (a power of two) bytes that end there, fewer at the start.

    The gear sum (shift by one, add the byte's number) over a window is the sum of two half windows, the older
    one shifted, so it is built by doubling.
    """
    h = GEAR[data]
    span = 1
    while span < window:
        moved = h[:-span] << np.uint64(span)
        h = h.copy()
        h[span:] += moved
        span *= 2
    h *= _MIX
    return h >> np.uint64(32)
