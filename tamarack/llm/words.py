"""64-bit hashes of all words of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Every word is summed up
from numbers drawn for its bytes and weighed by place, then mixed with its length;
two different words of a corpus share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _FACTOR)]), dtype=np.uint64)


_table = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, kept for the next call."""
    if len(_table[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        _table[0] = _powers(size)
        _table[1] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
    return _table[0], _table[1]


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the words, the first word of each text and one past the last text's,
    the byte places where words start and end, and the bytes: all texts in UTF-8, A-Z
    lower-cased, a blank before each.
    """
    raw = b" " + b" ".join([t.encode("utf-8", "surrogatepass") for t in texts]).lower() + b" "
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    # Places in the text where each begins: the blank before it.
    sizes = [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends, raw
    powers, inverse = _power_table(len(data))
    total = _BYTES[data]
    total *= powers[: len(data)]
    np.cumsum(total, out=total)
    sums = (total[ends - 1] - total[starts - 1]) * inverse[starts]
    return mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), first, starts, ends, raw


def runs_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` neighbouring words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k, power in enumerate(_powers(n)):
        total += words[k : len(words) - n + 1 + k] * power
    return mix(total ^ np.uint64(n))
