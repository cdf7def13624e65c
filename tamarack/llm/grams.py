"""Hashed character n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Code points that are hashed together: the arrays stay within a few tens of megabytes.
RUN_CHARS = 1 << 18


def runs(texts: Sequence[str], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` code points in all; a longer text is a run of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if len(texts):
        yield start, len(texts)


def joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two zeros, and the number of the text at each place.

    A zero that belongs to a text stands for itself, like any other character.
    """
    codes = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    return codes, owner


def gram_buckets(codes: np.ndarray, owner: np.ndarray, sizes: Sequence[int], bits: int) -> Iterator[
    tuple[np.ndarray, np.ndarray]
]:
    """For each size the texts and the buckets of all n-grams, repeated as often as they occur."""
    hashed = codes.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            hashed = hashed[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in sizes and len(hashed):
            mixed = (hashed ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            buckets = (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
            whole = owner[: len(hashed)] == owner[n - 1 :]
            yield owner[: len(hashed)][whole], buckets[whole]
