"""Words of many texts at once, as arrays: places, documents and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

CHUNK_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    steps = np.arange(seed + 1, seed + n + 1, dtype=np.uint64)
    return mix64(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words(NamedTuple):
    raw: np.ndarray      # bytes of all texts, each followed by a line end
    low: np.ndarray      # the same with A-Z in lower case
    at: np.ndarray       # first byte of each text, and the end
    start: np.ndarray    # of each word
    end: np.ndarray
    doc: np.ndarray      # text of each word
    code: np.ndarray     # hash of each word in lower case


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of about ``limit`` bytes; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield slice(first, len(texts))


def words_of(texts: list[bytes]) -> Words:
    joined = b"\n".join(texts) + b"\n"
    raw, low = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    ink = ~_WS[low]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ink, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    first = np.cumsum(size) - size
    code = np.zeros(0, np.uint64)
    if len(start):
        keys = stream(int(size.max()), 0)
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        code = mix64(np.add.reduceat((low[ink].astype(np.uint64) + np.uint64(1)) * keys[place], first))
    return Words(raw, low, at, start, end, np.searchsorted(at, start, "right") - 1, code)


def per_text(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each text."""
    n = np.bincount(w.doc, minlength=len(w.at) - 1)
    return np.cumsum(n) - n, n
