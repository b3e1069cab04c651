"""Burrows-Wheeler transforms of shards of strings, merged by interleave refinement.

Strings are arrays of symbols (integers from 0).  Every shard sorts the
suffixes of its own strings once.  Merging never compares suffixes: it keeps
one number for each place of the merged order, the shard that the suffix there
comes from.  At first all of shard 0 stands before all of shard 1, and so on.
A round writes each shard's preceding symbols into its places and sorts the
places, stably, by that symbol; what was in order by h symbols then is in
order by h + 1.  Places whose symbols or former blocks differ start a new
block, and the round in which a boundary shows up is the common prefix there.
After ``depth`` rounds a block holds the suffixes that share ``depth`` symbols.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Shard(NamedTuple):
    order: np.ndarray     # places of the shard's symbols in suffix order
    before: np.ndarray    # symbol before each suffix: the transform


def transform(symbols: np.ndarray, depth: int) -> Shard:
    """Suffix order by ``depth`` symbols, by prefix doubling; strings end in symbols that occur once."""
    n = len(symbols)
    rank, have = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        later = np.zeros(n, np.int64)
        later[:n - have] = rank[have:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        have *= 2
    return Shard(order, np.roll(symbols, 1)[order])


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each merged place, common prefix with the place before, start of blocks of ``depth`` symbols)."""
    sizes = [len(s.order) for s in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    before = np.concatenate([s.before for s in shards])
    n = len(source)
    block = np.zeros(n, np.int64)
    common = np.full(n, depth, np.int64)
    edge = np.zeros(n, bool)
    edge[:1] = True
    for done in range(depth):
        symbol = np.empty(n, before.dtype)
        symbol[np.argsort(source, kind="stable")] = before      # each shard's symbols in its places
        move = np.argsort(symbol, kind="stable")
        source, symbol, block = source[move], symbol[move], block[move]
        edge[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[edge & (common == depth)] = done
        block = np.cumsum(edge)
    return source, common, edge


def merged_order(shards: list[Shard], source: np.ndarray, starts: list[int]) -> np.ndarray:
    """Places of all symbols in merged order; ``starts`` is where each shard's symbols begin."""
    out = np.empty(len(source), np.int64)
    out[np.argsort(source, kind="stable")] = np.concatenate(
        [s.order + first for s, first in zip(shards, starts, strict=True)])
    return out


def repeated_blocks(strings: list[np.ndarray], depth: int, shard_symbols: int) -> tuple[np.ndarray, ...]:
    """(block, string, place in it) of every suffix that shares its first ``depth`` symbols with another.

    Symbols are re-coded densely; each string ends in a symbol of its own, so
    no common prefix passes an end.
    """
    size = np.array([len(s) for s in strings])
    _, dense = np.unique(np.concatenate(strings), return_inverse=True)
    n_strings = len(strings)
    first = np.cumsum(size + 1) - (size + 1)
    symbols = np.empty(int(size.sum()) + n_strings, np.int64)
    end = np.zeros(len(symbols), bool)
    end[first + size] = True
    symbols[end], symbols[~end] = np.arange(n_strings), dense + n_strings

    cut = np.searchsorted(first, np.arange(shard_symbols, len(symbols), shard_symbols))
    starts = sorted({0, *first[cut[cut < n_strings]].tolist()})
    shards = [transform(symbols[s:e], depth) for s, e in zip(starts, [*starts[1:], len(symbols)], strict=True)]
    source, _, edge = merge(shards, depth)
    order = merged_order(shards, source, starts)
    at = np.flatnonzero(edge)
    length = np.diff(np.append(at, len(edge)))
    several = np.repeat(length > 1, length)
    block = np.repeat(np.arange(len(at)), length)[several]
    place = order[several]
    string = np.searchsorted(first, place, "right") - 1
    return block, string, place - first[string]
