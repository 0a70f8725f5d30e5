"""Run-length grammar of a sequence by recompression, and longest common extensions on it.

Levels alternate between two steps. A block step replaces each maximal block of one symbol by a new symbol; a
pair step splits the symbols into left and right ones and replaces each neighbouring pair of a left and a
right one. Whether a symbol starts inside a new one is decided by it and its neighbour alone, so equal
stretches are cut equally, up to one symbol at each end. Symbols are named by 64-bit hashes of what they
stand for, so equal symbols of different places get one name without a table.

Fences (unique symbols) take part in no step: the sequence between two fences becomes one symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from topicloom.llm.common import mixed

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Level:
    """Symbols of a level and the stretch of the level below that each stands for."""

    symbols: np.ndarray
    above: np.ndarray | None = None  # index of the symbol of the next level that holds a symbol
    first: np.ndarray | None = None
    last: np.ndarray | None = None
    block: bool = False  # made by a block step


def _merged(level: Level, starts: np.ndarray, block: bool, salt: int) -> Level:
    symbols = level.symbols
    first = np.flatnonzero(starts).astype(np.int32)
    last = np.append(first[1:] - 1, len(symbols) - 1).astype(np.int32)
    level.above = (np.cumsum(starts) - 1).astype(np.int32)
    named = symbols[first].copy()
    more = np.flatnonzero(last > first)
    with np.errstate(over="ignore"):
        tail = (last - first)[more].astype(np.uint64) if block else symbols[last[more]]
        named[more] = mixed(named[more] * _A + mixed(tail + np.uint64(salt)) * _B)
    return Level(named, first=first, last=last, block=block)


def grammar(symbols: np.ndarray, fence: np.ndarray, seed: int = 0) -> list[Level]:
    """Levels from the sequence itself up to one symbol between every two fences."""
    levels, inner, salt = [Level(symbols)], ~fence, seed << 20
    while (inner[1:] & inner[:-1]).any():
        level, salt = levels[-1], salt + 2
        now = level.symbols
        starts = np.append(True, (now[1:] != now[:-1]) | ~inner[1:])
        if starts.all():
            side = inner & ((mixed(now ^ np.uint64(salt)) >> np.uint64(40)) & np.uint64(1)).astype(bool)
            # A left symbol takes the right symbol behind it.
            starts = np.append(True, ~(side[:-1] & ~side[1:] & inner[1:]))
            if starts.all():
                continue  # another salt splits the symbols differently
            levels.append(_merged(level, starts, False, salt))
        else:
            levels.append(_merged(level, starts, True, salt + 1))
        inner = inner[levels[-1].first]
    return levels


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols match from ``a`` and ``b`` on (``a`` < ``b``), going right or left.

    On the way up a query stops at the first level where its two symbols differ; where one of its places is
    inside a symbol of the next level, it first steps over what is left of that symbol. On the way down it
    steps over the common part of the two differing symbols, which is one symbol or the shorter block.
    """
    turn = 1 if forward else -1
    a, b = a.astype(np.int64), b.astype(np.int64)
    origin, stop = a.copy(), np.zeros(len(a), np.int32)
    active = np.arange(len(a))
    for height, (level, upper) in enumerate(zip(levels, levels[1:])):
        active = active[level.symbols[a[active]] == level.symbols[b[active]]]
        if not len(active):
            break
        p, q = a[active], b[active]
        near, far = (upper.first, upper.last) if forward else (upper.last, upper.first)
        up_p, up_q = level.above[p], level.above[q]
        inside = np.flatnonzero((near[up_p] != p) | (near[up_q] != q))
        left_p = (far[up_p[inside]] - p[inside]) * turn + 1
        left_q = (far[up_q[inside]] - q[inside]) * turn + 1
        if upper.block:
            step, uneven = np.minimum(left_p, left_q), left_p != left_q
        else:
            step, uneven = np.ones(len(inside), np.int64), np.zeros(len(inside), bool)
        p[inside] += step * turn
        q[inside] += step * turn
        a[active], b[active] = p, q
        going = np.ones(len(active), bool)
        going[inside[uneven]] = False  # one block has ended, so the next symbols differ
        active = active[going]
        a[active], b[active] = level.above[a[active]], level.above[b[active]]
        stop[active] = height + 1
    for height in range(len(levels) - 1, 0, -1):
        upper, level = levels[height], levels[height - 1]
        down = np.flatnonzero(stop >= height)
        up_p, up_q = a[down], b[down]
        near = upper.first if forward else upper.last
        p, q = near[up_p].astype(np.int64), near[up_q].astype(np.int64)
        same = level.symbols[p] == level.symbols[q]
        step = 1
        if upper.block:
            size = upper.last - upper.first + 1
            step = np.minimum(size[up_p], size[up_q])
        a[down], b[down] = p + same * step * turn, q + same * step * turn
    return (a - origin) * turn
