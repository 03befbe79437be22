"""Sets of hashed word shingles, computed by numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = np.array([0xD6E8FEB86659FD93 ^ (k * 0xA0761D6478BD642F & (1 << 64) - 1) | 1 for k in range(WIDTH)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the words of UTF-8 bytes with A-Z in lower case."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    if len(data) <= _BLOCK:
        up, down = _UP[: len(data)], _DOWN
    else:
        up, down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For every text its sorted distinct shingle hashes; a text of fewer words than WIDTH is one shingle, none is no set."""
    block, size = [], 0
    for text in texts:
        data = (text or "").encode().lower()
        block.append(data)
        size += len(data) + 1
        if size >= _BLOCK // 2:
            yield from _block_sets(block)
            block, size = [], 0
    if block:
        yield from _block_sets(block)


def _block_sets(block: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    borders = np.cumsum([0] + [len(b) + 1 for b in block])
    words, starts = _word_hashes(data)
    first = np.searchsorted(starts, borders)
    if len(words) >= WIDTH:
        rows = len(words) - WIDTH + 1
        full = words[:rows] * _FACTORS[0]
        for k in range(1, WIDTH):
            full = full + words[k : k + rows] * _FACTORS[k]
        full = mixed(full)
    for k in range(len(block)):
        a, b = first[k], first[k + 1]
        if b - a >= WIDTH:
            yield np.unique(full[a : b - WIDTH + 1])
        elif b > a:
            yield mixed((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    total = mixed(mixed(values) + np.uint64(len(values))).sum(dtype=np.uint64)
    return int(mixed(np.array([total ^ np.bitwise_xor.reduce(values, initial=np.uint64(0))]))[0].view(np.int64))
