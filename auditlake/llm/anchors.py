"""Content-chosen anchors that bring equal byte strings together.

Every window of ``width`` bytes has an anchor: of the ``gram``-byte strings in it the one with the least
hash, the leftmost of several. Equal windows have equal anchors wherever they lie. Consecutive windows
with the anchor at the same place make a segment, so a text of n bytes has about 2n / (width - gram)
segments, and every window belongs to exactly one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Windows per step, to bound memory; a longer text is cut here, at any place, into overlapping parts.
BLOCK = 1 << 18
PLACE_BITS = 21
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random weights of the bytes, powers of an odd number modulo 2**64, and their inverses."""
    weights = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
    base = np.uint64(_ODD | 1)
    inverse = np.uint64(pow(int(base), -1, 2**64))

    def powers(of: np.uint64) -> np.ndarray:
        made = np.ones(size, dtype=np.uint64)
        made[1:] = of
        return np.multiply.accumulate(made)

    return weights, powers(base), powers(inverse)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread hash values over 64 bits."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of one block of bytes."""

    def __init__(self, data: np.ndarray):
        weights, powers, self.inverse = _tables(BLOCK + (1 << 12))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(weights[data] * powers[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def all(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:count]) * self.inverse[:count])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _blocks(ends: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole texts, or of parts of a longer one that overlap by ``width - 1``."""
    first = 0
    while first < len(ends) - 1:
        if ends[first + 1] - ends[first] > BLOCK:
            begin, end = int(ends[first]), int(ends[first + 1])
            for at in range(begin, end - width + 1, BLOCK - width):
                yield at, min(at + BLOCK - 1, end)
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, side="right")) - 1)
        yield int(ends[first]), int(ends[last])
        first = last


def segments(
    data: np.ndarray, ends: np.ndarray, width: int, gram: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(start, windows, key, content)`` of all segments of the texts in ``data``, in parts.

    ``start`` is a place in ``data``, ``windows`` how many windows begin from there on, ``key`` the hash
    of the anchor and ``content`` the hash of all bytes of the segment.
    """
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for begin, end in _blocks(ends, width):
        block = data[begin:end]
        if len(block) < width:
            continue
        rolling = Rolling(block)
        keys = rolling.all(gram)
        packed = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
        anchor = (_sliding_min(packed, width - gram + 1) & mask).astype(np.int64)
        starts = np.arange(len(anchor)) + begin
        # A window must not run over the end of its text.
        text_end = ends[np.searchsorted(ends, starts, side="right")]
        valid = starts + width <= text_end
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        number = np.add.reduceat(valid.astype(np.int64), first)
        yield (
            first + begin,
            number,
            keys[anchor[first]].view(np.int64),
            rolling.at(first, first + number + width - 1).view(np.int64),
        )
