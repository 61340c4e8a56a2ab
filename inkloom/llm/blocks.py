"""Arrow text columns as flat UTF-8 bytes, cut into blocks of bounded size, and words found in them.

Python tasks of this package never build one string per word: a batch's text
buffer is read as a numpy array, in blocks of about ``BLOCK_BYTES`` (a longer
document is a block of its own), so memory follows the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words after lower-casing A-Z: digits, a-z and everything outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: spreads every input bit over the whole word."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed pseudo-random 64-bit value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, size: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``size``."""
    return _powers(base, max(BLOCK_BYTES, 1 << (size - 1).bit_length()))[:size]


@dataclass
class Block:
    """Rows ``first``.. of a batch: ``data[bounds[i]:bounds[i + 1]]`` is row ``first + i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts in order; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(first, flat[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


@dataclass
class Words:
    """Words of a block: byte ranges, the row each lies in, and a 64-bit digest of its bytes."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    digests: np.ndarray


def words(block: Block, member: np.ndarray = _WORD) -> Words:
    """Maximal runs of word bytes (those marked in ``member``) inside each row, lower-cased for A-Z."""
    low = _LOWER[block.data]
    size = len(low)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = member[low]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < size)]  # a row's edge ends a word as well
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * powers(_MULTIPLIER, size + 1)[:size], out=sums[1:])
    digests = mix((sums[end] - sums[start]) * powers(_INVERSE, size + 1)[start] + (end - start).astype(np.uint64))
    return Words(start, end, block.row_of(start), digests)


def word_starts_per_row(found: Words, rows: int) -> np.ndarray:
    """Index of the first word of every row, and the total at the end."""
    return np.searchsorted(found.rows, np.arange(rows + 1))


class KeyIndex:
    """Position of integer keys in a fixed set, by open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]  # of several for one slot the last stays
            left = self.slots[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_MULTIPLIER)) >> self.shift

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where the set lacks it."""
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1, np.int32)
        slot = self._slot(wanted)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        while len(open_):
            slot_open = (slot[open_] + np.uint64(1)) & self.mask
            slot[open_] = slot_open
            found[open_] = self.slots[slot_open]
            again = found[open_]
            open_ = open_[(again >= 0) & (self.keys[again] != wanted[open_])]
        return found


def task_count(spark: SparkSession) -> int:
    """Partitions for work that costs more than its shuffle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
