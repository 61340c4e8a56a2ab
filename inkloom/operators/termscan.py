"""Many terms looked up in every text at once, by hashes of all windows of the terms' lengths.

The terms travel to the texts as sorted arrays, so no text is shuffled.  A place of a text
is a candidate only while its first characters begin some term of its project: prefixes of
the lengths in ``LADDER`` are tested first, longer ones only where shorter ones hit.  What
the hashes find is compared letter by letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lengths of the prefixes that a place must share with a term of its project to stay a candidate.
LADDER = (2, 4, 8, 16)
#: Characters scanned at once, at some 100 bytes each; a longer text is a block of its own.
BLOCK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Windows:
    """Hashes of the windows of texts laid end to end."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        room = 1 << max(4, int(len(self.points) + 1).bit_length())
        self.sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(_mix(self.points.astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), room)[: len(self.points)], out=self.sums[1:])
        self.back = _powers(int(_INVERSE), room)

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * self.back[at] + np.asarray(length).astype(np.uint64))


def _tags(column: pa.Array) -> np.ndarray:
    """A 64-bit value per row that tells its project."""
    coded = pc.dictionary_encode(column.cast(pa.string()))
    values = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in coded.dictionary.to_pylist()]
    return np.array(values, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


class _Keys:
    """A sorted set of hashes behind a table of marks that turns most other hashes away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(12, int(16 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[keys >> self.shift] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``wanted`` are in the set, and the place of the first equal key of each."""
        maybe = np.flatnonzero(self.marks[wanted >> self.shift])
        if not len(self.keys):
            return maybe, maybe
        place = np.searchsorted(self.keys, wanted[maybe])
        sure = self.keys[np.minimum(place, len(self.keys) - 1)] == wanted[maybe]
        return maybe[sure], place[sure]


class Terms:
    """Terms of all projects, from a table with project_id and folded_term."""

    def __init__(self, table: pa.Table):
        self.texts = table.column("folded_term").to_pylist()
        windows = _Windows(self.texts)
        sizes = np.diff(windows.bounds)
        tags = _tags(table.column("project_id").combine_chunks())
        keys = _mix(windows.hashes(windows.bounds[:-1], sizes) ^ tags)
        self.order = np.argsort(keys, kind="stable")
        self.keys = _Keys(keys[self.order])
        self.lengths = np.unique(sizes[sizes > 0]).tolist()
        self.prefixes = {}
        for n in LADDER:
            long = np.flatnonzero(sizes >= n)
            self.prefixes[n] = _Keys(np.unique(_mix(windows.hashes(windows.bounds[:-1][long], n) ^ tags[long])))

    def find(self, texts: list[str], tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) numbers of every term that occurs in a text of its project, once each."""
        windows = _Windows(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(windows.bounds))
        room = windows.bounds[row + 1] - np.arange(len(row))
        at, hit_rows, hit_terms, waiting = np.arange(len(row)), [], [], list(LADDER)
        for length in self.lengths:
            while waiting and waiting[0] <= length:
                n = waiting.pop(0)
                at = at[room[at] >= n]
                at = at[self.prefixes[n].find(_mix(windows.hashes(at, n) ^ tags[row[at]]))[0]]
            fit = at[room[at] >= length]
            hit, left = self.keys.find(_mix(windows.hashes(fit, length) ^ tags[row[fit]]))
            count = np.searchsorted(self.keys.keys, self.keys.keys[left], "right") - left
            steps = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit_rows.append(np.repeat(row[fit[hit]], count))
            hit_terms.append(self.order[steps])
        if not hit_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(hit_rows) * np.int64(len(self.texts)) + np.concatenate(hit_terms))
        rows, terms = pairs // len(self.texts), pairs % len(self.texts)
        same = np.array([self.texts[t] in texts[r] for r, t in zip(rows.tolist(), terms.tolist())], bool)
        return rows[same], terms[same]


def scan(shared, columns: list[str]):
    """Task of ``mapInArrow`` over rows with project_id and folded: the row's other columns and the term's, per hit."""
    built: list[Terms] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: pa.Table = shared.value
        if not built:
            built.append(Terms(table))
        for batch in batches:
            tags = _tags(batch.column("project_id"))
            folded = batch.column("folded")
            for first, last in _cut(pc.fill_null(pc.utf8_length(folded), 0).to_pylist()):
                # only the texts of a block become strings
                texts = [t or "" for t in folded.slice(first, last - first).to_pylist()]
                rows, terms = built[0].find(texts, tags[first:last])
                own = batch.select(columns).take(pa.array(rows + first))
                told = table.take(pa.array(terms)).combine_chunks()
                more = [c for c in table.column_names if c not in ("project_id", "folded_term")]
                arrays = [*own.columns, *[told.column(c).combine_chunks() for c in more]]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *more])

    return run


def _cut(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > BLOCK:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)
