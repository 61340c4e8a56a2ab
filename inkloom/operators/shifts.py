"""An order-statistic list of runs: where every item of a long list ends up after many single moves.

A list of n items starts as one run.  A move cuts the runs around one item and puts the item
elsewhere, so after m moves there are at most 3 m + 1 runs, however long the list is.  Runs
are kept in chunks of bounded length with the number of items in each, so a move costs a
look at one chunk and at the chunk sizes.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

#: Runs of one chunk.
CHUNK = 512


class _Chunk:
    __slots__ = ("first", "size")

    def __init__(self, first: list[int], size: list[int]):
        self.first, self.size = first, size


class RunList:
    """Items 1..n by their places at the start; ``runs`` lists them as they stand now."""

    def __init__(self, n: int):
        whole = _Chunk([1], [n])
        self.chunks, self.items = [whole], [n]
        self.starts, self.chunk_of = [1], {1: whole}

    def _cut(self, chunk: _Chunk, at: int, before: int) -> None:
        """Cut run ``at`` after its first ``before`` items."""
        first, size = chunk.first[at], chunk.size[at]
        if 0 < before < size:
            chunk.first.insert(at + 1, first + before)
            chunk.size[at : at + 1] = [before, size - before]
            insort(self.starts, first + before)
            self.chunk_of[first + before] = chunk

    def move(self, item: int, offset: int | None, position: int | None, n: int) -> None:
        """Move an item by an offset clamped to the ends, or to a position; one outside 1..n changes nothing."""
        start = self.starts[bisect_right(self.starts, item) - 1]
        chunk = self.chunk_of[start]
        at = chunk.first.index(start)
        self._cut(chunk, at, item - start)
        at += item > start
        self._cut(chunk, at, 1)
        place = self.chunks.index(chunk)
        source = sum(self.items[:place]) + sum(chunk.size[:at]) + 1
        target = min(max(source + (offset or 0), 1), n) if position is None else position
        if target == source or not 1 <= target <= n:
            return
        del chunk.first[at], chunk.size[at]
        self.items[place] -= 1
        self._insert(item, target - 1)

    def _insert(self, item: int, before: int) -> None:
        """Put an item behind the first ``before`` ones."""
        place = 0
        while before > self.items[place]:
            before -= self.items[place]
            place += 1
        chunk, at = self.chunks[place], 0
        while at < len(chunk.size) and before >= chunk.size[at]:
            before -= chunk.size[at]
            at += 1
        if before:
            self._cut(chunk, at, before)
            at += 1
        chunk.first.insert(at, item)
        chunk.size.insert(at, 1)
        self.chunk_of[item] = chunk
        self.items[place] += 1
        if len(chunk.first) > 2 * CHUNK:
            rest = _Chunk(chunk.first[CHUNK:], chunk.size[CHUNK:])
            del chunk.first[CHUNK:], chunk.size[CHUNK:]
            self.chunks.insert(place + 1, rest)
            moved = sum(rest.size)
            self.items[place : place + 1] = [self.items[place] - moved, moved]
            self.chunk_of.update(dict.fromkeys(rest.first, rest))

    def runs(self) -> Iterator[tuple[int, int]]:
        """(first item, place of that item now) of every run that stands in one piece; runs side by side are joined."""
        at, following = 1, None
        for chunk in self.chunks:
            for first, size in zip(chunk.first, chunk.size):
                if first != following:
                    yield first, at
                at, following = at + size, first + size
