"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  The
automaton is built over the items' words; training text is streamed through it and
the longest match ending at every word tells which windows (``window`` consecutive
item words, or a whole shorter item) occur.  Words inside any occurrence are hit.

Words are compared by 64-bit digests.  Only runs of benchmark words long enough for
some window enter the automaton, so most of a text costs its tokenisation alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import KeyIndex, Words, text_blocks, word_starts_per_row, words
from inkloom.session import checkpointed

WINDOW = 13
#: A document is contaminated when hit words are at least this share: 1 / COVERAGE.
COVERAGE = 20
#: Bytes of item text that one automaton holds; larger benchmarks are matched in blocks.
ITEM_BLOCK_BYTES = 4 << 20


class SuffixAutomaton:
    """Smallest automaton of all substrings of the added sequences (each is added from the start state)."""

    def __init__(self, window: int):
        self.window = window
        self.moves: list[dict[int, int]] = [{}]
        self.length = [0]
        self.link = [-1]
        self.items: dict[int, set[tuple[int, int]]] = {}

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _extend(self, last: int, word: int) -> int:
        there = self.moves[last].get(word)
        if there is not None:  # another item has this prefix
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        if p >= 0:
            there = self.moves[p][word]
            self.link[new] = there if self.length[there] == self.length[p] + 1 else self._split(p, there, word)
        return new

    def _split(self, p: int, there: int, word: int) -> int:
        """A state of its own for the strings of ``there`` no longer than ``p`` plus one word."""
        short = self._state(self.length[p] + 1, dict(self.moves[there]), self.link[there])
        self.link[there] = short
        while p >= 0 and self.moves[p].get(word) == there:
            self.moves[p][word] = short
            p = self.link[p]
        return short

    def add(self, sequence: list[int]) -> None:
        state = 0
        for word in sequence:
            state = self._extend(state, word)

    def mark(self, item: int, sequence: list[int]) -> None:
        """Remember ``item`` at the states of its windows; call when all sequences are added."""
        need, state = min(self.window, len(sequence)), 0
        for at, word in enumerate(sequence, 1):
            state = self.moves[state][word]
            if at < need:
                continue
            home = self.home(state, need)
            self.items.setdefault(home, set()).add((item, need))

    def home(self, state: int, need: int) -> int:
        """The state on the suffix path that holds the suffix of exactly ``need`` words."""
        while self.length[self.link[state]] >= need:
            state = self.link[state]
        return state

    def finish(self) -> None:
        """For every state the nearest state with items on its suffix path, itself included."""
        self.report = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.report[state] = state if state in self.items else self.report[self.link[state]]

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, words of the window, item) of every window that occurs in ``sequence``."""
        moves, link, length, report = self.moves, self.link, self.length, self.report
        state = matched = 0
        for at, word in enumerate(sequence):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            found = report[state]
            while found > 0:
                for item, need in self.items[found]:
                    if need <= matched:
                        yield at + 1, need, item
                found = report[link[found]] if link[found] > 0 else -1


@dataclass
class Items:
    """What a task needs of one block of benchmark items."""

    vocabulary: np.ndarray
    automaton: SuffixAutomaton
    names: list[str]
    least: int

    def hits(self, found: Words, first_word: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(row, hit word ranges of that row, items) for rows with an occurrence."""
        if not hasattr(self, "lookup"):
            self.lookup = KeyIndex(self.vocabulary)
        ids = self.lookup.find(found.digests)
        known = ids >= 0
        # runs of known words inside one row
        edge = np.ones(len(ids) + 1, bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (found.rows[1:] != found.rows[:-1])
        begin = np.flatnonzero(edge[:-1])
        end = np.append(begin[1:], len(ids)) if len(begin) else begin
        use = known[begin] & (end - begin >= self.least) if len(begin) else np.zeros(0, bool)
        row, spans, items = -1, [], set()
        for b, e in zip(begin[use].tolist(), end[use].tolist()):
            for stop, need, item in self.automaton.matches(ids[b:e].tolist()):
                here = int(found.rows[b])
                if here != row:
                    if row >= 0:
                        yield row, spans, items
                    row, spans, items = here, [], set()
                stop += b - int(first_word[here])
                if spans and stop - need <= spans[-1][1]:
                    # earlier ranges that the window reaches back over are joined to it
                    start = stop - need
                    while len(spans) > 1 and start <= spans[-2][1]:
                        start = min(start, spans.pop(-2)[0])
                    spans[-1] = (min(spans[-1][0], start), max(stop, spans[-1][1]))
                else:
                    spans.append((stop - need, stop))
                items.add(self.names[item])
        if row >= 0:
            yield row, spans, items


def prepare(rows: list[tuple[str, str]], window: int = WINDOW) -> Items | None:
    """The automaton of (item_id, text) rows, or None when no item has a word."""
    block = next(text_blocks(pa.array([t for _, t in rows], pa.string()), 1 << 62), None) if rows else None
    if block is None:
        return None
    found = words(block)
    vocabulary, ids = np.unique(found.digests, return_inverse=True)
    cuts = word_starts_per_row(found, block.rows)
    sequences = [ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    if not len(ids):
        return None
    automaton = SuffixAutomaton(window)
    for sequence in sequences:
        automaton.add(sequence)
    for item, sequence in enumerate(sequences):
        if sequence:
            automaton.mark(item, sequence)
    automaton.finish()
    return Items(vocabulary, automaton, [i for i, _ in rows], min(min(window, len(s)) for s in sequences if s))


HITS = "struct<n_words long, spans array<struct<start:long, end:long>>, items array<string>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _matcher(shared: Broadcast):
    @F.arrow_udf(HITS)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items: Items | None = shared.value
        for column in batches:
            n_words, spans, names = np.zeros(len(column), np.int64), [[]] * len(column), [[]] * len(column)
            for block in text_blocks(column):
                found = words(block)
                cuts = word_starts_per_row(found, block.rows)
                n_words[block.first : block.first + block.rows] = np.diff(cuts)
                for row, where, which in items.hits(found, cuts) if items else ():
                    spans[block.first + row] = [{"start": a, "end": b} for a, b in where]
                    names[block.first + row] = sorted(which)
            yield pa.StructArray.from_arrays(
                [pa.array(n_words), pa.array(spans, pa.list_(SPAN)), pa.array(names, pa.list_(pa.string()))],
                ["n_words", "spans", "items"],
            )

    return matched


def _join_spans(spans):
    """Sorted, disjoint ranges of an array of ranges."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda done, s: F.when((F.size(done) == 0) | (s["start"] > F.coalesce(last(done)["end"], F.lit(-1))), F.concat(done, F.array(s)))
        .otherwise(
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))),
            )
        ),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges), ``hit_items``, ``n_hit`` and ``contaminated``.

    contaminated: ``n_hit > 0 and coverage * n_hit >= n_words``.  Null texts have no
    words.  Items with a null id or without words take no part; items that share an id
    count once.  Input columns with the names of the new ones are replaced.

    The items travel to the tasks in blocks of about ``block_bytes``, chosen by a hash
    of the id, so neither driver nor task holds a benchmark of any size at once; the
    hits of several blocks are joined per document.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-total // block_bytes)) or 1
    new = ["n_words", "hit_spans", "hit_items", "n_hit", "contaminated"]
    kept = [c for c in docs.columns if c not in new]

    def items_of(block: int) -> Broadcast:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        return spark.sparkContext.broadcast(prepare([(r[0], r[1]) for r in part.collect()], window))  # one bounded block

    if blocks == 1:
        found = docs.select(*kept, _matcher(items_of(0))(F.col("text")).alias("_hits"))
        spans, names = F.col("_hits.spans"), F.col("_hits.items")
    else:
        found = docs.select(*kept, F.monotonically_increasing_id().alias("_row"))
        found = checkpointed(found)
        parts = []
        for block in range(blocks):
            hits = found.select("_row", _matcher(items_of(block))(F.col("text")).alias("_hits"))
            parts.append(checkpointed(hits.where((F.size("_hits.items") > 0) | (F.lit(block) == 0))))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        hits = every.groupBy("_row").agg(
            F.struct(
                F.max("_hits.n_words").alias("n_words"),
                _join_spans(F.flatten(F.collect_list("_hits.spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits.items")))).alias("items"),
            ).alias("_hits")
        )
        found = found.join(hits, "_row").drop("_row")
        spans, names = F.col("_hits.spans"), F.col("_hits.items")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        *kept, F.col("_hits.n_words").alias("n_words"), spans.alias("hit_spans"), names.alias("hit_items"), n_hit.alias("n_hit")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))

