"""Cross-document substring dedup on a Burrows-Wheeler transform.

Every byte covered by a ``length``-byte string that also starts in a document with a
smaller doc_id is removed.  Texts are UTF-8 bytes; matches never cross documents.

Distribution.  The least hash of the ``GRAM``-byte grams inside a window (its minimizer)
depends on the window's content alone, so equal windows meet under equal minimizers.
Consecutive windows of one minimizer form a segment.  (1) Minimizers that occur in one
distinct text only are dropped; for that only hashes are shuffled.  (2) The segments of
the others are sent to the task of their minimizer.  (3) A task joins equal segments,
and builds the transform of the distinct ones, in blocks of whole minimizers.

Threshold-bounded interval expansion.  In a block, the interval of the empty string is
extended backwards breadth-first: an interval of a string w of length l gives the
interval of cw for every symbol c before it, by the last-to-first map.  The right end of a new interval
is a place where neighbouring suffixes share exactly l symbols; an interval whose end is
known already is not extended.  Common prefixes thus appear by increasing value, and
the expansion stops at ``length``: suffixes between the places found by then share at least ``length`` symbols.
The ranks by which the suffixes were sorted tell the intervals of strings of ``2 * HEAD`` symbols, where nearly all
suffixes lie in open intervals; the expansion goes on from there.

A minimizer of more than ``HOT_TEXTS`` texts is keyed by whole windows instead: rows of one
window are sorted by id, so the first is the smallest and nothing is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.blocks import Block, mix, text_blocks
from inkloom.llm.chunks import merged_runs
from inkloom.session import checkpointed

LENGTH = 50
GRAM = 20
#: Bytes of texts that are hashed together; the arrays of so many stay near the processor.
HASH_BYTES = 1 << 17
#: Bytes of distinct segments in one transform.
TRANSFORM_BYTES = 1 << 19
#: Texts with one minimizer above which its windows are keyed one by one.
HOT_TEXTS = 50_000
#: Bytes of segments that are sorted together before they are sent.
PIECE_BYTES = 8 << 20
#: The expansion starts at strings of twice so many symbols (a power of two from 4 on).
HEAD = 8
_HOT = 1 << 60


def _stir(x: np.ndarray, spare: np.ndarray) -> None:
    """``mix`` in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        if factor > 1:
            x *= np.uint64(factor)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position (those at the end mean nothing)."""
    padded = np.zeros(len(data) + GRAM, np.uint8)
    padded[: len(data)] = data
    eight = lambda step: np.ndarray(len(data), "<u8", padded, step, (1,))  # noqa: E731  (the eight bytes from every position)
    out, spare = np.array(eight(0)), np.empty(len(data), np.uint64)
    _stir(out, spare)
    for step in (*range(8, GRAM - 8, 8), GRAM - 8):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += eight(step)
        _stir(out, spare)
    out >>= np.uint64(16)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from every position."""
    out, other, span = values.copy(), np.empty_like(values), 1
    while span < width:
        step = min(span, width - span, len(out))
        np.minimum(out[: len(out) - step], out[step:], out=other[: len(out) - step])
        other[len(out) - step :] = out[len(out) - step :]
        out, other, span = other, out, span + step
        if step == len(out):
            break
    return out


def segments(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, minimizer) of every segment of the block."""
    size = len(block.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none
    key = _least(_grams(block.data), length - GRAM + 1).astype(np.int64)
    windows = np.maximum(np.diff(block.bounds) - length + 1, 0)
    usable = np.zeros(size + 1, np.int8)
    full = windows > 0
    usable[block.bounds[:-1][full]] += 1
    usable[block.bounds[:-1][full] + windows[full]] -= 1  # a row's windows end before the next row begins
    valid = np.cumsum(usable[:-1], dtype=np.int8) > 0
    fresh = valid.copy()
    fresh[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(fresh)
    stop = valid.copy()
    stop[:-1] &= fresh[1:] | ~valid[1:]
    return block.row_of(starts), starts, np.flatnonzero(stop) - starts + 1, key[starts]


def _minimizers(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for block in text_blocks(batch.column(1), HASH_BYTES):
                row, _, _, h = segments(block, length)
                if block.rows < 1 << 15:  # a row and its 48-bit hash fit one word
                    both = (row << 48) | h
                    both.sort()
                    row, h = both >> 48, both & ((1 << 48) - 1)
                else:
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[once]), pa.array(keys[block.first + row[once]])], ["h", "key"])

    return run


def _sorted_pieces(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Segments by key: equal ones lie side by side and shrink to little in the shuffle files."""
    keys, sizes, docs, ats, data = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(keys, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    offsets = np.concatenate([[0], np.cumsum(sizes[order])])
    data = data[np.repeat(begin - offsets[:-1], sizes[order]) + np.arange(offsets[-1])]
    binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[order]), binary, pa.array(docs[order]), pa.array(ats[order])], ["h", "seg", "doc_id", "at"]
    )


def _pieces(length: int):
    """Segments of the wanted minimizers: (h, seg, doc_id, at); hot ones window by window under the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted_bounds = batch.column(2).offsets.to_numpy()
            wanted = batch.column(2).values.to_numpy()
            parts: list[tuple[np.ndarray, ...]] = []
            held = 0
            for block in text_blocks(batch.column(1), HASH_BYTES):
                row, start, count, h = segments(block, length)
                bounds = wanted_bounds[block.first : block.first + block.rows + 1]
                flat = wanted[bounds[0] : bounds[-1]]
                of = np.repeat(np.arange(block.rows), np.diff(bounds)).astype(np.uint64)
                salted = mix((flat & (_HOT - 1)).astype(np.uint64) ^ mix(of))
                order = np.argsort(salted)
                salted, flat = salted[order], flat[order]
                asked = mix(h.astype(np.uint64) ^ mix(row.astype(np.uint64)))
                if not len(salted) or not len(asked):
                    continue
                at = np.minimum(np.searchsorted(salted, asked), len(salted) - 1)
                hit = salted[at] == asked
                hot = hit & (flat[at] >= _HOT)
                plain = hit & ~hot
                row_hot = np.repeat(row[hot], count[hot])
                start_hot = np.repeat(start[hot], count[hot]) + _within(count[hot])
                rows = np.concatenate([row[plain], row_hot])
                starts = np.concatenate([start[plain], start_hot])
                sizes = np.concatenate([count[plain] + length - 1, np.full(len(row_hot), length)])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                data = block.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
                window = [int.from_bytes(hashlib.blake2b(block.data[s : s + length], digest_size=7).digest()) for s in start_hot.tolist()]
                keys = np.concatenate([h[plain], np.array(window, np.int64) | _HOT])
                parts.append((keys, sizes, ids[block.first + rows], (starts - block.bounds[rows]).astype(np.int64), data))
                held += len(data)
                if held >= PIECE_BYTES:
                    yield _sorted_pieces(parts)
                    parts, held = [], 0
            if parts:
                yield _sorted_pieces(parts)

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[i] - 1 for every i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _sorted_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in order) of keys of so many bits; a key and its place share one word where they fit."""
    room = max(len(keys) - 1, 1).bit_length()
    if bits + room > 63:
        order = np.argsort(keys)
        return order, keys[order]
    words = keys << room
    words |= np.arange(len(keys))
    words.sort()
    order = words & ((1 << room) - 1)
    words >>= room
    return order, words


def bounded_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes ordered by at least their first ``length`` symbols, by doubling ranks; and their ranks by ``HEAD`` symbols, if passed."""
    size, span = len(symbols), 1
    rank, heads = symbols.astype(np.int64), None
    while span < 4 and span < length:  # four symbols of nine bits leave room for a place
        rank = (rank << 9) | np.append(symbols[span:], np.zeros(min(span, size), np.int64))[:size]
        span += 1
    bits, width = 9 * span, size.bit_length()
    while True:
        order, ordered = _sorted_keys(rank, bits)
        if span >= length:
            return order, heads
        step = np.ones(size, bool)
        step[1:] = ordered[1:] != ordered[:-1]
        dense = np.empty(size, order.dtype)
        dense[order] = np.cumsum(step, dtype=order.dtype)
        if span == HEAD:
            heads = dense
        rank = dense.astype(np.int64)
        rank <<= width
        rank[: max(size - span, 0)] |= dense[span:]
        bits, span = 2 * width, 2 * span


def _first_intervals(order: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, starts, ends) when strings of ``2 * HEAD`` symbols are reached: the sort tells what the expansion finds up to there."""
    size = len(order)
    ahead = np.append(heads, np.zeros(HEAD, heads.dtype))
    differ = lambda step: np.diff(ahead[order + step]) != 0
    near = differ(0)
    edges = np.concatenate([[0], np.flatnonzero(near | differ(HEAD)) + 1])
    shorter = near | differ(HEAD - 1)  # what is an edge among strings of one symbol less was known before
    known = np.zeros(size + 1, bool)
    known[edges] = known[size] = True
    fresh = ~shorter[edges[1:] - 1]
    return known, edges[:-1][fresh], edges[1:][fresh]


def shared_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes of one group share their first ``length`` symbols.

    Breadth-first backward extension over the transform, see the module's text.
    """
    order, heads = bounded_order(symbols, length)
    size = len(order)
    place = np.empty(size, order.dtype)
    place[order] = np.arange(size, dtype=order.dtype)
    owner = np.empty(size, np.int64)
    if heads is None or 2 * HEAD >= length:
        reached = 0
        known = np.zeros(size + 1, bool)  # known[i]: suffixes i - 1 and i share fewer symbols than reached
        known[0] = known[size] = True
        starts, ends = np.array([0]), np.array([size])
    else:
        reached = 2 * HEAD
        known, starts, ends = _first_intervals(order, heads)
    for shared in range(reached, length):
        if not len(starts):
            break
        counts = ends - starts
        members = np.repeat(starts, counts) + _within(counts)
        there = place[order[members] - 1]  # last to first; the first suffix is preceded by the last symbol, a separator
        owner[there] = np.repeat(np.arange(len(starts)), counts)
        there.sort()
        whose, first_symbol = owner[there], symbols[order[there]]
        begin = np.ones(len(there), bool)
        begin[1:] = (there[1:] != there[:-1] + 1) | (whose[1:] != whose[:-1]) | (first_symbol[1:] != first_symbol[:-1])
        at = np.flatnonzero(begin)
        starts = there[at]
        ends = there[np.append(at[1:], len(there)) - 1] + 1
        # an end that no shorter string has shown: its neighbours share ``shared`` symbols
        fresh = ~known[ends] if shared else np.ones(len(ends), bool)
        known[ends] = True
        starts, ends = starts[fresh], ends[fresh]
    return order, np.cumsum(known[:size], dtype=order.dtype) - 1


def _smallest_docs(flat: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest doc per byte position of the joined segments (valid at window starts), and each segment's place."""
    places = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(places[-1], np.int16)
    inside = np.ones(places[-1], bool)
    inside[places[1:] - 1] = False
    symbols[inside] = flat + np.int16(1)  # 0 separates segments
    order, group = shared_prefixes(symbols, length)
    windows = sizes - length + 1
    begins = np.repeat(places[:-1], windows) + _within(windows)
    doc, is_window = np.empty(len(symbols), np.int64), np.zeros(len(symbols), bool)
    doc[begins], is_window[begins] = np.repeat(docs, windows), True
    ordered = is_window[order]
    order, group = order[ordered], group[ordered]
    edge = np.diff(group, prepend=-1) != 0
    least = np.minimum.reduceat(doc[order], np.flatnonzero(edge))
    out = np.empty(len(symbols), np.int64)
    out[order] = least[np.cumsum(edge) - 1]
    return out, places[:-1]


def _runs(doc: np.ndarray, at: np.ndarray, place: np.ndarray, windows: np.ndarray, least: np.ndarray, length: int):
    """(doc, start, stop) of the bytes that windows with a smaller document cover."""
    offset = _within(windows)
    repeated = least[np.repeat(place, windows) + offset] < np.repeat(doc, windows)
    begin, end = repeated.copy(), repeated.copy()
    begin[1:] &= ~repeated[:-1] | (offset[1:] == 0)
    end[:-1] &= ~repeated[1:] | (offset[1:] == 0)
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    of = np.repeat(np.arange(len(doc)), windows)
    return doc[of[begin]], at[of[begin]] + offset[begin], at[of[end]] + offset[end] + length


SPAN = "doc_id long, start long, stop long"


def _span_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop)], ["doc_id", "start", "stop"])


def _removed(length: int, limit: int):
    """Rows (h, seg, doc_id, at) sorted by these: the spans to remove.  Minimizers are held until a block is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        smallest: list[np.ndarray] = []
        variant: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        ats: list[np.ndarray] = []
        block = (texts, sizes, smallest, variant, docs, ats)
        held, count, last = 0, 0, (None, None)
        hot_window, hot_doc = None, 0

        def flush() -> pa.RecordBatch:
            flat, size, least_doc, of, doc, at = (np.concatenate(p) for p in block)
            least, places = _smallest_docs(flat, size, least_doc, length)
            for part in block:
                part.clear()
            return _span_batch(*_runs(doc, at, places[of], size[of] - length + 1, least, length))

        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            seg = batch.column(1)
            edge = np.ones(batch.num_rows, bool)
            edge[0] = (int(h[0]), seg[0].as_py()) != last
            if batch.num_rows > 1:
                same = np.asarray(pa.compute.equal(seg.slice(1), seg.slice(0, batch.num_rows - 1)))
                edge[1:] = (h[1:] != h[:-1]) | ~same
            plain = int(np.searchsorted(h, _HOT))  # hot keys are the largest
            if plain:
                kind = np.int64 if pa.types.is_large_binary(seg.type) else np.int32
                _, offsets, data = seg.buffers()
                bounds = np.frombuffer(offsets, kind)[seg.offset : seg.offset + batch.num_rows + 1].astype(np.int64)
                data = np.frombuffer(data, np.uint8)
                first = np.flatnonzero(edge[:plain])  # of every segment
                length_of = bounds[first + 1] - bounds[first]
                before = np.cumsum(length_of) - length_of
                turn = h[first] != np.where(first > 0, h[first - 1], -1 if last[0] is None else last[0])
                turns, at_turn = first[turn], before[turn]  # of every minimizer, and the bytes before it
                begin, done = 0, 0
                while True:
                    cut = int(np.searchsorted(at_turn, limit - held + done))
                    end = int(turns[cut]) if cut < len(turns) else plain
                    a, b = np.searchsorted(first, [begin, end])
                    spread = np.repeat(bounds[first[a:b]] - before[a:b], length_of[a:b])
                    texts.append(data[spread + np.arange(len(spread)) + (before[a] if a < b else 0)])
                    sizes.append(length_of[a:b])
                    smallest.append(doc[first[a:b]])
                    variant.append(count - 1 + np.cumsum(edge[begin:end]))
                    docs.append(doc[begin:end].copy())
                    ats.append(at[begin:end].copy())
                    count += b - a
                    if cut >= len(turns):
                        break
                    yield flush()
                    begin, done, held, count = end, int(at_turn[cut]), 0, 0
                held += int(length_of.sum()) - done
            first = np.flatnonzero(edge[plain:]) + plain
            if plain < batch.num_rows and not edge[plain]:
                first = np.append(plain, first)  # a window of the batch before goes on
            for begin, end in zip(first.tolist(), np.append(first[1:], batch.num_rows).tolist()):
                window = (int(h[begin]), seg[begin].as_py())
                if hot_window != window:
                    hot_window, hot_doc = window, doc[begin]
                later = slice(begin + int(np.searchsorted(doc[begin:end], hot_doc, "right")), end)
                if later.start < end:
                    yield _span_batch(doc[later], at[later], at[later] + length)
            last = (int(h[-1]), seg[-1].as_py())
        if docs:
            yield flush()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with an id; joins by it that start here share one shuffle of the texts."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _first_documents(texts: DataFrame) -> DataFrame:
    """(key, key2, first): the smallest document of every distinct text."""
    keyed = texts.select(F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), F.col("text")).alias("key2"), "doc_id")
    return checkpointed(keyed.groupBy("key", "key2").agg(F.min("doc_id").alias("first")))


def removed_spans(texts: DataFrame, firsts: DataFrame, length: int, hot_texts: int, limit: int) -> DataFrame:
    """(doc_id, spans) of the first documents of their texts that have bytes to remove."""
    # every distinct text once; the join reads the shuffle that the later joins by id read
    once = texts.join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
    seen = once.select("doc_id", "text").mapInArrow(_minimizers(length), "h long, key long")
    group = Window.partitionBy("h")
    shared = (
        seen.withColumns({"lo": F.min("key").over(group), "hi": F.max("key").over(group), "n": F.count(F.lit(1)).over(group)})
        .where("lo < hi")
        .select("key", F.when(F.col("n") > hot_texts, F.col("h").bitwiseOR(F.lit(_HOT))).otherwise(F.col("h")).alias("h"))
    )
    wanted = shared.groupBy(F.col("key").alias("doc_id")).agg(F.collect_set("h").alias("wanted"))
    routed = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_pieces(length), "h long, seg binary, doc_id long, at long")
    dealt = routed.repartition("h").sortWithinPartitions("h", "seg", "doc_id", "at")
    spans = dealt.mapInArrow(_removed(length, limit), SPAN)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_removed, n_spans, rest = [], [], []
    bounds = spans.offsets.to_pylist()
    starts, stops = (spans.values.field(i).to_pylist() for i in (0, 1))
    for row, (data, has) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), spans.is_valid().to_pylist())):
        data = data or b""
        a, b = bounds[row : row + 2] if has else (0, 0)
        runs = merged_runs(list(zip(starts[a:b], stops[a:b])), 0)
        kept, at = [], 0
        for a, b in runs:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        n_removed.append(sum(b - a for a, b in runs))
        n_spans.append(len(runs))
        rest.append(b"".join(kept))
    return pa.StructArray.from_arrays(
        [pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(rest, pa.binary())], ["n_removed", "n_spans", "kept"]
    )


def drop_shared(docs: DataFrame, length: int = LENGTH, hot_texts: int = HOT_TEXTS, limit: int = TRANSFORM_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the remaining bytes.

    A null text is empty.  A row with a null id stays whole and is no source.  Rows that repeat a
    doc_id with one text get the same result each: only smaller ids remove anything; ids
    must not stand for different texts.  Other columns take no part.
    """
    texts = _texts(docs)
    firsts = _first_documents(texts)
    spans = removed_spans(texts, firsts, length, hot_texts, limit)
    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), F.col("text")).alias("key2"))
    copies = keyed.join(firsts, ["key", "key2"]).where(F.col("first") < F.col("doc_id"))
    copies = copies.select("doc_id", F.lit(True).alias("copy")).distinct()
    marked = texts.join(spans, "doc_id", "left").join(copies, "doc_id", "left")
    n_bytes = F.octet_length("text").cast("long")
    cut = F.arrow_udf(_kept, "struct<n_removed long, n_spans long, kept binary>")(F.col("text"), F.col("spans"))
    gone = F.coalesce("copy", F.lit(False)) & (n_bytes >= length)  # the text is a smaller document's as a whole
    named = marked.select("doc_id", n_bytes.alias("n_bytes"), gone.alias("gone"), cut.alias("c")).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.col("c.n_removed")).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1).cast("long")).otherwise(F.col("c.n_spans")).alias("n_spans"),
        F.when(F.col("gone"), F.lit("").cast("binary")).otherwise(F.col("c.kept")).alias("kept"),
    )
    nobody = docs.where(F.col("doc_id").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    zero = F.lit(0).cast("long")
    whole = nobody.select("doc_id", n_bytes.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return named.unionByName(whole)
