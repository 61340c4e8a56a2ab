"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: ``h = 2h + G[byte]``, of which five bits that
depend on the last ``REACH`` bytes decide where a chunk ends.  Boundaries follow the
content, so an insertion changes the chunks near it and the ones after fall back
into step.  Chunks are compared by a 128-bit digest over the whole corpus; the first occurrence
(smallest doc_id, then position) stays, and later ones are removed where they make up
runs of at least ``LEAST`` bytes or a whole text.  So the only repeated chunk that stays is the
last one of a text where it is shorter than that and the chunk before it is no repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import BYTE_VALUES, Block, text_blocks
from inkloom.session import checkpointed

#: Bytes that decide a boundary, least and most bytes of a chunk.
REACH, LEAST, MOST = 16, 32, 256
#: Fewer digests than this are ever sent to all tasks: those that each hold more than this share of the repeated chunks.
HOT_DIGESTS = 1000
#: Bits 11-15 of the hash: bit 15 still feels the byte 15 places back, none feels one before.
_MASK = np.uint32(0b11111 << 11)
_GEAR = (BYTE_VALUES & np.uint64(0xFFFF)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Low 16 bits of the rolling hash at every byte, over the last ``REACH`` bytes."""
    out, span = _GEAR[data], 1
    while span < REACH:  # doubles the bytes that a value covers
        longer = out.copy()
        longer[span:] += out[:-span] << np.uint32(span)
        out, span = longer, 2 * span
    return out


def boundaries(block: Block) -> Iterator[list[int]]:
    """Chunk edges of every row, its start and end included; never inside a character."""
    data = block.data
    if not len(data):
        yield from ([0] for _ in range(block.rows))
        return
    start_of_character = (data & 0xC0) != 0x80
    ends = np.flatnonzero((gear(data) & _MASK) == 0) + 1
    ends = ends[(ends < len(data))]
    ends = ends[start_of_character[ends]]
    first = np.searchsorted(ends, block.bounds)
    for row in range(block.rows):
        start, stop = int(block.bounds[row]), int(block.bounds[row + 1])
        edges, last = [start], start
        for edge in [*ends[first[row] : first[row + 1]].tolist(), stop]:
            while edge - last > MOST:
                last += MOST
                while not start_of_character[last]:
                    last -= 1
                edges.append(last)
            if edge - last >= LEAST or edge == stop and edge > last:
                edges.append(edge)
                last = edge
        yield edges


CHUNK = "doc_id long, start int, stop int, d1 long, d2 long"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for block in text_blocks(batch.column(1)):
            rows, starts, stops, digests = [], [], [], []
            whole = block.data.tobytes()
            for row, edges in enumerate(boundaries(block)):
                base = int(block.bounds[row])
                for a, b in zip(edges[:-1], edges[1:]):
                    rows.append(block.first + row)
                    starts.append(a - base)
                    stops.append(b - base)
                    digests.append(hashlib.blake2b(whole[a:b], digest_size=16).digest())
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int32()),
                    pa.array(stops, pa.int32()),
                    pa.array(pair[:, 0]),
                    pa.array(pair[:, 1]),
                ],
                ["doc_id", "start", "stop", "d1", "d2"],
            )


def merged_runs(spans: list[tuple[int, int]], least: int, size: int | None = None) -> list[tuple[int, int]]:
    """Touching spans of a text of ``size`` bytes joined, runs shorter than ``least`` left out unless they are all of it."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs if b - a >= least or b - a == size]


def _cut(texts: pa.Array, repeats: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), repeats.to_pylist()):
        data = (text or "").encode()
        runs = merged_runs([(s["start"], s["stop"]) for s in spans or []], LEAST, len(data))
        kept, at = [], 0
        for a, b in runs:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        out.append(
            {
                "n_bytes": len(data),
                "n_removed": sum(b - a for a, b in runs),
                "removed": [{"start": a, "stop": b} for a, b in runs],
                "kept_text": None if text is None else b"".join(kept).decode(),
            }
        )
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", span), ("kept_text", pa.string())]))


CUT = "struct<n_bytes long, n_removed long, removed array<struct<start: long, stop: long>>, kept_text string>"


def drop_repeats(docs: DataFrame, hot: int = HOT_DIGESTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept_text): texts without chunks that occur earlier.

    ``removed`` holds byte ranges of the UTF-8 text.  A null text has no chunks and stays
    null; an empty one stays empty.  Rows that repeat an id share their first
    occurrences: a chunk that one of them has at the same place is not earlier.  Of repeated
    chunks only a text's last one stays, if it has less than ``LEAST`` bytes and follows no other.  Rows with
    a null id are returned whole and are no source.  Other columns take no part.

    Chunks meet the first occurrence of their digest by a shuffle; digests that hold more
    than one in ``hot`` of all repeated chunks, fewer than ``hot``, travel to the chunks instead.
    """
    docs = docs.select("doc_id", "text")
    chunks = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_chunked, CHUNK)
    place = F.struct("doc_id", "start")
    first = checkpointed(
        chunks.groupBy("d1", "d2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("first") < F.col("last"))
        .select("d1", "d2", "first", "n")
    )
    total = first.agg(F.sum("n")).first()[0] or 0
    # fewer than ``hot`` digests can each hold more than this share
    busy = first.where(F.col("n") * hot > total).select("d1", "d2", F.col("first").alias("busy_first"))
    told = chunks.join(F.broadcast(busy), ["d1", "d2"], "left").withColumn("busy", F.col("busy_first").isNotNull())
    told = told.where(~F.col("busy") | (place > F.col("busy_first")))
    # chunks of busy digests are decided: they go anywhere
    away = F.xxhash64("doc_id", "start")
    dealt = told.select("doc_id", "start", "stop", "busy", *[F.when(F.col("busy"), away).otherwise(F.col(d)).alias(d) for d in ("d1", "d2")])
    later = dealt.join(first.drop("n"), ["d1", "d2"], "left").where(F.col("busy") | (place > F.col("first")))
    repeats = later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("repeats"))
    cut = F.arrow_udf(_cut, CUT)(F.col("text"), F.col("repeats"))
    return docs.join(repeats, "doc_id", "left").select("doc_id", cut.alias("c")).select("doc_id", "c.*")
