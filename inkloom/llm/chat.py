"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text </turn>`` and a newline.  Inside roles and texts a
backslash, ``###`` and ``</turn>`` (in roles ``:`` too) are written as a backslash and
one letter, so no control string occurs outside the template and reading back is exact.

A task takes the rows of whole conversations as Arrow buffers and lists the segments of
the output (headers, pieces of texts between escapes, replacements) as numpy arrays of
source position and length.  Cumulative lengths give every segment's place, one scatter
index copies all bytes into one preallocated buffer, and that buffer is the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, STOP, END = b"### ", b": ", b"</turn>", b" </turn>\n"
#: Control strings and the letters that stand for them after a backslash.
CONTROLS = [(b"\\", b"\\\\"), (b"###", b"\\h"), (STOP, b"\\t")]
ROLE_CONTROLS = [*CONTROLS, (b":", b"\\c")]
LETTERS = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
#: Whose texts are trained on.
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def _occurrences(data: np.ndarray, bounds: np.ndarray, word: bytes) -> np.ndarray:
    """Starts of ``word`` inside single rows, leftmost and without overlap."""
    size = len(data) - len(word) + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    same = np.ones(size, bool)
    for at, byte in enumerate(word):
        same &= data[at : at + size] == byte
    starts = np.flatnonzero(same)
    row = np.searchsorted(bounds, starts, "right")
    starts = starts[starts + len(word) <= bounds[np.minimum(row, len(bounds) - 1)]]
    if len(set(word)) > 1 or len(word) == 1 or not len(starts):
        return starts  # these words cannot overlap themselves
    row = np.searchsorted(bounds, starts, "right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(starts) > 1) | (np.diff(row) > 0)
    run = starts[np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))]
    return starts[(starts - run) % len(word) == 0]


class _Segments:
    """Output segments: (row, key in the row, position in the pool, length)."""

    def __init__(self) -> None:
        self.pool: list[np.ndarray] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def source(self, data: np.ndarray | bytes) -> int:
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        self.pool.append(data)
        self.size += len(data)
        return self.size - len(data)

    def constant(self, rows: np.ndarray, key: np.ndarray | int, data: bytes) -> None:
        at = self.source(data)
        self.parts.append((rows, np.broadcast_to(key, rows.shape), np.full(len(rows), at), np.full(len(rows), len(data))))

    def escaped(self, data: np.ndarray, bounds: np.ndarray, controls: list[tuple[bytes, bytes]], base: int) -> None:
        """The rows' bytes with every control string replaced; keys grow from ``base``."""
        origin = self.source(data)
        found = [_occurrences(data, bounds, word) for word, _ in controls]
        for starts, (_, instead) in zip(found, controls):
            row = np.searchsorted(bounds, starts, "right") - 1
            self.constant(row, base + 2 * (starts - bounds[row]) + 1, instead)
        starts = np.concatenate([bounds[:-1], *[s + len(w) for s, (w, _) in zip(found, controls)]])
        rows = np.concatenate([np.arange(len(bounds) - 1), *[np.searchsorted(bounds, s, "right") - 1 for s in found]])
        stops = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        nearest = np.searchsorted(stops, starts, "left")
        limit = bounds[rows + 1]
        ends = np.minimum(np.append(stops, len(data))[nearest], limit)
        self.parts.append((rows, base + 2 * (starts - bounds[rows]), origin + starts, ends - starts))

    def assemble(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, keys, places, bytes): segments in order with their place, and the output."""
        rows, keys, sources, lengths = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((keys, rows))
        rows, keys, sources, lengths = rows[order], keys[order], sources[order], lengths[order]
        places = np.concatenate([[0], np.cumsum(lengths)])
        scatter = np.repeat(sources - places[:-1], lengths) + np.arange(places[-1])
        out = np.empty(places[-1], np.uint8)
        np.take(np.concatenate(self.pool), scatter, out=out)
        return rows, keys, places, out


_ROLE_KEY = -(1 << 40)


def assemble(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Format (conv_id, role, text) rows, sorted, of whole conversations."""
    ids, roles, texts = rows.column(0), rows.column(1), rows.column(2)
    every = np.arange(len(ids))
    segments = _Segments()
    segments.constant(every, _ROLE_KEY - 1, OPEN)
    segments.escaped(*_flat(roles), ROLE_CONTROLS, _ROLE_KEY)
    segments.constant(every, -1, CLOSE)
    segments.escaped(*_flat(texts), CONTROLS, 0)
    segments.constant(every, 1 << 50, END)
    row, key, places, out = segments.assemble()

    first = np.ones(len(ids), bool)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    first[1:] = (numbers[1:] != numbers[:-1]) | (empty[1:] != empty[:-1])
    head = np.flatnonzero(first)
    n_turns = np.diff(np.append(head, len(ids)))

    characters = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    start_of_row = places[np.searchsorted(row, every)]
    body = np.flatnonzero(key == -1)  # the text starts after the header's end
    text_start = characters[places[body + 1]]
    text_end = characters[places[np.flatnonzero(key == 1 << 50)]]
    conversation = np.cumsum(first) - 1
    base = characters[start_of_row[head]][conversation]
    loss = np.array([r == LOSS_ROLE for r in roles.to_pylist()], bool)
    spans = pa.StructArray.from_arrays(
        [pa.array((text_start - base)[loss]), pa.array((text_end - base)[loss])], ["start", "end"]
    )
    per_conversation = np.concatenate([[0], np.cumsum(np.bincount(conversation[loss], minlength=len(head)))])
    offsets = np.append(start_of_row[head], len(out)).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(head)),
            pa.array(n_turns.astype(np.int64)),
            text,
            pa.ListArray.from_arrays(pa.array(per_conversation.astype(np.int32)), spans).cast(_SPANS),
        ],
        ["conv_id", "n_turns", "formatted", "loss_spans"],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of the conversation that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        key = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        last_held = held[-1].column(0)[-1].as_py() if held else None
        if held and ids[0].as_py() != last_held:
            yield assemble(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield assemble(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield assemble(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) per conversation.

    Turns are ordered by ``turn``, ties by role and text; rows that repeat are turns of
    their own.  A null role or text is empty; rows with a null conv_id form one
    conversation.  ``loss_spans`` are the code point ranges [start, end) of ``formatted`` that hold the
    assistant's texts.  A conversation is one output row, so it must fit in a task; other
    columns take no part.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_stream, FORMATTED)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: LETTERS[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn[len(OPEN) :].partition(CLOSE.decode())
        turns.append((unescape(role), unescape(text)))
    return turns


def _digests(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, ranges in zip(formatted.to_pylist(), spans.to_pylist()):
        turns = parse(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in ranges)
        out.append(
            {
                "n_turns": len(turns),
                "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                "loss_chars": len(loss),
                "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
            }
        )
    kind = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    return pa.array(out, pa.struct(kind))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from ``formatted`` and ``loss_spans``."""
    digests = F.arrow_udf(_digests, "struct<n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string>")
    return formatted.select("conv_id", digests("formatted", "loss_spans").alias("d"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars"
    )
