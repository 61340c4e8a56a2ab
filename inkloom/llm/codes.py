"""Vector compression: every part of a vector becomes the number of its nearest codebook entry.

Codebooks are improved in rounds.  One round is one Spark job: tasks search the nearest
entry of every part and send integer sums and counts per entry, so what is shuffled and
what reaches the driver is the codebook's size times the tasks, whatever the table's size.

The search is Orchard's: every entry keeps the other entries sorted by their distance from
it.  A query walks the list of its best entry so far; an entry that is nearer becomes the
best, and the walk goes on in its list; entries met before are skipped; and the walk stops
at an entry farther from the best than twice the query's distance, because no entry from
there on can be nearer.  All arithmetic is in 64-bit integers, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import task_count
from inkloom.session import materialize

PARTS = 8
#: Entries of a codebook; a code is two hex digits, so at most 256.
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Largest component, after scaling, whose squared distances stay exact in 64 bits for parts of up to 2,048 components.
LARGEST = 1 << 25


def quantized(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``_x``: floor(scale * component); rows whose vector is null or holds null or non-finite components go."""
    sound = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(F.col(vector).isNotNull() & sound).withColumn(
        "_x", F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    )


@dataclass
class Lists:
    """The entries of one part, and for each the others by rising distance from it."""

    entries: np.ndarray
    order: np.ndarray
    distance: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Lists:
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(apart, axis=1, kind="stable")  # an entry need not lead its own list: it counts as visited
        return cls(entries, order, np.take_along_axis(apart, order, axis=1))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lowest) and squared distance, for every row of ``queries``."""
        count, rows = len(self.entries), len(queries)
        best = np.zeros(rows, np.int64)
        least = ((queries - self.entries[0]) ** 2).sum(axis=1)
        visited = np.zeros((rows, count), bool)
        visited[:, 0] = True
        place = np.zeros(rows, np.int64)
        walking = np.arange(rows)
        while len(walking):
            at = place[walking]
            go = at < count
            walking, at = walking[go], at[go]
            # compared in squares: beyond twice the distance is beyond four times its square
            go = self.distance[best[walking], at] <= 4 * least[walking]
            walking, at = walking[go], at[go]
            met = self.order[best[walking], at]
            place[walking] += 1
            new = ~visited[walking, met]
            asked, met = walking[new], met[new]
            visited[asked, met] = True
            apart = ((queries[asked] - self.entries[met]) ** 2).sum(axis=1)
            better = (apart < least[asked]) | ((apart == least[asked]) & (met < best[asked]))
            jump = asked[better]
            best[jump], least[jump], place[jump] = met[better], apart[better], 0
        return best, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Components of the vectors as rows of ``width``; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _searched(books: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of every row."""
    parts, width = books.shape[0], books.shape[2]
    found, away = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for part in range(parts):
        found[:, part], away[:, part] = Lists.of(books[part]).nearest(x[:, part * width : (part + 1) * width])
    return found, away


def improved(points: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; unused entries stay."""
    parts, count, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            found, _ = _searched(books, x)
            for part in range(parts):
                np.add.at(total[part], found[:, part], x[:, part * width : (part + 1) * width])
                used[part] += np.bincount(found[:, part], minlength=count)
        slot = np.repeat(np.arange(parts * count), width + 1)
        place = np.tile(np.arange(width + 1), parts * count)  # the last place of a slot holds its count
        value = np.concatenate([total, used[:, :, None]], axis=2).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), pa.array(value)], ["slot", "place", "value"])

    sums = points.select("_x").mapInArrow(summed, "slot long, place long, value long")
    whole = F.sum(F.col("value").cast("decimal(38,0)"))
    rows = sums.groupBy("slot", "place").agg(whole.alias("value")).collect()  # as many rows as the books have numbers
    total = {(r["slot"], r["place"]): int(r["value"]) for r in rows}
    out = books.copy()
    for slot in range(parts * count):
        used = total.get((slot, width), 0)
        if used:
            out[slot // count, slot % count] = [total[slot, i] // used for i in range(width)]
    return out


def train(points: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` of ``points(key, _x)``.

    They start as the parts of the ``entries`` rows with the smallest keys (rows that
    repeat a key in order of their components; rows without a key are no start).  With
    fewer rows there are fewer entries, without rows none.  Vectors are taken to be of the
    width of the longest, rounded up to a multiple of ``parts``; shorter ones end in zeros.
    """
    sizes = points.agg(F.max(F.size("_x")).alias("w"), F.max(F.array_max(F.transform("_x", lambda x: F.abs(x)))).alias("top")).first()
    if sizes["top"] is not None and sizes["top"] > LARGEST:
        raise OverflowError(f"components up to {sizes['top']} after scaling; squared distances are exact up to {LARGEST}")
    width = -(-(sizes["w"] or 0) // parts)
    first = points.where(F.col(key).isNotNull()).select(key, "_x").orderBy(key, "_x").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for entry, row in enumerate(first):
        whole = np.zeros(parts * width, np.int64)
        whole[: len(row["_x"])] = row["_x"]
        books[:, entry] = whole.reshape(parts, width)
    for _ in range(rounds if len(first) and width else 0):
        books = improved(points, books)
    return books


def digest(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(points: DataFrame, books: np.ndarray) -> DataFrame:
    """``points`` without ``_x``, with ``code`` (two hex digits per part) and ``error`` (sum of squared distances)."""
    parts, count, width = books.shape
    two = np.array([f"{i:02x}" for i in range(max(count, 1))])

    @F.arrow_udf("struct<code string, error long>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            if count and width:
                found, away = _searched(books, _matrix(column, parts * width))
            else:
                found = away = np.zeros((len(column), parts), np.int64)
            code = two[found[:, 0]]
            for part in range(1, parts):
                code = np.char.add(code, two[found[:, part]])
            yield pa.StructArray.from_arrays([pa.array(code), pa.array(away.sum(axis=1))], ["code", "error"])

    kept = [c for c in points.columns if c not in ("_x", "code", "error")]
    return points.select(*kept, coded("_x").alias("_coded")).select(*kept, "_coded.code", "_coded.error")


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of every sound vector.

    ``label_error`` sums the errors of equal labels, nulls together.  Rows with a null key
    are coded as well, repeated rows once each; other columns take no part.  An empty table
    gives no rows; an empty vector has only zeros.
    """
    sound = quantized(vectors.select(key, label, vector), vector).select(key, label, "_x")
    points = materialize(sound.repartition(task_count(vectors.sparkSession)))  # read once per round
    books = train(points, key, parts, entries, rounds)
    coded = materialize(encode(points, books))
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error")).withColumnRenamed(label, "_label")
    joined = coded.join(sums, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, label, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
