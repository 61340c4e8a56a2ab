"""Near-duplicate classes by DartMinHash over word shingles.

A document is a weighted set: its five-word shingles, weighted by their counts.  Every
unit of weight of a shingle is a region into which hashed darts fall at growing ranks;
each dart hits one of ``COORDINATES`` coordinates.  A signature keeps the earliest
dart per coordinate, so two documents agree on a coordinate with the probability of their weighted
Jaccard similarity, and a signature costs about k ln k darts, not k per shingle.

Bands of the signature propose candidates.  Every candidate is compared exactly on its
whole shingle sets; classes are the connected components of the links at
``SIMILARITY`` or more:

1. texts with the same words are one document (the smallest doc_id stands for them);
2. each band bucket compares its members with one lead, the member with most neighbours;
3. members that are not linked to the lead are compared with the lead's other members,
   inside one task, by an index of their shingles; only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import Block, mix, text_blocks, word_starts_per_row, words
from inkloom.operators.grouping import connected_labels
from inkloom.session import checkpointed, scratch_path

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
#: Coordinates per band: 32 bands of 4 miss a pair at similarity 0.8 once in 2e7.
BAND = 4
#: Documents of one lead that one task compares, in expectation.
PARTNERS = 4_000
SIGNATURE = "struct<weight long, words1 long, words2 long, bands array<long>>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_cells(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, row bounds, two digests of each row's words).

    The j-th occurrence of a shingle in a row is a cell of its own, so a row's cells are
    a plain set that stands for its weighted shingles; cells of a row ascend.  A
    row of fewer than five words, but not none, has one shingle.
    """
    found = words(block)
    first = word_starts_per_row(found, block.rows)
    count = np.diff(first)
    place = (np.arange(len(found.rows)) - first[found.rows]).astype(np.uint64)
    totals = []
    for salt in (_STEP, _OTHER):
        each = mix(found.digests ^ (place * salt))
        running = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        totals.append(mix((running[first[1:]] - running[first[:-1]]) ^ (count.astype(np.uint64) * salt)))
    usable = max(len(found.digests) - SHINGLE + 1, 0)
    shingles = np.zeros(usable, np.uint64)
    for at in range(SHINGLE):
        shingles = shingles * _STEP + found.digests[at : at + usable]
    inside = found.rows[:usable] == found.rows[SHINGLE - 1 :] if usable else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    rows = np.concatenate([found.rows[:usable][inside], short])
    cells = np.concatenate([mix(shingles[inside]), totals[0][short]])
    order = np.lexsort((cells, rows))
    rows, cells = rows[order], cells[order]
    fresh = np.ones(len(cells), bool)
    fresh[1:] = (cells[1:] != cells[:-1]) | (rows[1:] != rows[:-1])
    at = np.arange(len(cells))
    repeat = at - np.maximum.accumulate(np.where(fresh, at, 0))
    if repeat.any():
        cells = np.where(repeat > 0, mix(cells + repeat.astype(np.uint64) * _OTHER), cells)
        order = np.lexsort((cells, rows))
        cells = cells[order]
    return cells, np.searchsorted(rows, np.arange(block.rows + 1)), np.stack(totals, 1)


def signatures(cells: np.ndarray, bounds: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Rank of the earliest dart per row and coordinate; infinite for a row without cells."""
    weight = np.diff(bounds)
    ranks = np.full((len(weight), k), np.inf)
    waiting, reach = np.flatnonzero(weight), np.log(k) + 3.0
    row_of = np.repeat(np.arange(len(weight)), weight)
    while len(waiting):
        chosen = np.zeros(len(weight), bool)
        chosen[waiting] = True
        use = chosen[row_of]
        cell, row = cells[use], row_of[use]
        limit = reach / weight[row]  # about k * reach darts per row
        rank, dart = np.zeros(len(cell)), 0
        while len(cell):
            bits = mix(cell + np.uint64(dart * int(_STEP) % 2**64))
            rank = rank - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / k
            within = rank <= limit
            cell, row, rank, limit, bits = cell[within], row[within], rank[within], limit[within], bits[within]
            coordinate = (mix(bits ^ _OTHER) % np.uint64(k)).astype(np.int64)
            np.minimum.at(ranks.reshape(-1), row * k + coordinate, rank)
            dart += 1
        waiting = waiting[np.isinf(ranks[waiting]).any(axis=1)]  # some coordinate was not hit: throw farther
        reach *= 2.0
    return ranks


def band_keys(ranks: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band, different from band to band."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), -1, band)
    keys = np.broadcast_to(mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64)), bits.shape[:2])
    for at in range(band):
        keys = mix(keys * _STEP + bits[:, :, at])
    return keys


def _signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        weight, keys, bands = [], [], []
        for block in text_blocks(column):
            cells, bounds, totals = shingle_cells(block)
            weight.append(np.diff(bounds))
            keys.append(totals.view(np.int64))
            bands.append(band_keys(signatures(cells, bounds)).view(np.int64))
        if not weight:
            yield pa.array([], pa.struct([("weight", pa.int64()), ("words1", pa.int64()), ("words2", pa.int64()), ("bands", pa.list_(pa.int64()))]))
            continue
        flat = np.concatenate(bands)
        pair = np.concatenate(keys)
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
        yield pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(weight).astype(np.int64)),
                pa.array(pair[:, 0]),
                pa.array(pair[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1))),
            ],
            ["weight", "words1", "words2", "bands"],
        )


COMPARED = "a long, b long, part int, linked boolean"


class _Star:
    """The documents of one lead in one task: links to the lead, and among those that have none."""

    def __init__(self, lead: int, part: int, similarity: float):
        self.lead, self.part, self.similarity = lead, part, similarity
        self.own = np.zeros(0, np.uint64)
        self.members: list[np.ndarray] = []
        self.ids: list[int] = []
        self.roles: list[int] = []

    def _linked(self, common: np.ndarray, size: np.ndarray, other: int) -> np.ndarray:
        return common >= self.similarity * (size + other - common) - 1e-9

    def rows(self) -> list[tuple[int, int, int, bool]]:
        """(a, b, part, linked): links that join the classes of the star, and (lead, b, part, False) of members without a link to it."""
        if not self.members:
            return []
        sizes = np.array([len(m) for m in self.members])
        ids, roles = np.array(self.ids), np.array(self.roles)
        joined = np.concatenate(self.members)
        order = np.argsort(joined)
        cells, owners = joined[order], np.repeat(np.arange(len(sizes)), sizes)[order]

        def common(own: np.ndarray) -> np.ndarray:
            low, high = np.searchsorted(cells, own, "left"), np.searchsorted(cells, own, "right")
            counts = high - low
            ends = np.cumsum(counts)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(low, counts)
            return np.bincount(owners[at], minlength=len(sizes))

        near = self._linked(common(self.own), sizes, len(self.own)) if len(self.own) else np.zeros(len(sizes), bool)
        near |= roles == 2  # guests were compared with the lead where they live
        out = [(self.lead, int(i), self.part, True) for i in ids[near & (roles == 1)]]
        root = np.where(near & (roles == 1), -1, np.arange(len(sizes)))  # -1: the lead's class
        for member in np.flatnonzero(~near | (roles == 2)):
            if roles[member] == 1:
                out.append((self.lead, int(ids[member]), self.part, False))
            partners = np.flatnonzero(self._linked(common(self.members[member]), sizes, sizes[member]))
            for other in partners:
                if root[other] != root[member]:  # one link per class that it joins
                    out.append((int(ids[member]), int(ids[other]), self.part, True))
                    root[root == root[other]] = root[member]
        return out


def _compare(similarity: float):
    """Task over (lead, part, role, id, text) sorted by these: the lead's text (0), its members (1), guests (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star: _Star | None = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = zip(*rows) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "part", "linked"])

        for batch in batches:
            leads, parts, roles, ids = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
            for block in text_blocks(batch.column(4)):
                cells, bounds, _ = shingle_cells(block)
                for i in range(block.rows):
                    own, row = cells[bounds[i] : bounds[i + 1]].copy(), block.first + i
                    if star is None or (star.lead, star.part) != (leads[row], parts[row]):
                        if star is not None:
                            yield emit(star.rows())
                        star = _Star(leads[row], parts[row], similarity)
                    if roles[row] == 0:
                        star.own = own
                    else:
                        star.members.append(own)
                        star.ids.append(ids[row])
                        star.roles.append(roles[row])
        if star is not None:
            yield emit(star.rows())

    return run


def compare(routes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Every route (doc_id, lead, part, role) with its text, compared inside its (lead, part)."""
    routed = texts.join(routes, "doc_id").select("lead", "part", "role", "doc_id", "text")
    dealt = routed.repartition("lead", "part").sortWithinPartitions("lead", "part", "role", "doc_id")
    return checkpointed(dealt.mapInArrow(_compare(similarity), COMPARED))


def classes_of(banded: DataFrame, texts: DataFrame, similarity: float, partners: int = PARTNERS) -> DataFrame:
    """(doc_id, label) of all documents that share a band with another.

    Every band bucket has a lead, the member with most neighbours, and all documents of
    one lead meet in its task: each is compared with the lead, and those that are not
    linked to it with all others.  So two documents of a bucket are compared unless both
    are linked to its lead.  A lead of more than ``partners`` documents is split into
    parts; those without a link to the lead then also visit the other parts as guests.
    """
    sizes = banded.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = checkpointed(banded.join(sizes, "g"))
    central = checkpointed(groups.groupBy("doc_id").agg(F.sum("n").alias("central")))
    path = scratch_path(texts.sparkSession, "near-texts")
    texts.join(central, "doc_id", "left_semi").dropDuplicates(["doc_id"]).write.parquet(path)
    texts = texts.sparkSession.read.schema(texts.schema).parquet(path)

    first = groups.join(central, "doc_id").groupBy("g").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("minus"))).alias("m"))
    first = first.select("g", (-F.col("m.minus")).alias("lead"))
    pairs = groups.join(first, "g").where(F.col("lead") != F.col("doc_id")).select("doc_id", "lead").distinct()
    pairs = checkpointed(pairs)
    parts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / partners).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(parts, "lead").select("doc_id", "lead", part, F.lit(1).alias("role"))
    leads = parts.select(
        F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")
    )
    compared = compare(members.unionByName(leads), texts, similarity)
    links = compared.where("linked").select("a", "b")
    split = checkpointed(parts.where("parts > 1"))
    if not split.isEmpty():
        alone = compared.where(~F.col("linked")).select(F.col("a").alias("lead"), F.col("b").alias("doc_id"), F.col("part").alias("home"))
        guests = (
            alone.join(split, "lead")
            .select("doc_id", "lead", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("role"))
            .where(F.col("part") != F.col("home"))
            .drop("home")
        )
        hosts = members.join(split.select("lead"), "lead", "left_semi").select("doc_id", "lead", "part", "role")
        links = links.unionByName(compare(guests.unionByName(hosts), texts, similarity).where("linked").select("a", "b"))
    edges = checkpointed(links.distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return connected_labels(nodes, edges, [], "doc_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, partners: int = PARTNERS) -> DataFrame:
    """(doc_id, class_id, weight): the class of every document, named by its smallest doc_id.

    Texts are compared by their words (A-Z lower-cased).  A text without words, or null,
    is a class of its own; so is a row with a null id (its class is null).  Rows that
    repeat an id share its class; other columns take no part.
    """
    texts = docs.select("doc_id", "text")
    signs = checkpointed(texts.select("doc_id", F.arrow_udf(_signed, SIGNATURE)(F.col("text")).alias("s")).select("doc_id", "s.*"))
    named = signs.where((F.col("weight") > 0) & F.col("doc_id").isNotNull())
    words_key = ["words1", "words2", "weight"]
    first = named.groupBy(*words_key).agg(F.min("doc_id").alias("first"))
    member = checkpointed(named.join(first, words_key).select("doc_id", "first"))
    heads = named.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    labels = classes_of(heads.select(F.explode("bands").alias("g"), "doc_id"), texts, similarity, partners)
    classes = member.join(labels.select(F.col("doc_id").alias("first"), "label"), "first", "left").select(
        "doc_id", F.coalesce("label", "first").alias("class_id")
    )
    classes = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return signs.select("doc_id", "weight").join(classes, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "weight"
    )
