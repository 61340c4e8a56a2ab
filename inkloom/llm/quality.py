"""Quality scores by Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0.  The strength of a document is
linear in its features, and the chance that one is preferred to another is the logistic
function of the difference of their strengths, so weights come from the logistic loss on
feature differences of preference pairs.  Documents are accepted above a quantile of the
strengths of all labelled rows: the share of label 0 among them.

Features are shares of byte classes and of repeated words of the whole text, computed in
numpy over blocks; they do not depend on the language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import Block, mix, text_blocks, words
from inkloom.scale import ranked_values
from inkloom.session import materialize, release

#: Labelled rows that meet in one chunk, in expectation.
CHUNK_ROWS = 1 << 14
#: Rows of each label that a chunk sees at least, in expectation (all, if there are fewer).
CHUNK_LEAST = 64
#: Preference pairs drawn for every labelled row.
PAIRS_PER_DOC = 8
#: Newton steps at most, and the largest move of a weight that ends them.
ROUNDS = 12
SETTLED = 1e-9
#: Score that marks the accepting quantile.
ACCEPTED = 0.3
RIDGE = 1e-3
RESULT = "struct<score double, predicted int>"

#: Class of every byte: each ASCII mark its own, then digits, capitals, small letters, blank, line end, control, other.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = len(_MARKS) + 7
_CLASS = np.full(256, len(_MARKS) + 6, np.int64)
_CLASS[:32] = len(_MARKS) + 5
_CLASS[127] = len(_MARKS) + 5
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = _i
for _i, _span in enumerate((range(48, 58), range(65, 91), range(97, 123), (32, 9), (10,))):
    _CLASS[list(_span)] = len(_MARKS) + _i
_PRINTED = np.ones(256, bool)
_PRINTED[[9, 10, 11, 12, 13, 32]] = False
FEATURES = _CLASSES + 6


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; a null or empty text has only zeros."""
    out = np.zeros((len(column), FEATURES))
    for block in text_blocks(column):
        out[block.first : block.first + block.rows] = _block_features(block)
    return out


def _block_features(block: Block) -> np.ndarray:
    rows, sizes = block.rows, np.diff(block.bounds)
    out = np.zeros((rows, FEATURES))
    row = np.repeat(np.arange(rows), sizes)
    seen = np.bincount(row * _CLASSES + _CLASS[block.data], minlength=rows * _CLASSES).reshape(rows, _CLASSES)
    out[:, :_CLASSES] = np.sqrt(seen / np.maximum(sizes, 1)[:, None])
    found = words(block, _PRINTED)
    n = np.bincount(found.rows, minlength=rows)
    held = np.maximum(n, 1)

    def share(hit: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(where[hit], minlength=rows) / held)

    for back in (1, 2):  # a word that stood one or two places before
        same = (found.digests[back:] == found.digests[:-back]) & (found.rows[back:] == found.rows[:-back])
        out[:, _CLASSES + back - 1] = share(same, found.rows[back:])
    own = np.unique(mix(found.digests ^ mix(found.rows.astype(np.uint64))), return_index=True)[1]
    out[:, _CLASSES + 2] = np.where(n > 0, np.log(held) - np.log(np.maximum(np.bincount(found.rows[own], minlength=rows), 1)), 0)
    out[:, _CLASSES + 3] = np.bincount(found.rows, found.ends - found.starts, rows) / held / 10
    out[:, _CLASSES + 4] = share(found.ends - found.starts == 1, found.rows)
    out[:, _CLASSES + 5] = np.log1p(n) / 10
    return out


@dataclass
class Ranking:
    """Strength of a document: ``(features - center) / spread @ weights``; ``least`` is the accepting strength."""

    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    least: float

    def strength(self, found: np.ndarray) -> np.ndarray:
        return (found - self.center) / self.spread @ self.weights

    def score(self, found: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the strength; ``ACCEPTED`` at the accepting strength."""
        odds = np.log(ACCEPTED / (1 - ACCEPTED)) + self.strength(found) - self.least
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def preference_pairs(labels: np.ndarray, per_doc: int = PAIRS_PER_DOC, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places of preferred and other documents: every row meets ``per_doc`` random rows of the other label."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(good, per_doc), rng.choice(good, len(bad) * per_doc)])
    worse = np.concatenate([rng.choice(bad, len(good) * per_doc), np.repeat(bad, per_doc)])
    return better, worse


def _pair_sums(scaled: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], weights: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Slope and bend of the logistic loss, summed over the pairs, as one row of numbers."""
    better, worse = pairs
    width = scaled.shape[1]
    slope, bend = np.zeros(width), np.zeros((width, width))
    for at in range(0, len(better), step):
        gap = scaled[better[at : at + step]] - scaled[worse[at : at + step]]
        lost = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))  # chance that the other one is preferred
        slope -= gap.T @ lost
        bend += (gap * (lost * (1 - lost))[:, None]).T @ gap
    return np.concatenate([[float(len(better))], slope, bend.ravel()])


def _descend(width: int, sums: Callable[[np.ndarray], np.ndarray], rounds: int) -> np.ndarray | None:
    """Newton steps with a small ridge; None without pairs."""
    weights = np.zeros(width)
    for _ in range(rounds):
        total = sums(weights)
        if not total[0]:
            return None
        slope = RIDGE * weights + total[1 : 1 + width] / total[0]
        bend = RIDGE * np.eye(width) + total[1 + width :].reshape(width, width) / total[0]
        move = np.linalg.solve(bend, slope)
        weights = weights - move * min(1.0, 3.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < SETTLED:
            break
    return weights


def fit(found: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Ranking:
    """The ranking of rows that are at hand; ``train`` does the same over a table of any size."""
    width = found.shape[1]
    center = found.mean(axis=0) if len(found) else np.zeros(width)
    spread = found.std(axis=0) if len(found) else np.ones(width)
    spread = np.where(spread > 1e-9, spread, 1.0)
    scaled = (found - center) / spread
    pairs = preference_pairs(labels)
    weights = _descend(width, lambda w: _pair_sums(scaled, pairs, w), rounds)
    if weights is None:
        return Ranking(center, spread, np.zeros(width), 0.0)
    least = float(np.quantile(scaled @ weights, (labels == 0).mean(), method="midpoint"))
    return Ranking(center, spread, weights, least)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(batch.column(1))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), FEATURES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "found"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, own, labels, features) of every run of rows of one chunk."""

    def joined(held: list[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        own = rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
        found = rows.column("found").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        return int(rows.column("chunk")[0].as_py()), own, rows.column("label").to_numpy(), found

    held: list[pa.RecordBatch] = []
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop == start:
                continue
            if held and held[0].column("chunk")[0].as_py() != chunk[start]:
                yield joined(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield joined(held)


def _summed(rows: DataFrame, of_chunk: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``of_chunk`` of all rows: one sum per task, a few thousand numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for chunk in _chunks(batches):
            one = of_chunk(*chunk)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    return [np.array(r["total"]) for r in rows.mapInArrow(work, "total array<double>").collect()]


def _dealt(known: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Labelled ids with the chunk in which they meet the other label (``own`` once per row).

    A chunk holds about ``CHUNK_ROWS`` rows.  Where a label is so rare that a chunk would see
    fewer than ``CHUNK_LEAST`` of its rows, its rows visit several chunks.
    """
    chunks = -(-sum(sizes.values()) // CHUNK_ROWS)
    home = F.pmod(F.xxhash64("doc_id"), F.lit(chunks))
    visits = F.lit(1)
    for label, size in sorted(sizes.items()):
        visits = F.when(F.col("label") == label, min(chunks, -(-CHUNK_LEAST * chunks // size))).otherwise(visits)
    placed = known.select("doc_id", "label", home.alias("home"), F.explode(F.sequence(F.lit(0), visits - 1)).alias("visit"))
    chunk = F.pmod(F.col("home") + F.col("visit"), F.lit(chunks)).cast("int")
    return placed.select("doc_id", "label", chunk.alias("chunk"), (F.col("visit") == 0).alias("own"))


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Ranking:
    """Learn from ``docs(doc_id, text)`` and every row of ``labels(doc_id, quality)``.

    Rows without an id or a label of 0 or 1 teach nothing; without rows of both labels
    every document is accepted.  Features of the labelled documents are written once,
    in chunks of rows that lie together by a hash of doc_id; every row meets
    ``PAIRS_PER_DOC`` rows of the other label in its chunk.  Each Newton step and the
    accepting quantile, which is exact, are Spark jobs over all of them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    empty = Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    if len(sizes) < 2:
        return empty
    # texts are read where they lie; only their features travel
    kind = dict(docs.dtypes)["doc_id"]
    taught = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_features_of, f"doc_id {kind}, found array<double>")
    met = taught.join(_dealt(known, sizes), "doc_id").select("chunk", "doc_id", "own", "label", "found")
    rows = materialize(met.repartition("chunk").sortWithinPartitions("chunk", "doc_id", "label"))

    def moments(_, own, __, found):
        return np.concatenate([[float(own.sum())], found[own].sum(axis=0)])

    def squares(_, own, __, found):
        return ((found[own] - center) ** 2).sum(axis=0)

    sums = _summed(rows, moments)
    if not sums or not sum(sums)[0]:
        release(rows)
        return empty
    count, *means = sum(sums)
    center = np.array(means) / count
    spread = np.sqrt(sum(_summed(rows, squares)) / count)
    spread = np.where(spread > 1e-9, spread, 1.0)

    def step(weights: np.ndarray) -> np.ndarray:
        def of_chunk(chunk, own, label, found):
            return _pair_sums((found - center) / spread, preference_pairs(label, seed=7 + chunk), weights)

        return sum(_summed(rows, of_chunk))

    weights = _descend(FEATURES, step, rounds)
    if weights is None:
        release(rows)
        return Ranking(center, spread, np.zeros(FEATURES), 0.0)
    ranking = Ranking(center, spread, weights, 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, label, found in _chunks(batches):
            strength = ranking.strength(found[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(strength), np.int32)), pa.array(strength), pa.array(label[own])], ["whole", "strength", "label"])

    told = materialize(rows.mapInArrow(strengths, "whole int, strength double, label int"))
    # the quantile at the share of label 0, between the two strengths that hold it
    held = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    n = sum(held.values())
    place = held.get(0, 0) * (n - 1)
    ends = ranked_values(told, ["whole"], "strength", {"low": F.lit(place // n), "high": F.lit(-(-place // n))}).first()
    ranking.least = (ends["low"] + ends["high"]) / 2
    release(rows, told)
    return ranking


def rank(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``ACCEPTED`` on) of every whole text.

    Null texts are empty; equal texts get equal scores.  Input columns with the names of
    the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)  # a few hundred numbers

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            score = shared.value.score(features(column))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array((score >= ACCEPTED).astype(np.int32))], ["score", "predicted"])

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(F.col(text)).alias("_ranked")).select(*kept, "_ranked.score", "_ranked.predicted")

