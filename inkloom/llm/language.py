"""Language ID by prediction by partial matching.

Per language a byte context tree of order ``ORDER`` holds frozen counts.  A
byte costs ``-log2(n / (total + distinct))`` bits in the longest context of the
tree that was seen; a context that has not seen the byte charges its escape,
``-log2(distinct / (total + distinct))``, and passes to the next shorter one;
below order 0 all 256 bytes are equal.  The language with the shortest code of
the whole text wins.

The trees of all languages are flattened into one table per order whose rows
hold the code length of a gram in every language, so scoring is one lookup per
byte and a rare walk to shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.blocks import _LOWER, Block, KeyIndex, text_blocks
from inkloom.session import checkpointed

#: Bytes of context before the coded byte.
ORDER = 3
#: Labelled rows per language that the trees are counted from, in expectation.
SAMPLE_DOCS = 600
#: Languages times grams of the longest order that a model may hold; shorter orders have fewer.
MAX_CELLS = 1 << 25
UNDETERMINED = "und"
RESULT = "struct<lang_pred string, score double, bits_per_byte double>"


def grams(block: Block) -> np.ndarray:
    """Each byte with its ``ORDER`` predecessors as one uint32; texts begin after virtual newlines."""
    data = _LOWER[block.data]
    out = data.astype(np.uint32)
    starts, ends = block.bounds[:-1], block.bounds[1:]
    for back in range(1, ORDER + 1):
        before = np.full(len(data), 10, np.uint32)
        before[back:] = data[:-back] if len(data) > back else data[:0]
        for step in range(back):
            at = starts + step
            before[at[at < ends]] = 10
        out |= before << np.uint32(8 * back)
    return out


@dataclass
class ContextTrees:
    """Code lengths in bits: ``costs[k][language, gram]`` and ``escapes[k][language, context]``."""

    languages: list[str]
    gram_keys: list[np.ndarray]
    context_keys: list[np.ndarray]
    costs: list[np.ndarray]
    escapes: list[np.ndarray]

    def index(self) -> None:
        if hasattr(self, "gram_index"):
            return
        self.gram_index = [KeyIndex(k) for k in self.gram_keys]
        self.context_index = [KeyIndex(k) for k in self.context_keys]

    def code_lengths(self, keys: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
        """Per language the bits of every gram in ``keys``."""
        steps, at, left = [], np.arange(len(keys)), keys
        for k in range(order, -1, -1):
            low = left & np.uint32(0xFFFFFFFF >> (8 * (ORDER - k)))
            found = self.gram_index[k].find(low)
            hit = found >= 0
            missed = ~hit
            context = self.context_index[k].find(low[missed] >> np.uint32(8))
            known = context >= 0
            steps.append((k, at[hit], found[hit], at[missed][known], context[known]))
            at, left = at[missed], left[missed]
            if not len(at):
                break
        for language in range(len(self.languages)):
            bits = np.zeros(len(keys), np.float64)
            bits[at] = 8.0  # below order 0
            for k, where, row, where_context, row_context in steps:
                bits[where] += self.costs[k][language][row]
                bits[where_context] += self.escapes[k][language][row_context]
            yield bits


def build_trees(languages: list[str], language: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> ContextTrees:
    """Trees of all orders from the counts of the longest grams (shorter contexts are their marginals).

    Cells are written language by language, so what is held besides the trees is one row.
    """
    trees = ContextTrees(languages, [], [], [], [])
    order = np.argsort(language, kind="stable")
    language, keys, counts = language[order], keys[order], counts[order]
    edges = np.searchsorted(language, np.arange(len(languages) + 1))
    for k in range(ORDER + 1):
        low = keys & np.uint32(0xFFFFFFFF >> (8 * (ORDER - k)))
        gram_keys, gram_of = np.unique(low, return_inverse=True)
        context_keys, context_of = np.unique(gram_keys >> np.uint32(8), return_inverse=True)
        costs = np.empty((len(languages), len(gram_keys)), np.float32)
        escapes = np.zeros((len(languages), len(context_keys)), np.float32)
        if k:
            shorter = KeyIndex(trees.gram_keys[k - 1]).find(gram_keys & np.uint32(0xFFFFFFFF >> (8 * (ORDER - k + 1))))
        for row in range(len(languages)):
            own = slice(edges[row], edges[row + 1])
            seen = np.bincount(gram_of[own], counts[own], len(gram_keys))
            distinct = np.bincount(context_of, seen > 0, len(context_keys))
            whole = np.bincount(context_of, seen, len(context_keys)) + distinct
            known, met = distinct > 0, seen > 0
            escapes[row, known] = -np.log2(distinct[known] / whole[known])
            costs[row] = (trees.costs[k - 1][row, shorter] if k else 8.0) + escapes[row, context_of]
            costs[row, met] = -np.log2(seen[met] / whole[context_of[met]])
        trees.gram_keys.append(gram_keys)
        trees.context_keys.append(context_keys)
        trees.costs.append(costs)
        trees.escapes.append(escapes)
    return trees


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_cells: int = MAX_CELLS) -> ContextTrees:
    """Count the trees from rows with ``doc_id``, ``text`` and a non-null ``lang``.

    The counts come from a sample of about ``sample_docs`` rows per language, chosen
    by a hash of doc_id; all other steps of the operator cover every row.  Every language takes
    part.  If languages times grams pass ``max_cells``, the grams that rank highest in any
    language's own counts stay, so each language keeps about as many of its frequent grams.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return build_trees([], np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0))
    number = {name: i for i, name in enumerate(languages)}
    grain = 1 << 20
    share = F.create_map(
        *[F.lit(x) for r in sizes for x in (r["lang"], min(grain, int(grain * sample_docs / r["count"]) + 1))]
    )
    code = F.create_map(*[F.lit(x) for name in languages for x in (name, number[name])])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < share[F.col("lang")])
    sample = sample.where(F.col("text").isNotNull()).select(code[F.col("lang")].alias("code"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in text_blocks(batch.column(1)):
                rows_of = np.repeat(codes[block.first : block.first + block.rows], np.diff(block.bounds))
                parts.append(np.unique((rows_of << 32) | grams(block).astype(np.int64), return_counts=True))
                if len(parts) >= 64:
                    parts = [_merged(parts)]
        if parts:
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    kept = checkpointed(sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    gram = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    room = max(max_cells // len(languages), 256)
    if kept.select(gram).distinct().count() > room:
        own = Window.partitionBy(F.shiftright("key", 32)).orderBy(F.desc("n"), "key")
        ranked = kept.select(gram.alias("gram"), F.row_number().over(own).alias("rank"))
        best = ranked.groupBy("gram").agg(F.min("rank").alias("rank")).orderBy("rank", "gram").limit(room)
        kept = kept.join(best.select("gram"), gram == F.col("gram"), "left_semi")
    kept = kept.toArrow()
    keys, n = kept.column("key").to_numpy(), kept.column("n").to_numpy()
    return build_trees(languages, keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32), n.astype(np.float64))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def score_texts(trees: ContextTrees, column: pa.Array) -> pa.StructArray:
    """Language, its share of the posterior under equal priors, and its bits per byte, for every text."""
    rows = len(column)
    best, share, per_byte = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    for block in text_blocks(column):
        lengths = np.diff(block.bounds)
        full = np.flatnonzero(lengths)
        if not len(full) or not trees.languages:
            continue
        at = block.bounds[full]
        totals = np.stack([np.add.reduceat(bits, at) for bits in trees.code_lengths(grams(block))])
        winner = totals.argmin(axis=0)  # ties: the first language in order
        least = totals[winner, np.arange(len(full))]
        here = block.first + full
        best[here] = winner
        share[here] = 1.0 / np.exp2(np.maximum(least - totals, -1000.0)).sum(axis=0)
        per_byte[here] = least / lengths[full]
    names = pa.array([*trees.languages, UNDETERMINED], pa.string())
    chosen = names.take(pa.array(best if trees.languages else np.zeros(rows, np.int64)))
    return pa.StructArray.from_arrays([chosen, pa.array(share), pa.array(per_byte)], ["lang_pred", "score", "bits_per_byte"])


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` of every whole text.

    A text that is null or has no letter gets ``und`` and score 0, as does every text
    under a model without languages.  Equal code lengths go to the first language in
    order.  Input columns with the names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MAX_CELLS

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        model.index()
        for column in batches:
            yield score_texts(model, column)

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if trees.languages else F.lit(False)
    new = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c not in new]
    return (
        docs.select(*kept, scored(F.col(text)).alias("_scored"), lettered.alias("_lettered"))
        .select(
            *kept,
            F.when(F.col("_lettered"), F.col("_scored.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
            F.when(F.col("_lettered"), F.col("_scored.score")).otherwise(0.0).alias("score"),
            F.when(F.col("_lettered"), F.col("_scored.bits_per_byte")).otherwise(0.0).alias("bits_per_byte"),
        )
    )


def held_out():
    """Rows that no model may learn from: crc32 of the id's decimal digits divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
