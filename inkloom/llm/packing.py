"""Packing into optimal length buckets.

The histogram of all documents' token counts is dealt into at most ``buckets`` length
buckets whose upper bounds minimise the padding of all documents, by dynamic
programming.  Documents of a bucket then form batches of at most ``budget`` padded tokens.

Only the histogram reaches the driver.  Lengths above ``EXACT`` share a bin with those
of the same ten leading bits, so it has at most ``EXACT`` plus 512 bins per doubling,
whatever the corpus; sums and the longest document of a bin stay exact.  A bucket ends at the
longest document of a bin, so above ``EXACT`` its bound is at most 0.2 % above the best one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import checkpointed

#: Length buckets, and padded tokens of one batch.
BUCKETS = 16
BUDGET = 65_536
#: Lengths up to this have a bin each.
EXACT = 1024
#: Documents of a bucket that one task sorts into batches, in expectation.
SHARD_DOCS = 50_000
#: A token: a run of letters, digits and underscores, or any other character that is no space.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _bin(length: Column) -> Column:
    """Largest length of the bin that holds ``length``."""
    grain = F.shiftright(length - 1, 9).cast("long")
    step = F.when(length <= EXACT, F.lit(1).cast("long")).otherwise(
        F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(grain, F.lit(1)).cast("double")))).cast("long")
    )
    return F.ceil(length / step) * step


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding.

    ``lengths`` ascends; ``counts`` and ``sums`` are documents and tokens per bin.  With
    the first i bins packed, one more bucket up to bin j adds ``lengths[j]`` per document
    less its tokens; every row of the table takes the minimum over i at once.
    """
    n = len(lengths)
    if not n:
        return []
    docs, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        next_best, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < next_best[j]:
                next_best[j], cut[j] = cost[i], i
        best = next_best
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(bounds)


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, shard, batch, slot) for every row of ``docs``.

    ``length`` counts the tokens of a row (default: words and marks of ``text``).  A bucket
    pads to ``bucket_length``; a batch has at most ``budget // bucket_length`` documents, at
    least one.  Null and empty texts have no tokens; they are in the first bucket.
    Documents are dealt to the shards of a bucket by a hash of the id, so a bucket with
    any share of the corpus is spread, with one partial batch per shard.  Rows that
    repeat are packed each.
    """
    counted = docs.select("doc_id", (token_count(F.col("text")) if length is None else length).alias("n_tokens"))
    counted = counted.withColumn("_bin", F.when(F.col("n_tokens") > 0, _bin(F.col("n_tokens"))).otherwise(F.lit(0).cast("long")))
    counted = checkpointed(counted)  # ids and numbers only; texts are counted once
    histogram = (
        counted.groupBy("_bin")
        .agg(F.greatest(F.max("n_tokens"), F.lit(0)).alias("longest"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
        .orderBy("_bin")
        .collect()  # bounded by the bins
    )
    bins, lengths, n_docs, tokens = (np.array([r[k] for r in histogram], np.int64) for k in range(4))
    bounds = optimal_bounds(lengths, n_docs, tokens, buckets)
    names = ["bucket", "bucket_length", "shard", "batch", "slot"]
    if not bounds:
        return counted.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in names])
    inside = np.searchsorted(bounds, lengths)
    shards = [max(1, -(-int(n_docs[inside == b].sum()) // shard_docs)) for b in range(len(bounds))]
    last_bins = bins[np.searchsorted(lengths, bounds)].tolist()
    bucket = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("_bin") <= last_bins[b], F.lit(b)).otherwise(bucket)
    per_bucket = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    placed = counted.withColumn("bucket", bucket)
    placed = placed.select(
        "doc_id",
        "n_tokens",
        F.col("bucket"),
        per_bucket(bounds).alias("bucket_length"),
        per_bucket([max(1, budget // max(1, b)) for b in bounds]).alias("_room"),
        F.pmod(F.xxhash64("doc_id"), per_bucket(shards)).alias("shard"),
    )
    place = F.row_number().over(
        Window.partitionBy("bucket", "shard").orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id", "n_tokens")
    )
    return placed.withColumn("_place", (place - 1).cast("long")).select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        "bucket_length",
        "shard",
        F.floor(F.col("_place") / F.col("_room")).alias("batch"),
        F.pmod("_place", F.col("_room")).alias("slot"),
    )
