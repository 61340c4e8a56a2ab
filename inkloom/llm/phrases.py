"""Phrases whose words stand together more often than their parts suggest, per language.

A suffix is a pointer to a word and the words that follow it in its piece, to a depth of
four words.  Words below the least count are settled first, by one count of all words;
suffixes end before them.  The others are routed over the cluster by their two leading
words, so that all suffixes of a phrase meet in one task, which sorts them by multikey
three-way quicksort: pointers are split into those with a smaller, an equal and a larger
word at the present depth, and the equal ones go on with their next word.  The size of an
equal partition is the count of its phrase; partitions below the least count are abandoned.

Suffixes travel as compressed blocks of word numbers (the rank of a frequent word; digests
where there are too many frequent words to send), equal ones of a task as one with a count.  A route that outgrows its task is routed again by further bits of the leading
words; two words that outgrow a task by themselves are counted in pieces, whose partial
counts Spark adds up.  Scores, containment and ranks are joins and aggregates.

Words are told apart by 64-bit digests; should two words ever share one, the count of words
notices it and the operator fails instead of giving a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.blocks import Block, KeyIndex, mix, task_count, text_blocks, words
from inkloom.scale import top_rows
from inkloom.session import materialize, release

#: Words of the longest phrase.
DEPTH = 4
LEAST = 30
#: Share of a phrase's occurrences, in percent, that lie inside one longer phrase and make it part of that.
COVERED = 80
KEEP = 2000
UNDETERMINED = "und"
#: Suffixes of one route, on average, and routes of one pass; a route above ``LARGE`` times the average is divided again.
ROUTE_SUFFIXES = 500_000
MAX_ROUTES = 4096
LARGE = 3
#: Suffixes that any task can hold: no smaller route is divided.
UNDIVIDED = 4096
#: Suffixes that a task gathers before it sends them, and rows of words that it gathers.
HELD = 1 << 20
#: Frequent words that are sent to every task (8 bytes each); above, words are their digests and rare ones are not cut off.
SENT_WORDS = 2_000_000

_BLANK = [9, 32]
_PIECE_END = [*b".,;:!?", *range(10, 14)]
_MEMBER = np.ones(256, bool)
_MEMBER[_BLANK + _PIECE_END] = False
_ENDS = np.zeros(256, bool)
_ENDS[_PIECE_END] = True

COUNTED = "lang string, word string, digest long, n long"
SENT = "route int, sub int, suffixes long, distinct long, block binary"
FOUND = "words array<long>, n long"


def _tags(langs: pa.Array) -> np.ndarray:
    """A 64-bit value per row that tells its language."""
    coded = pc.dictionary_encode(langs)
    values = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in coded.dictionary.to_pylist()]
    return np.array(values, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def _block_words(block: Block, tags: np.ndarray):
    """Words of a block, their digests with the language in them (never 0), and whether each is in one piece with the next."""
    found = words(block, _MEMBER)
    digests = mix(found.digests ^ tags[block.first + found.rows])
    digests[digests == 0] = 1
    pieces = np.concatenate(([0], np.cumsum(_ENDS[block.data])))[found.starts]
    joined = np.zeros(len(digests), bool)
    if len(digests):
        joined[:-1] = (pieces[1:] == pieces[:-1]) & (found.rows[1:] == found.rows[:-1])
    return found, digests, joined


def _texts_at(block: Block, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings, lower-cased for A-Z."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = block.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of ``(text, lang)`` rows with their counts, summed inside the task."""
    held: list[pa.Table] = []
    names = ["lang", "word", "digest", "n"]

    def merged() -> pa.Table:
        summed = pa.concat_tables(held).group_by(["lang", "word", "digest"]).aggregate([("n", "sum")])
        return summed.select(["lang", "word", "digest", "n_sum"]).rename_columns(names)

    for batch in batches:
        langs, tags = batch.column(1), _tags(batch.column(1))
        for block in text_blocks(batch.column(0)):
            found, digests, _ = _block_words(block, tags)
            keys, first, n = np.unique(digests, return_index=True, return_counts=True)
            told = langs.take(pa.array(block.first + found.rows[first]))
            texts = _texts_at(block, found.starts[first], found.ends[first])
            held.append(pa.table([told, texts, pa.array(keys.view(np.int64)), pa.array(n)], names))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from merged().to_batches()


def count_words(texts: DataFrame) -> DataFrame:
    """(digest, word, lang, n) of every distinct word per language of ``texts(text, lang)``."""
    counted = texts.mapInArrow(_counted, COUNTED).groupBy("digest").agg(
        F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("_word"),
        F.min("lang").alias("lang"), F.max("lang").alias("_lang"),
    )
    return materialize(counted)


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of two words and more with at least ``least`` occurrences: (pointer to one, depth, count).

    ``keys[d]`` holds word ``d`` of every suffix, 0 after its end; ``weights`` how often it
    occurs.  All open partitions are split side by side, each by the word of a random
    member, into smaller, equal and larger; ``pointers`` always holds the open partitions
    one after the other.
    """
    depth, rows = keys.shape
    flat = keys.ravel()
    rng = np.random.default_rng(rows)
    pointers = np.arange(rows)
    sizes, at_depth = np.array([rows]), np.array([0])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointers):
        parts = len(sizes)
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(parts), sizes)
        word = flat[at_depth[part] * rows + pointers]
        pivot = word[starts + (rng.random(parts) * sizes).astype(np.int64)]
        side = (word >= pivot[part]).astype(np.int64) + (word > pivot[part])
        # every pointer moves to the place of its side in its partition, in order
        slot = 3 * part + side
        count = np.bincount(slot, minlength=3 * parts)
        begin = np.cumsum(count) - count
        moved = np.empty_like(pointers)
        for s in range(3):
            own = np.flatnonzero(side == s)
            share = count[s::3]
            moved[begin[s::3][part[own]] + np.arange(len(own)) - (np.cumsum(share) - share)[part[own]]] = pointers[own]
        weight = np.bincount(slot, weights[pointers], 3 * parts).astype(np.int64)
        deeper = np.repeat(at_depth, 3)
        deeper[1::3] += 1
        ended = np.zeros(3 * parts, bool)
        ended[1::3] = pivot == 0  # suffixes that are over before this depth
        going = (count > 0) & (weight >= least) & ~ended
        told = going & (deeper >= 2)
        told[0::3] = told[2::3] = False
        out.append((moved[begin[told]], deeper[told], weight[told]))
        going &= deeper < depth
        pointers = moved[np.repeat(going, count)]
        sizes, at_depth = count[going], deeper[going]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _leading(keys: np.ndarray) -> np.ndarray:
    """A hash of the two leading words."""
    return mix(keys[0].astype(np.uint64) + mix(keys[1]))


def _packed(keys: np.ndarray, weights: np.ndarray, route: np.ndarray, sub: np.ndarray) -> pa.RecordBatch:
    """One compressed block for every (route, sub); the rows are sorted by them."""
    edge = np.flatnonzero(np.concatenate(([True], (route[1:] != route[:-1]) | (sub[1:] != sub[:-1]))))
    ends = np.append(edge[1:], len(route))
    blocks = []
    for a, b in zip(edge, ends):
        blocks.append(pa.compress(_planes(keys[:, a:b]) + _planes(weights[a:b].astype(np.uint32)), "zstd", asbytes=True))
    suffixes = np.add.reduceat(weights, edge)
    columns = [route[edge].astype(np.int32), sub[edge].astype(np.int32), suffixes.astype(np.int64), (ends - edge).astype(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blocks, pa.binary())], ["route", "sub", "suffixes", "distinct", "block"])


def _planes(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then the second ones, and so on: they compress far better apart."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unpacked(kind: type, distinct: pa.Array, blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys, weights = [np.zeros((DEPTH, 0), kind)], [np.zeros(0, np.int64)]
    for n, block in zip(distinct.to_pylist(), blocks):
        edge = DEPTH * n * np.dtype(kind).itemsize
        raw = pa.decompress(block.as_buffer(), edge + 4 * n, "zstd", asbytes=True)
        keys.append(_from_planes(raw[:edge], kind).reshape(DEPTH, n))
        weights.append(_from_planes(raw[edge:], np.uint32).astype(np.int64))
    return np.concatenate(keys, axis=1), np.concatenate(weights)


def _merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes as one with the sum of their weights, sorted by the hash of their leading words, and that hash."""
    lead = _leading(keys)
    order = np.lexsort((mix(keys[2].astype(np.uint64) + mix(keys[3])), lead))
    keys, lead, weights = keys[:, order], lead[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    return keys[:, new], np.add.reduceat(weights, new), lead[new]


def _route_suffixes(frequent, routes: int):
    """Blocks of the suffixes of ``(text, lang)`` rows, by route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if frequent is None else KeyIndex(frequent.value)
        held, rows = [], 0

        def sent() -> pa.RecordBatch:
            keys, weights, lead = _merged(np.concatenate(held, axis=1), np.ones(rows, np.int64))
            route = ((lead >> np.uint64(32)) * np.uint64(routes) >> np.uint64(32)).astype(np.int64)
            return _packed(keys, weights, route, np.zeros_like(route))

        for batch in batches:
            tags = _tags(batch.column(1))
            for block in text_blocks(batch.column(0)):
                _, digests, joined = _block_words(block, tags)
                if index is not None:
                    digests = (index.find(digests) + 1).astype(np.uint32)  # 0: a rare word
                    joined[:-1] &= (digests[:-1] > 0) & (digests[1:] > 0)
                suffixes = _suffixes(digests, joined)
                held.append(suffixes)
                rows += suffixes.shape[1]
                if rows > HELD:
                    yield sent()
                    held, rows = [], 0
        if rows:
            yield sent()

    return run


def _suffixes(digests: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """``DEPTH`` words from every word that has a next one, 0 after the end of the piece."""
    start = np.flatnonzero(joined)
    out = np.zeros((DEPTH, len(start)), digests.dtype)
    out[0] = digests[start]
    on = np.ones(len(start), bool)
    for d in range(1, DEPTH):
        on &= joined[np.minimum(start + d - 1, len(joined) - 1)]
        out[d, on] = digests[start[on] + d]
    return out


def _divide(kind: type, parts: int):
    """Blocks of a route as blocks of its ``parts`` sub-routes; rows are sorted by route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, rows = [], None, 0

        def sent() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held], axis=1)
            keys, weights, lead = _merged(keys, np.concatenate([w for _, w in held]))
            sub = ((lead & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            return _packed(keys[:, order], weights[order], np.full(len(sub), now), sub[order])

        for batch in batches:
            for i, route in enumerate(batch.column("route").to_pylist()):
                if held and (route != now or rows > HELD):
                    yield sent()
                    held, rows = [], 0
                now = route
                held.append(_unpacked(kind, batch.column("distinct")[i : i + 1], batch.column("block")[i : i + 1]))
                rows += held[-1][0].shape[1]
        if held:
            yield sent()

    return run


def _phrases(keys: np.ndarray, weights: np.ndarray, least: int, frequent) -> pa.Table:
    """Phrases of the suffixes as digests of their words."""
    pointers, depth, count = equal_partitions(keys, weights, least)
    parts = [pa.array([], pa.list_(pa.int64()))]
    order = np.argsort(depth, kind="stable")
    for d in range(2, DEPTH + 1):
        own = np.ascontiguousarray(keys[:d, pointers[order][depth[order] == d]].T)
        flat = (own if frequent is None else frequent.value[own - 1]).astype(np.uint64).view(np.int64).ravel()
        parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), pa.array(flat)))
    return pa.table([pa.concat_arrays(parts), pa.array(count[order], pa.int64())], ["words", "n"])


def _of_route(kind: type, least: int, frequent):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        return _phrases(*_unpacked(kind, rows.column("distinct"), rows.column("block").combine_chunks()), least, frequent)

    return run


def _in_pieces(kind: type, frequent):
    """Partial counts of all phrases of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, weights = _unpacked(kind, batch.column("distinct")[i : i + 1], batch.column("block")[i : i + 1])
                yield from _phrases(keys, weights, 1, frequent).to_batches()

    return run


def count_phrases(texts: DataFrame, frequent, total: int, least: int = LEAST) -> DataFrame:
    """(words, n): digests of the words of every phrase of 2 to ``DEPTH`` words with at least ``least`` occurrences.

    ``frequent`` is a broadcast array of the digests of words with that count, the most
    frequent first, or None; ``total`` the number of all words, from which the number of
    routes follows.
    """
    kind = np.uint64 if frequent is None else np.uint32
    spark = texts.sparkSession
    routes = min(max(-(-total // ROUTE_SUFFIXES), task_count(spark)), MAX_ROUTES)
    most = max(LARGE * total // routes, UNDIVIDED)
    key = ["route", "sub"]
    sent = materialize(texts.mapInArrow(_route_suffixes(frequent, routes), SENT))
    sizes = sent.groupBy("route").agg(F.sum("distinct").alias("held"))
    large = [(r["route"], r["held"]) for r in sizes.where(F.col("held") > most).collect()]  # at most MAX_ROUTES
    fits = sent.where(~F.col("route").isin([r for r, _ in large])) if large else sent
    found = [fits.groupBy(*key).applyInArrow(_of_route(kind, least, frequent), FOUND)]
    if large:
        parts = min(-(-max(n for _, n in large) // min(ROUTE_SUFFIXES, most)), MAX_ROUTES)
        spread = sent.where(F.col("route").isin([r for r, _ in large])).repartition(
            task_count(spark), "route", F.pmod(F.xxhash64("block"), F.lit(16))
        )
        again = materialize(spread.sortWithinPartitions("route").mapInArrow(_divide(kind, parts), SENT))
        sizes = again.groupBy(*key).agg(F.sum("distinct").alias("held")).withColumn("hot", F.col("held") > most)
        marked = again.join(sizes.select(*key, "hot"), key)
        found.append(marked.where(~F.col("hot")).drop("hot").groupBy(*key).applyInArrow(_of_route(kind, least, frequent), FOUND))
        pieces = marked.where("hot").select(*again.columns).mapInArrow(_in_pieces(kind, frequent), FOUND)
        found.append(pieces.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = materialize(out)
    release(sent)
    return out


def scored(phrases: DataFrame, units: DataFrame) -> DataFrame:
    """(words, a, l, r, score) of every phrase by its weakest cut; ``units(words, n)`` are the single words."""
    counts = phrases.unionByName(units)
    size = F.size("words")
    cut = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("tail"))
    heads = counts.select(F.col("words").alias("head"), F.col("n").alias("l"))
    tails = counts.select(F.col("words").alias("tail"), F.col("n").alias("r"))
    both = cut.join(heads, "head").join(tails, "tail")
    # products may pass 64 bits
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = both.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("words", "a", "b.l", "b.r", "b.score")


def uncovered(rows: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """``rows(words, a, …)`` without those that a longer phrase holds in at least ``covered`` percent of their occurrences."""
    size = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda p: F.slice("words", p, n)),
        )
    )
    held = phrases.where(size > 2).select(F.explode(inner).alias("words"), "n").groupBy("words").agg(F.max("n").alias("_held"))
    kept = 100 * F.coalesce("_held", F.lit(0)) < covered * F.col("a")
    return rows.join(held, "words", "left").where(kept).drop("_held")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``keep`` phrases of every language.

    Every row counts, repeated ones too.  A null text is empty, a null language ``und``;
    a language without a frequent phrase has no row, an empty table none.  Equal scores
    go to the more frequent phrase, then to the smaller one in byte order.  Other columns
    take no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UNDETERMINED)).alias("lang"))
    counted = count_words(texts)
    usual = F.count_if(F.col("n") >= least).alias("usual")
    shared = F.count_if((F.col("word") != F.col("_word")) | (F.col("lang") != F.col("_lang"))).alias("shared")
    whole = counted.agg(F.sum("n").alias("total"), usual, shared).first()
    if whole["shared"]:
        raise RuntimeError("two words have one digest")
    frequent = counted.where(F.col("n") >= least)
    sent = None
    if whole["usual"] <= SENT_WORDS:
        sent = spark.sparkContext.broadcast(frequent.orderBy(F.desc("n"), "digest").select("digest").toArrow().column("digest").to_numpy().view(np.uint64))
    phrases = count_phrases(texts, sent, whole["total"] or 0, least)
    units = frequent.select(F.array("digest").alias("words"), "n")
    rows = uncovered(scored(phrases, units), phrases, covered)
    named = rows.select("*", F.posexplode("words").alias("pos", "digest")).join(frequent.select("digest", "word", "lang"), "digest")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    told = named.groupBy("words", "a", "l", "r", "score").agg(spelled.alias("phrase"), F.min("lang").alias("lang")).drop("words")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_rows(told, ["lang"], order, keep, "rank")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
