"""Order-dependent selections that stay exact at any group size.

* ``greedy_keep``: go through items in rank order, keep one unless it conflicts
  with a kept one (suppression, duplicate rejection).
* ``greedy_match``: go through pairs in rank order, accept one if both sides are
  still free (one-to-one matching).
* ``greedy_claim``: the same from the two tables, of which each row is shuffled once.

An ordinary group is folded inside the JVM over one sorted array.  A larger group
is settled in rounds of joins: an item (or pair) that no better undecided one
touches is decided at once, which gives the same result as the sequential pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import FIELDS, Box, let
from inkloom.scale import ARRAY_GROUP_LIMIT, group_keys, hot_groups, split_hot, top_rows
from inkloom.session import materialize


def greedy_keep(
    items: DataFrame,
    by: Sequence[str],
    key: str,
    rank: Sequence[Column],
    conflict: Callable[[Box, Box], Column],
    pairs_of: Callable[..., DataFrame],
    limit: int = ARRAY_GROUP_LIMIT,
    copies_conflict: bool = False,
    keep: int | None = None,
) -> DataFrame:
    """Rows of ``items`` that survive, the first ``keep`` of each group when given.

    ``rank`` must be a total order within a group.

    ``pairs_of(left, right, by, limit=…)`` finds boxes that share area; a conflict
    implies shared area.  With ``copies_conflict`` exact copies of a box exclude each
    other, so only the best copy takes part.
    """
    cold, hot = split_hot(items, by, hot_groups(items, by, limit))
    # the array carries whole rows, so survivors come out of it without a join back
    entry = F.struct(*rank, F.col(key).alias("key"), F.struct(*items.columns).alias("row"))
    listed = cold.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_all"))

    def step(kept: Column, item: Column) -> Column:
        clash = F.exists(kept, lambda k: conflict(Box.struct(item["row"]), Box.struct(k["row"])))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(item)))

    folded = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.slice("_all", 1, 1), step)
    if keep is not None:
        folded = F.slice(folded, 1, keep)  # the fold keeps rank order, so no second shuffle is needed
    survivors = listed.select(F.explode(folded).alias("_e")).select("_e.row.*")
    if hot is None:
        return survivors
    settled = _keep_in_rounds(hot, by, key, rank, conflict, pairs_of, copies_conflict)
    if keep is not None:
        settled = top_rows(settled, by, rank, keep).drop("_rank")
    return survivors.unionByName(settled)


def _keep_in_rounds(items, by, key, rank, conflict, pairs_of, copies_conflict) -> DataFrame:
    nodes = items.select(*by, key, F.struct(*rank).alias("_rank"), *FIELDS)
    if copies_conflict:
        nodes = nodes.groupBy(*by, *FIELDS).agg(F.min(F.struct("_rank", key)).alias("_best")).select(
            *by, F.col(f"_best.{key}").alias(key), F.col("_best._rank").alias("_rank"), *FIELDS
        )
    nodes = materialize(nodes)
    met = pairs_of(nodes, nodes, by, limit=0, extra=lambda p: F.col("a__rank") < F.col("b__rank"))
    edges = met.where(conflict(Box.columns("a_"), Box.columns("b_"))).select(
        *by, F.col(f"a_{key}").alias("_hi"), F.col(f"b_{key}").alias("_lo")
    )
    edges = materialize(edges)
    open_ids = nodes.select(*by, key)
    kept = None
    while True:
        blocked = edges.select(*by, F.col("_lo").alias(key)).distinct()
        free = materialize(open_ids.join(blocked, [*by, key], "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        losers = edges.join(free.withColumnRenamed(key, "_hi"), [*by, "_hi"], "left_semi")
        losers = materialize(losers.select(*by, F.col("_lo").alias(key)).distinct())
        open_ids = open_ids.join(free, [*by, key], "left_anti").join(losers, [*by, key], "left_anti")
        open_ids = materialize(open_ids)
        if open_ids.isEmpty():
            break
        edges = edges.join(open_ids.withColumnRenamed(key, "_hi"), [*by, "_hi"], "left_semi")
        edges = materialize(edges.join(open_ids.withColumnRenamed(key, "_lo"), [*by, "_lo"], "left_semi"))
    return items.join(kept, [*by, key], "left_semi")


#: Pairs of one group that are folded in one array, as a multiple of its limit of rows.
PAIRS_PER_ROW = 8


def _accepted(ordered: Column) -> Column:
    """The pairs (structs with ``l`` and ``r``) of an ordered array whose sides no earlier accepted pair uses."""

    def step(done: Column, pair: Column) -> Column:
        used = F.exists(done, lambda d: (d["l"] == pair["l"]) | (d["r"] == pair["r"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(pair)))

    return let(ordered, lambda pairs: F.aggregate(F.slice(pairs, F.lit(2), F.size(pairs)), F.slice(pairs, 1, 1), step))


def greedy_match(
    pairs: DataFrame,
    by: Sequence[str],
    left: str,
    right: str,
    rank: Sequence[str],
    limit: int = ARRAY_GROUP_LIMIT,
) -> DataFrame:
    """Accepted (group, left, right) pairs; ``rank`` columns must be a total order of the pairs of a group."""
    # a lazy plan that decides which groups fold and which go in rounds reads the pairs more than once
    pairs = materialize(pairs.select(*by, left, right, *rank))
    cold, hot = split_hot(pairs, by, hot_groups(pairs, by, limit * PAIRS_PER_ROW))
    entry = F.struct(*rank, F.col(left).alias("l"), F.col(right).alias("r"))
    listed = cold.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    folded = _accepted(F.col("_all"))
    chosen = listed.select(*by, F.explode(folded).alias("_p")).select(
        *by, F.col("_p.l").alias(left), F.col("_p.r").alias(right)
    )
    if hot is None:
        return chosen
    remaining = materialize(hot.select(*by, left, right, F.struct(*rank).alias("_rank")))
    accepted = None
    while not remaining.isEmpty():
        best_left = remaining.groupBy(*by, left).agg(F.min("_rank").alias("_rank"))
        best_right = remaining.groupBy(*by, right).agg(F.min("_rank").alias("_rank"))
        leading = remaining.join(best_left, [*by, left, "_rank"], "left_semi")
        leading = materialize(leading.join(best_right, [*by, right, "_rank"], "left_semi").select(*by, left, right))
        accepted = leading if accepted is None else accepted.unionByName(leading)
        remaining = remaining.join(leading.select(*by, left), [*by, left], "left_anti")
        remaining = materialize(remaining.join(leading.select(*by, right), [*by, right], "left_anti"))
    return chosen.unionByName(accepted)


def greedy_claim(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_id: str,
    right_id: str,
    score: Callable[[Column, Column], Column],
    counts: Callable[[Column, Column, Column], Column],
    rank: Callable[[Column, Column, Column], Sequence[Column]],
    pairs_of: Callable[[DataFrame, DataFrame], DataFrame],
    limit: int = ARRAY_GROUP_LIMIT,
) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` it claims: ``by`` and the structs ``_l`` and ``_r`` of their other columns.

    ``_r`` is null where nothing is claimed.  Pairs are gone through in the order of
    ``rank(score, a, b)``, a total order of the pairs of a group, and accepted if both
    sides are still free; only pairs with ``counts(score, a, b)`` take part.

    An ordinary group is matched inside the arrays of its two sides.  A group with more than
    ``limit`` rows, or too many possible pairs for one array, goes through
    ``pairs_of(left, right)`` (``by`` and the structs ``_a`` and ``_b``) and ``greedy_match``.
    """
    known = reduce(and_, [F.col(c).isNotNull() for c in by])
    right = right.where(known)
    sides = left.where(known).select(*by, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        right.select(*by, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sizes = sides.groupBy(*by).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    large = (F.col("_a") + F.col("_b") > limit) | (F.col("_a") * F.col("_b") > limit * PAIRS_PER_ROW)
    crowded = group_keys(sizes.where(large).select(*by))
    cold_left, hot_left = split_hot(left, by, crowded)
    cold_right, hot_right = split_hot(right, by, crowded)

    own_l, own_r = [F.struct(*[c for c in df.columns if c not in by]) for df in (left, right)]
    # rows without a group claim nothing; their ids keep them from meeting in one group
    lone = F.when(~known, F.col(left_id)).alias("_lone")
    l_rows = cold_left.select(*by, lone, own_l.alias("_l"))
    r_rows = cold_right.select(*by, own_r.alias("_r"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True).repartition(*by, "_lone")
    listed = rows.groupBy(*by, "_lone").agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))

    def pairs(a: Column) -> Column:
        scored = F.transform("_rs", lambda b: F.struct(score(a, b).alias("s"), b.alias("b")))
        met = F.filter(scored, lambda p: counts(p["s"], a, p["b"]))
        return F.transform(
            met,
            lambda p: F.struct(
                *[c.alias(f"r{i}") for i, c in enumerate(rank(p["s"], a, p["b"]))], a[left_id].alias("l"), p["b"][right_id].alias("r")
            ),
        )

    def claimed(done: Column, a: Column) -> Column:
        mine = F.filter("_rs", lambda b: F.exists(done, lambda d: (d["l"] == a[left_id]) & (d["r"] == b[right_id])))
        none = F.array(F.struct(a.alias("_l"), F.lit(None).cast(r_rows.schema["_r"].dataType).alias("_r")))
        both = lambda found: F.transform(found, lambda b: F.struct(a.alias("_l"), b.alias("_r")))
        return let(mine, lambda found: F.when(F.size(found) == 0, none).otherwise(both(found)))

    ordered = F.array_sort(F.flatten(F.transform("_ls", pairs)))
    whole = let(_accepted(ordered), lambda done: F.flatten(F.transform("_ls", lambda a: claimed(done, a))))
    out = listed.select(*by, F.explode(whole).alias("_e")).select(*by, "_e._l", "_e._r")
    if crowded is None:
        return out
    a, b, s = F.col("_a"), F.col("_b"), F.col("_s")
    met = pairs_of(hot_left, hot_right).withColumn("_s", score(a, b)).where(counts(s, a, b))
    order = [c.alias(f"r{i}") for i, c in enumerate(rank(s, a, b))]
    ranked = met.select(*by, a[left_id].alias("_li"), b[right_id].alias("_ri"), *order)
    matches = greedy_match(ranked, by, "_li", "_ri", [f"r{i}" for i in range(len(order))], limit=limit)
    found = matches.join(hot_right.select(*by, F.col(right_id).alias("_ri"), own_r.alias("_r")), [*by, "_ri"])
    joined = hot_left.select(*by, F.col(left_id).alias("_li"), own_l.alias("_l")).join(found, [*by, "_li"], "left")
    return out.unionByName(joined.select(*by, "_l", "_r"))
