"""Order-dependent merging of regions that show or repeat the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box, let
from inkloom.functions.text import characters, compact, multiset_overlap
from inkloom.operators.grouping import connected_labels
from inkloom.operators.spatial import near_pairs
from inkloom.scale import ARRAY_GROUP_LIMIT, hot_groups, split_hot
from inkloom.session import materialize

ECHO_LENGTH, ECHO_SHARE = 4, 0.7


def _same(a: Column, b: Column) -> Column:
    ratio = Box.struct(a).coverage(Box.struct(b))
    equal = (a["key"] != "") & (a["key"] == b["key"])
    return (ratio >= 0.82) | (equal & (ratio >= 0.25))


def _echo(a: Column, b: Column) -> Column:
    """One side unframed, both long enough, and nearly the same letters."""
    long_enough = (F.length(a["key"]) >= ECHO_LENGTH) & (F.length(b["key"]) >= ECHO_LENGTH)
    return (~a["framed"] | ~b["framed"]) & long_enough & (multiset_overlap(a["key"], b["key"]) >= ECHO_SHARE)


def _merge(kept: Column, new: Column) -> Column:
    area = lambda r: r["width"] * r["height"]
    keep_first = F.when(kept["framed"] != new["framed"], kept["framed"]).otherwise(area(kept) <= area(new))
    ordered = F.when(keep_first, F.array(kept, new)).otherwise(F.array(new, kept))

    def settle(pair: Column) -> Column:
        winner, other = pair[0], pair[1]
        direction = F.when(winner["direction"] == "automatic", other["direction"]).otherwise(winner["direction"])
        best = F.greatest(winner["confidence"], other["confidence"])
        return winner.withField("confidence", best).withField("direction", direction)

    return let(ordered, settle)


def _echo_candidates(rows: DataFrame) -> DataFrame:
    """Links between regions of a page that can be echoes: pairs of texts, and every region with the first one of its text.

    Equal texts are compared once, whatever the number of regions that show them.  Other
    texts meet by prefix filtering on letters: the shorter one must share 70 % of its
    letters, so one of its rarest letters (all but 70 %, plus one) must occur in the other.
    """
    long = rows.where(F.length("key") >= ECHO_LENGTH)
    # a text counts as unframed when one of its regions is: that can only add links
    texts = long.groupBy("page_id", "key").agg(F.min("region_id").alias("region_id"), F.bool_and("framed").alias("framed"))
    texts = materialize(texts)
    letters = texts.select("page_id", "region_id", "key", "framed", F.explode(F.array_distinct(characters(F.col("key")))).alias("c"))
    rarity = letters.groupBy("page_id", "c").agg(F.count(F.lit(1)).alias("_f"))
    ranked = letters.join(rarity, ["page_id", "c"]).groupBy("page_id", "region_id", "key", "framed").agg(
        F.array_sort(F.collect_list(F.struct("_f", "c"))).alias("_order")
    )
    repeats = lambda e: F.length("key") - F.length(F.replace(F.col("key"), e["c"], F.lit("")))
    need = F.length("key") - F.ceil(F.length("key") * ECHO_SHARE) + 1
    # letters are taken until their occurrences reach the prefix length
    running = F.transform(
        "_order", lambda e, i: F.struct(e["c"].alias("c"), F.aggregate(F.slice("_order", F.lit(1), i), F.lit(0), lambda s, x: s + repeats(x)).alias("before"))
    )
    prefix = ranked.select("page_id", "region_id", "key", "framed", F.explode(F.filter(running, lambda e: e["before"] < need)).alias("e"))
    probe = prefix.select("page_id", F.col("e.c").alias("c"), F.struct("region_id", "key", "framed").alias("a"))
    build = letters.select("page_id", "c", F.struct("region_id", "key", "framed").alias("b"))
    pairs = (
        probe.join(build, ["page_id", "c"])
        .where((F.col("a.region_id") != F.col("b.region_id")) & (F.length("a.key") <= F.length("b.key")))
        .where(_echo(F.col("a"), F.col("b")))
        .select("page_id", F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b"))
        .distinct()
    )
    first = texts.select("page_id", "key", F.col("region_id").alias("a"))
    equal = long.select("page_id", "key", F.col("region_id").alias("b")).join(first, ["page_id", "key"]).where(F.col("a") != F.col("b"))
    return pairs.unionByName(equal.select("page_id", "a", "b"))


def dedupe_regions(regions: DataFrame, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Merge each region into the first kept one of its page that is a duplicate or an echo.

    ``regions(page_id, region_id, ord, x, y, width, height, source_text, framed,
    confidence, direction)``.  A merge keeps one of the two originals (the framed one,
    else the smaller), so who can ever merge is decided by pairs of originals: a page
    above ``limit`` is cut into the connected parts of those pairs, which are folded
    independently with the same result.
    """
    rows = regions.withColumn("key", compact(F.col("source_text"))).withColumn("_part", F.lit(""))
    cold, hot = split_hot(rows, ["page_id"], hot_groups(regions, ["page_id"], limit))
    if hot is not None:
        hot = materialize(hot)
        met = near_pairs(hot, hot, ["page_id"], limit=0, extra=lambda p: F.col("a_region_id") < F.col("b_region_id"))
        side = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("x", "y", "width", "height", "key")])
        close = met.where(_same(side("a"), side("b"))).select(
            "page_id", F.col("a_region_id").alias("a"), F.col("b_region_id").alias("b")
        )
        labels = connected_labels(hot, close.unionByName(_echo_candidates(hot)), ["page_id"], "region_id")
        parted = hot.drop("_part").join(labels.withColumnRenamed("label", "_part"), ["page_id", "region_id"])
        cold = cold.unionByName(parted.select(*cold.columns))
    fields = ["ord", "region_id", "x", "y", "width", "height", "source_text", "key", "framed", "confidence", "direction"]
    listed = cold.groupBy("page_id", "_part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"))

    def step(kept: Column, item: Column) -> Column:
        def place(match: Column) -> Column:
            merged = F.transform(kept, lambda k, i: F.when(i + 1 == match, _merge(k, item)).otherwise(k))
            return F.when(match == 0, F.concat(kept, F.array(item))).otherwise(merged)

        return let(F.array_position(F.transform(kept, lambda k: _same(k, item) | _echo(k, item)), F.lit(True)), place)

    folded = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.slice("_all", 1, 1), step)
    return listed.select("page_id", F.explode(folded).alias("r")).select("page_id", "r.*").drop("key")
