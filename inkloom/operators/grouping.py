"""Text-line and glyph grouping as connected components, group summaries and direction votes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box, clip01, let
from inkloom.operators.spatial import near_pairs
from inkloom.scale import ARRAY_GROUP_LIMIT, WINDOW_GROUP_LIMIT, hot_groups, ranked_values, split_hot, top_rows
from inkloom.session import materialize, release


def connected_labels(nodes: DataFrame, edges: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Smallest reachable ``key`` per node as ``label``, by rounds of neighbour minimum and pointer jumping.

    ``edges`` has columns ``by``, ``a``, ``b``.  Every round is written out, so a lost
    executor repeats one round at most; minima combine on the map side, so a node
    with many edges is no bottleneck.
    """
    both = materialize(
        edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = written = materialize(nodes.select(*by, key, F.col(key).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed(key, "b"), [*by, "b"]).groupBy(
            *by, F.col("a").alias(key)
        ).agg(F.min("label").alias("_near"))
        closer = labels.join(seen, [*by, key], "left").select(
            *by, key, "label", F.least(F.col("label"), F.coalesce("_near", "label")).alias("_new")
        )
        jump = closer.select(*by, F.col(key).alias("_new"), F.col("_new").alias("_jump"))
        moved = closer.join(jump, [*by, "_new"], "left").select(
            *by, key, "label", F.least(F.col("_new"), F.coalesce("_jump", "_new")).alias("_new")
        )
        moved = written = materialize(moved, instead_of=written)
        changed = not moved.where(F.col("_new") < F.col("label")).isEmpty()
        labels = moved.select(*by, key, F.col("_new").alias("label"))
        if not changed:
            release(both)
            return labels


def _blocks(items: DataFrame, by: Sequence[str], order: Sequence[str], linked: Callable[[Column, Column], Column], least: int = 1) -> DataFrame:
    """One row per block of at least ``least`` linked items: ``by`` and ``_b``, the array of its rows, first in ``order`` first.

    The growing blocks of a group merge in one JVM fold over its ordered items.
    """
    entry = F.struct(*order, *[c for c in items.columns if c not in (*by, *order)])
    listed = items.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_all")).where(F.size("_all") >= least)

    def step(blocks: Column, item: Column) -> Column:
        def tell(block: Column) -> Column:
            hit = F.exists(block, lambda member: linked(member, item))
            return F.struct(block.alias("b"), hit.alias("hit"))

        def join(told: Column) -> Column:
            of = lambda hit: F.transform(F.filter(told, lambda t: t["hit"] == hit), lambda t: t["b"])
            return F.concat(of(False), F.array(F.concat(F.flatten(of(True)), F.array(item))))

        return let(F.transform(blocks, tell), join)

    blocks = F.aggregate(
        F.slice("_all", F.lit(2), F.size("_all")), F.array(F.slice("_all", 1, 1)), step
    )
    return listed.select(*by, F.explode(F.filter(blocks, lambda b: F.size(b) >= least)).alias("_b"))


def _closure(
    items: DataFrame,
    by: Sequence[str],
    key: str,
    order: Sequence[str],
    linked: Callable[[Column, Column], Column],
    edges_of: Callable[[DataFrame], DataFrame],
    limit: int,
) -> DataFrame:
    """Add ``group_label`` (smallest member key) under the transitive closure of ``linked(earlier, later)``.

    Ordinary groups fold (``_blocks``); larger ones link through ``edges_of`` and ``connected_labels``.
    """
    cold, hot = split_hot(items, by, hot_groups(items, by, limit))
    # the array carries whole rows, so labels need no join back
    out = (
        _blocks(cold, by, order, linked)
        .select(*by, F.array_min(F.transform("_b", lambda m: m[key])).alias("group_label"), F.explode("_b").alias("_m"))
        .select(*[F.col(c) if c in by else F.col(f"_m.{c}") for c in items.columns], "group_label")
    )
    return out if hot is None else out.unionByName(_linked(hot, by, key, edges_of))


def _linked(hot: DataFrame, by: Sequence[str], key: str, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of large groups with their ``group_label``."""
    hot = materialize(hot)
    labels = connected_labels(hot, edges_of(hot), by, key).withColumnRenamed("label", "group_label")
    return hot.join(labels, [*by, key]).select(*hot.columns, "group_label")


def _span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shorter = F.least(a1 - a0, b1 - b0)
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def _span_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.greatest(a0, b0) - F.least(a1, b1), F.lit(0.0))


def same_text_block(a: Box, b: Box) -> Column:
    """Whether two text lines of one balloon belong together."""
    x_overlap = _span_overlap(a.x, a.right, b.x, b.right)
    y_overlap = _span_overlap(a.y, a.bottom, b.y, b.bottom)
    x_gap, y_gap = _span_gap(a.x, a.right, b.x, b.right), _span_gap(a.y, a.bottom, b.y, b.bottom)
    upright = (a.height >= a.width * 1.35) & (b.height >= b.width * 1.35)
    flat = (a.width >= a.height * 1.35) & (b.width >= b.height * 1.35)
    thick_x, thick_y = F.greatest(a.width, b.width), F.greatest(a.height, b.height)
    columns = ((y_overlap >= 0.52) & (x_gap <= thick_x * 1.75)) | ((x_overlap >= 0.45) & (y_gap <= thick_x * 1.8))
    rows = ((x_overlap >= 0.52) & (y_gap <= thick_y * 1.75)) | ((y_overlap >= 0.45) & (x_gap <= thick_y * 1.8))
    scale = F.greatest(F.least(a.width, a.height), F.least(b.width, b.height))
    mixed = ((x_overlap >= 0.5) & (y_gap <= scale)) | ((y_overlap >= 0.5) & (x_gap <= scale))
    return F.when(upright, columns).when(flat, rows).otherwise(mixed)


def group_text_lines(lines: DataFrame, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Text blocks of each balloon: ``group_label`` is the smallest line id of the block."""
    by, key = ["balloon_id"], "line_id"

    def edges(hot: DataFrame) -> DataFrame:
        # no rule reaches further than 1.8 times the thinner side of one of the two lines
        pairs = near_pairs(
            hot, hot, by, pad=lambda b: F.least(b.width, b.height) * 1.8, limit=0,
            extra=lambda p: F.col("a_line_id") < F.col("b_line_id"),
        )
        rule = same_text_block(Box.columns("a_"), Box.columns("b_"))
        return pairs.where(rule).select(*by, F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"))

    return _closure(
        lines, by, key, ["ord", key], lambda m, i: same_text_block(Box.struct(m), Box.struct(i)), edges, limit
    )


def line_group_summary(grouped: DataFrame, balloons: DataFrame) -> DataFrame:
    """Union box, mean confidence and layout box of every block.

    ``balloons(balloon_id, x, y, width, height, layout)`` carries a layout box struct
    or null.  A lone block, or the block that shares most area with the layout box,
    inherits it; the others get their own box grown by 40 % inside the balloon.
    """
    box = Box.columns()
    blocks = grouped.groupBy("balloon_id", "group_label").agg(
        F.min(box.x).alias("l"), F.min(box.y).alias("t"), F.max(box.right).alias("r"), F.max(box.bottom).alias("b"),
        F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("lines"),
        F.min(F.struct("ord", "line_id")).alias("first_line"),
    )
    edges = [clip01(F.col(e)).alias(e) for e in ("l", "t", "r", "b")]
    blocks = blocks.select("balloon_id", "group_label", "confidence", "lines", "first_line", *edges)
    frames = balloons.select(
        "balloon_id", F.struct("x", "y", "width", "height").alias("frame"), F.col("layout")
    )
    joined = blocks.join(frames, "balloon_id")
    # from the edges themselves: left + (right - left) may miss the right edge by the last digit and break a tie
    left, top, right, bottom = (F.col(e) for e in ("l", "t", "r", "b"))
    union, layout, frame = Box.edges(left, top, right, bottom), Box.struct(F.col("layout")), Box.struct(F.col("frame"))
    shared_width = F.greatest(F.least(right, layout.right) - F.greatest(left, layout.x), F.lit(0.0))
    shared_height = F.greatest(F.least(bottom, layout.bottom) - F.greatest(top, layout.y), F.lit(0.0))
    shared = F.when(F.col("layout").isNotNull(), shared_width * shared_height)
    joined = joined.withColumn("shared", F.coalesce(shared, F.lit(0.0)))
    lead = joined.groupBy("balloon_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min_by("group_label", F.struct(-F.col("shared"), "first_line")).alias("lead_label"),
        F.max("shared").alias("lead_shared"),
    )
    joined = joined.join(lead, "balloon_id")
    primary = (F.col("blocks") == 1) | ((F.col("group_label") == F.col("lead_label")) & (F.col("lead_shared") > 0))
    dx, dy = union.width * 0.4, union.height * 0.4
    own = Box.edges(
        F.greatest(clip01(left - dx), frame.x), F.greatest(clip01(top - dy), frame.y),
        F.least(clip01(right + dx), frame.right), F.least(clip01(bottom + dy), frame.bottom),
    )
    local = F.when((own.width > 0) & (own.height > 0), own.as_struct()).otherwise(union.as_struct())
    return joined.select(
        "balloon_id", "group_label", *union.named(), "confidence", "lines", primary.alias("is_primary"),
        F.when(primary, F.col("layout")).otherwise(local).alias("layout"),
    )


def upper_median(rows: DataFrame, by: Sequence[str], value: str, name: str = "median", limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """sorted[n / 2] of the values that are present, per group that has one."""
    return ranked_values(rows, by, value, {name: F.floor(F.col("_n") / 2)}, limit)


def _glyph_link(a: Column, b: Column) -> Column:
    """``a`` starts above ``b`` (or comes first): the reach is that of ``a``."""

    def size(g: Column) -> Column:
        return F.greatest(g["x1"] - g["x0"], g["y1"] - g["y0"])

    reach = F.greatest(F.lit(2), F.floor(size(a) * F.lit(1.3)))
    half = F.floor(reach / 2)
    ratio = F.greatest(size(a), size(b)) / F.greatest(F.lit(1), F.least(size(a), size(b)))
    return (
        (ratio <= 2.6)
        & (b["y0"] <= a["y1"] + reach)
        & (a["x0"] - reach < b["x1"] + half)
        & (b["x0"] - half < a["x1"] + reach)
        & (a["y0"] - reach < b["y1"] + half)
        & (b["y0"] - half < a["y1"] + reach)
    )


def cluster_glyphs(
    glyphs: DataFrame, pages: DataFrame, minimum: int = 5, keep: int = 40, limit: int = ARRAY_GROUP_LIMIT
) -> DataFrame:
    """Clusters of at least ``minimum`` nearby glyphs of similar size, the ``keep`` largest per page.

    ``glyphs(page_id, glyph_id, ord, x0, y0, x1, y1)`` are pixel bounds, ends exclusive.
    """
    by, key = ["page_id"], "glyph_id"
    fields = ["x0", "y0", "x1", "y1"]

    def edges(hot: DataFrame) -> DataFrame:
        boxes = hot.select(
            *by, key, "ord", *fields,
            F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"),
            (F.col("x1") - F.col("x0")).cast("double").alias("width"),
            (F.col("y1") - F.col("y0")).cast("double").alias("height"),
        )
        before = F.struct("a_y0", "a_ord", f"a_{key}") < F.struct("b_y0", "b_ord", f"b_{key}")
        pairs = near_pairs(
            boxes, boxes, by, pad=lambda b: F.greatest(b.width, b.height) * 2.0 + 3, limit=0, extra=lambda p: before
        )
        side = lambda p: F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields])
        return pairs.where(_glyph_link(side("a"), side("b"))).select(
            *by, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b")
        )

    groups = [*by, "group_label"]
    size = lambda g: F.greatest(g["x1"] - g["x0"], g["y1"] - g["y0"])
    cold, hot = split_hot(glyphs.select(*by, key, "ord", *fields), by, hot_groups(glyphs, by, limit))
    # an ordinary page is summed up inside its arrays, so its glyphs are shuffled once
    of = lambda f: F.transform("_b", lambda g: g[f])
    sizes = F.sort_array(F.filter(F.transform("_b", size), lambda s: s.isNotNull()))
    boxes = _blocks(cold, by, ["y0", "ord", key], _glyph_link, minimum).select(
        *by, F.array_min(of(key)).alias("group_label"), F.size("_b").cast("long").alias("glyph_count"),
        F.array_min(of("x0")).alias("x0"), F.array_min(of("y0")).alias("y0"), F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"),
        let(sizes, lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int"))).alias("median_size"),
    ).where(F.col("median_size").isNotNull())
    if hot is not None:
        sized = _linked(hot, by, key, edges).withColumn("_size", size(F.struct(*fields)))
        medians = upper_median(sized, groups, "_size", "median_size")
        summed = sized.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("glyph_count"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        )
        boxes = boxes.unionByName(summed.where(F.col("glyph_count") >= minimum).join(medians, groups).select(*boxes.columns))
    boxes = boxes.join(pages.select("page_id", "pixel_width", "pixel_height"), "page_id")
    pad = F.greatest(F.lit(2), F.floor(F.col("median_size") / 3))
    w, h = F.col("pixel_width").cast("double"), F.col("pixel_height").cast("double")
    box = Box.edges(
        F.greatest(F.lit(0), F.col("x0") - pad) / w,
        F.greatest(F.lit(0), F.col("y0") - pad) / h,
        F.least(F.col("pixel_width"), F.col("x1") + pad) / w,
        F.least(F.col("pixel_height"), F.col("y1") + pad) / h,
    )
    shaped = boxes.select("page_id", "group_label", "glyph_count", "median_size", *box.named()).where(
        (F.col("width") > 0) & (F.col("height") > 0)
    )
    return top_rows(shaped, by, [F.col("glyph_count").desc(), F.col("group_label")], keep).drop("_rank")


def _joined_fragments(blobs: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Merge the first fitting pair of the list, as often as one exists.

    A merge changes one blob, so only pairs with that blob can become fitting: they are
    looked at next, and all other pairs before the cursor ``at`` stay unfitting.  ``grown``
    is the place of the blob to look at again, -1 when there is none; then the blob at the
    cursor meets those behind it.  A list of n blobs takes at most 3 n such steps.
    """

    def union(a: Column, b: Column) -> Column:
        return F.struct(
            a["ord"].alias("ord"), a["glyph_id"].alias("glyph_id"),
            F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"),
            F.greatest(a["r"], b["r"]).alias("r"), F.greatest(a["b"], b["b"]).alias("b"),
        )

    def packed(items: Column, at: Column, grown: Column) -> Column:
        return F.struct(items.alias("list"), at.cast("int").alias("at"), grown.cast("int").alias("grown"))

    def step(state: Column, _: Column) -> Column:
        items, at, grown = state["list"], state["at"], state["grown"]
        again = grown >= 0
        own = F.when(again, grown).otherwise(at)

        def partner(one: Column) -> Column:
            """Place of the first blob that fits, 0 when none does (places from 1)."""
            told = F.transform(
                items,
                lambda b, k: F.when(k < own, again & fits(b, one)).when(k > own, fits(one, b)).otherwise(F.lit(False)),
            )
            return F.array_position(told, True)

        def merged(found: Column) -> Column:
            first, second = F.least(own, found - 1), F.greatest(own, found - 1)
            both = union(F.element_at(items, (first + 1).cast("int")), F.element_at(items, (second + 1).cast("int")))
            rest = F.filter(F.transform(items, lambda b, k: F.when(k == first, both).otherwise(b)), lambda _b, k: k != second)
            none = packed(items, F.when(again, at).otherwise(at + 1), F.lit(-1))
            return F.when(found == 0, none).otherwise(packed(rest, F.when(second < at, at - 1).otherwise(at), first))

        return F.when(at >= F.size(items), state).otherwise(let(let(F.element_at(items, own + 1), partner), merged))

    start = packed(blobs, F.lit(0), F.lit(-1))
    return F.aggregate(F.sequence(F.lit(1), 3 * F.size(blobs)), start, step, lambda s: s["list"])


def _fragments_fit(a: Column, b: Column) -> Column:
    """Whether two fragments of a group whose median size is ``_median`` may be one glyph."""
    gap, ceiling = F.col("_median") * 0.15, F.col("_median") * 1.25
    near = (
        (a["x"] - gap < b["r"]) & (b["x"] < a["r"] + gap) & (a["y"] - gap < b["b"]) & (b["y"] < a["b"] + gap)
    )
    wide = F.greatest(a["r"], b["r"]) - F.least(a["x"], b["x"])
    high = F.greatest(a["b"], b["b"]) - F.least(a["y"], b["y"])
    return near & (F.greatest(wide, high) <= ceiling)


def merge_glyph_fragments(glyphs: DataFrame, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Whole glyphs (group_id, glyph_id, ord, x, y, width, height) from stroke fragments.

    The merge depends on order, so it is one JVM fold per group.  Fragments can only meet
    within the size ceiling, so a group above ``limit`` is first cut into the connected
    parts of that reach, which merge independently.  A glyph keeps the name and order
    of its first fragment, whichever way its group is cut.
    """
    valid = glyphs.where((F.col("width") > 0) & (F.col("height") > 0))
    sized = valid.withColumn("_size", F.greatest("width", "height"))
    median = upper_median(sized, ["group_id"], "_size", "_median")
    rows = sized.join(median, "group_id").select(
        "group_id", "glyph_id", "ord", "x", "y", (F.col("x") + F.col("width")).alias("r"),
        (F.col("y") + F.col("height")).alias("b"), "_median", F.lit("").alias("_part"),
    )
    cold, hot = split_hot(rows, ["group_id"], hot_groups(valid, ["group_id"], limit))
    if hot is not None:
        hot = materialize(hot)
        boxes = hot.select(
            "group_id", "glyph_id", "x", "y", (F.col("r") - F.col("x")).alias("width"),
            (F.col("b") - F.col("y")).alias("height"), "_median",
        )
        # glyph ceiling 1.25 medians: fragments of one glyph lie within it, plus the merge tolerance
        boxes = boxes.withColumn("reach", F.col("_median") * 0.75)
        pairs = near_pairs(
            boxes, boxes, ["group_id"], reach=True, limit=0, extra=lambda p: F.col("a_glyph_id") < F.col("b_glyph_id")
        )
        labels = connected_labels(
            boxes, pairs.select("group_id", F.col("a_glyph_id").alias("a"), F.col("b_glyph_id").alias("b")),
            ["group_id"], "glyph_id",
        )
        hot = hot.join(labels, ["group_id", "glyph_id"]).withColumn("_part", F.col("label").cast("string")).drop("label")
        cold = cold.unionByName(hot)

    entry = F.struct("ord", "glyph_id", "x", "y", "r", "b")
    listed = cold.groupBy("group_id", "_part").agg(
        F.max("_median").alias("_median"), F.array_sort(F.collect_list(entry)).alias("_all")
    )

    return listed.select("group_id", F.explode(_joined_fragments(F.col("_all"), _fragments_fit)).alias("g")).select(
        "group_id", "g.glyph_id", "g.ord", "g.x", "g.y",
        (F.col("g.r") - F.col("g.x")).alias("width"), (F.col("g.b") - F.col("g.y")).alias("height"),
    )


def _votes_of_arrays(glyphs: DataFrame) -> DataFrame:
    """(group_id, glyphs, v, h) of ordinary groups: fragments merge and glyphs vote inside one array per group."""
    corners = {"ord": "ord", "glyph_id": "glyph_id", "x": "x", "y": "y", "r": F.col("x") + F.col("width"), "b": F.col("y") + F.col("height")}
    whole = [F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in corners.items()]
    entry = F.when((F.col("width") > 0) & (F.col("height") > 0), F.struct(*whole, F.greatest("width", "height").alias("size")))
    listed = glyphs.groupBy("group_id").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    sizes = F.sort_array(F.transform("_all", lambda e: e["size"]))
    blobs = listed.select(
        "group_id", F.get(sizes, F.floor(F.size("_all") / 2).cast("int")).alias("_median"),
        F.transform("_all", lambda e: F.struct(*[e[n].alias(n) for n in corners])).alias("_all"),
    )
    center = lambda g, low, high: g[low] + (g[high] - g[low]) / 2
    spot = lambda g: F.struct(g["ord"].alias("ord"), g["glyph_id"].alias("key"), center(g, "x", "r").alias("cx"), center(g, "y", "b").alias("cy"))
    spots = blobs.select("group_id", F.transform(_joined_fragments(F.col("_all"), _fragments_fit), spot).alias("_spots"))

    def vote(s: Column) -> Column:
        def ranked(o: Column) -> Column:
            dx, dy = o["cx"] - s["cx"], o["cy"] - s["cy"]
            return F.struct((dx * dx + dy * dy).alias("d2"), o["ord"], o["key"], F.abs(dx).alias("dx"), F.abs(dy).alias("dy"))

        return F.array_min(F.transform(F.filter("_spots", lambda o: o["key"] != s["key"]), ranked))

    told = spots.select("group_id", F.size("_spots").cast("long").alias("glyphs"), F.transform("_spots", vote).alias("_near"))
    return told.select(
        "group_id", "glyphs", F.size(F.filter("_near", lambda n: n["dy"] > n["dx"])).cast("long").alias("v"),
        F.size(F.filter("_near", lambda n: n["dx"] > n["dy"])).cast("long").alias("h"),
    )


def _votes_of_joins(glyphs: DataFrame, limit: int) -> DataFrame:
    """The same of large groups, by spatial joins."""
    from inkloom.operators.spatial import nearest_neighbour

    merged = materialize(merge_glyph_fragments(glyphs, limit))
    near = nearest_neighbour(merged, limit=limit)
    spots = merged.select(
        "group_id", "glyph_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")
    )
    other = spots.select("group_id", F.col("glyph_id").alias("neighbour"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    votes = near.join(spots, ["group_id", "glyph_id"]).join(other, ["group_id", "neighbour"], "left")
    dx, dy = F.abs(F.col("ox") - F.col("cx")), F.abs(F.col("oy") - F.col("cy"))
    tally = votes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("glyphs"), F.count_if(dy > dx).alias("v"), F.count_if(dx > dy).alias("h")
    )
    return glyphs.select("group_id").distinct().join(tally, "group_id", "left")


def vote_direction(glyphs: DataFrame, margin: float = 0.2, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Writing direction per group: every glyph votes by the axis on which its nearest neighbour lies."""
    cold, hot = split_hot(glyphs, ["group_id"], hot_groups(glyphs, ["group_id"], limit))
    tally = _votes_of_arrays(cold)
    if hot is not None:
        tally = tally.unionByName(_votes_of_joins(hot, limit))
    total = F.col("v") + F.col("h")
    clear = (F.col("glyphs") >= 2) & (total > 0) & (F.abs(F.col("v") - F.col("h")) >= total * margin)
    decided = F.when(F.col("v") > F.col("h"), "vertical").otherwise("horizontal")
    return tally.select("group_id", F.when(clear, decided).otherwise("automatic").alias("direction"))


def line_shape(aspect: float = 1.25) -> Column:
    return F.when(F.col("height") >= F.col("width") * aspect, "vertical").when(
        F.col("width") >= F.col("height") * aspect, "horizontal"
    )


def vote_line_direction(lines: DataFrame, regions: DataFrame | None = None, by: str = "balloon_id") -> DataFrame:
    """Majority of line shapes, ``automatic`` on a tie; a direction already known in ``regions`` wins."""
    shape = line_shape()
    tally = lines.groupBy(by).agg(
        F.count_if(shape == "vertical").alias("v"), F.count_if(shape == "horizontal").alias("h")
    )
    voted = F.when(F.col("v") > F.col("h"), "vertical").when(F.col("h") > F.col("v"), "horizontal").otherwise("automatic")
    if regions is None:
        return tally.select(by, voted.alias("direction"))
    joined = regions.select(by, F.col("direction").alias("_known")).join(tally, by, "left")
    known = F.when(F.col("_known") != "automatic", F.col("_known"))
    return joined.select(by, F.coalesce(known, voted).alias("direction"))


def mean_line_confidence(lines: DataFrame, by: str = "balloon_id") -> DataFrame:
    """Mean of the confidences that are present, null when none is."""
    return lines.groupBy(by).agg(F.avg("confidence").alias("confidence"))
