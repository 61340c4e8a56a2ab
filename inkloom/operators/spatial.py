"""Spatial joins between boxes of one page.

``near_pairs`` is the one way two box tables meet.  Pages are equi-join keys; a
page with too many boxes for a nested loop is cut by nested grids of power-of-two
cells.  A box is filed on the grid whose cells just hold it with its reach, where it
touches at most four cells, and looked up on the coarser grids that its page uses;
so two boxes meet on the grid of the larger one.  A pair is produced only in the
cell that holds the upper left corner of the shared part, so no duplicates need
to be removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box
from inkloom.functions.text import compact
from inkloom.operators.greedy import greedy_claim, greedy_keep
from inkloom.scale import (
    ARRAY_GROUP_LIMIT,
    SMALL_TABLE_ROWS,
    WINDOW_GROUP_LIMIT,
    broadcast_if_small,
    hot_groups,
    number_rows,
    split_hot,
    top_rows,
)
from inkloom.session import materialize

#: Exponent of the smallest cells; boxes without extent are filed there.
FINEST_GRID = -20


def _crowded_pages(tables: Sequence[DataFrame], by: Sequence[str], limit: int) -> DataFrame | None:
    """Pages with more than ``limit`` boxes in all tables together."""
    rows = None
    for df in tables:
        part = df.select(*by)
        rows = part if rows is None else rows.unionByName(part)
    assert rows is not None
    crowded = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    found = crowded.limit(SMALL_TABLE_ROWS + 1).collect()
    if not found:
        return None
    if len(found) <= SMALL_TABLE_ROWS:
        return F.broadcast(crowded.sparkSession.createDataFrame(found, crowded.schema))
    return materialize(crowded)


def _graded(df: DataFrame, pad: Column) -> DataFrame:
    """Boxes with their reach ``_pad`` and grid ``_grade``: cells of 2 ** grade hold the padded box."""
    extent = F.greatest("width", "height") + F.col("_pad") * 2
    grade = F.ceil(F.log2(F.greatest(extent, F.lit(2.0**FINEST_GRID)))).cast("int")
    return df.withColumn("_pad", pad).withColumn("_grade", grade)


def _filed(graded: DataFrame) -> DataFrame:
    """One row per touched cell of the box's own grid."""
    return _cells(graded.withColumn("_grid", F.col("_grade")))


def _looked_up(graded: DataFrame, grades: DataFrame, by: Sequence[str], own: bool) -> DataFrame:
    """One row per touched cell of every coarser grid of the page, with ``own`` of the box's own as well."""
    least = F.col("_grade") if own else F.col("_grade") + 1
    usable = F.filter("_grades", lambda g: g >= least)
    return _cells(graded.join(grades, list(by)).withColumn("_grid", F.explode(usable)).drop("_grades"))


def _cells(df: DataFrame) -> DataFrame:
    cell = F.pow(F.lit(2.0), F.col("_grid"))

    def span(start: str, length: str) -> Column:
        first = F.floor((F.col(start) - F.col("_pad")) / cell)
        last = F.floor((F.col(start) + F.col(length) + F.col("_pad")) / cell)
        return F.sequence(first, F.greatest(first, last))

    return df.withColumn("_cx", F.explode(span("x", "width"))).withColumn("_cy", F.explode(span("y", "height")))


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    pad: Callable[[Box], Column] | None = None,
    limit: int = ARRAY_GROUP_LIMIT,
    extra: Callable[[DataFrame], Column] | None = None,
    reach: bool = False,
) -> DataFrame:
    """Pairs of boxes of one group that share area, or whose padded boxes meet.

    Columns of the sides come back with prefixes ``a_`` and ``b_``; the group keys
    keep their names.  ``pad(box)`` is how far a box reaches outside itself; a column
    named ``reach`` on both sides can stand in for it (``pad=None, reach=True``).
    ``extra(joined)`` adds to the join condition (for example an id order).
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c) if c in by else F.col(c).alias(prefix + c) for c in df.columns])

    def padding(prefix: str) -> Column:
        if reach:
            return F.col(f"{prefix}reach")
        return F.lit(0.0) if pad is None else pad(Box.columns(prefix))

    def condition() -> Column:
        a, b = Box.columns("a_"), Box.columns("b_")
        if pad is None and not reach:
            return a.meets(b)
        pa, pb = padding("a_"), padding("b_")
        return (
            (a.x - pa <= b.right + pb)
            & (b.x - pb <= a.right + pa)
            & (a.y - pa <= b.bottom + pb)
            & (b.y - pb <= a.bottom + pa)
        )

    crowded = _crowded_pages([left] if left is right else [left, right], by, limit)
    a_cold, a_hot = split_hot(left, by, crowded)
    b_cold, b_hot = split_hot(right, by, crowded)
    pairs = side(a_cold, "a_").join(side(b_cold, "b_"), list(by)).where(condition())
    if extra is not None:
        pairs = pairs.where(extra(pairs))
    if crowded is None:
        return pairs
    a_boxes, b_boxes = _graded(a_hot, padding("")), _graded(b_hot, padding(""))
    keys = [*by, "_grid", "_cx", "_cy"]
    corner_x = F.greatest(F.col("a_x") - F.col("a__pad"), F.col("b_x") - F.col("b__pad"))
    corner_y = F.greatest(F.col("a_y") - F.col("a__pad"), F.col("b_y") - F.col("b__pad"))
    cell = F.pow(F.lit(2.0), F.col("_grid"))
    here = (F.col("_cx") == F.floor(corner_x / cell)) & (F.col("_cy") == F.floor(corner_y / cell))

    def grades(df: DataFrame) -> DataFrame:
        return df.select(*by, "_grade").distinct().groupBy(*by).agg(F.collect_set("_grade").alias("_grades"))

    def keyed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(prefix + c) for c in [*columns, "_pad"] if c not in by])

    met = None
    for filed, other, own, names in (
        (a_boxes, b_boxes, True, ("a_", "b_")),
        (b_boxes, a_boxes, False, ("b_", "a_")),
    ):
        columns = (left.columns, right.columns) if names[0] == "a_" else (right.columns, left.columns)
        large = keyed(_filed(filed), names[0], columns[0])
        small = keyed(_looked_up(other, grades(filed), by, own), names[1], columns[1])
        found = large.join(small, keys).where(condition()).where(here)
        if extra is not None:
            found = found.where(extra(found))
        found = found.select(*pairs.columns)
        met = found if met is None else met.unionByName(found)
    return pairs.unionByName(met)


def ordered_before(pairs: DataFrame) -> Column:
    """Each unordered pair once: the earlier region first."""
    return F.struct("a_ord", "a_region_id") < F.struct("b_ord", "b_region_id")


def overlap_pairs(regions: DataFrame, share: float = 0.82, same_text_share: float = 0.25, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Region pairs of a page that show the same thing: much shared area, or less with equal text."""
    boxes = regions.select(
        "page_id", "region_id", "ord", "x", "y", "width", "height", compact(F.col("source_text")).alias("key")
    )
    pairs = near_pairs(boxes, boxes, ["page_id"], limit=limit, extra=ordered_before)
    ratio = Box.columns("a_").coverage(Box.columns("b_"))
    same = (F.col("a_key") != "") & (F.col("a_key") == F.col("b_key"))
    kept = pairs.withColumn("coverage", ratio).where(
        (F.col("coverage") >= share) | (same & (F.col("coverage") >= same_text_share))
    )
    return kept.select("page_id", "a_region_id", "b_region_id", "coverage")


def suppress_boxes(
    detections: DataFrame, threshold: float = 0.5, keep: int = 36, limit: int = ARRAY_GROUP_LIMIT
) -> DataFrame:
    """Non-maximum suppression: strongest first, drop what overlaps a kept box, at most ``keep`` per page.

    Stopping after ``keep`` boxes equals keeping the first ``keep`` of the full result.
    """
    rank = [(-F.col("confidence")).alias("r0"), F.col("det_id").alias("r1")]
    conflict = lambda a, b: a.iou(b) >= threshold
    return greedy_keep(
        detections, ["page_id"], "det_id", rank, conflict, near_pairs, limit=limit, copies_conflict=True, keep=keep
    )


def reject_duplicate_boxes(
    proposals: DataFrame, existing: DataFrame, share: float = 0.5, limit: int = ARRAY_GROUP_LIMIT
) -> DataFrame:
    """Verdict per proposed box: 'accepted', 'duplicate' or 'invalid'.

    A call (page_id, call_id) with an empty box, a blank text or a size outside
    1..64 fails as a whole.  A proposal is a duplicate when it and an existing, or
    an earlier accepted, box each cover ``share`` of the other.
    """
    by = ["page_id", "call_id"]
    clamped = Box.columns().clamp()
    prepared = proposals.select(
        *by, "proposal_id", "ord", *clamped.named(),
        (F.coalesce(F.trim("source_text"), F.lit("")) != "").alias("_text"),
    )
    valid_calls = (
        prepared.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.bool_and((F.col("width") > 0) & (F.col("height") > 0) & F.col("_text")).alias("_ok"),
        )
        .where(F.col("_ok") & F.col("_n").between(1, 64))
        .select(*by)
    )
    valid = prepared.join(valid_calls, by, "left_semi").drop("_text")

    def both_covered(a: Box, b: Box) -> Column:
        shared = a.overlap_area(b)
        return (shared > 0) & (shared / a.area >= share) & (shared / b.area >= share)

    old = existing.select("page_id", "x", "y", "width", "height")
    hits = near_pairs(valid, old, ["page_id"], limit=limit)
    taken = hits.where(both_covered(Box.columns("a_"), Box.columns("b_"))).select(
        "page_id", F.col("a_call_id").alias("call_id"), F.col("a_proposal_id").alias("proposal_id")
    )
    fresh = valid.join(taken.distinct(), [*by, "proposal_id"], "left_anti")
    accepted = greedy_keep(
        fresh, by, "proposal_id", [F.col("ord").alias("r0"), F.col("proposal_id").alias("r1")],
        both_covered, near_pairs, limit=limit, copies_conflict=True,
    ).select(*by, "proposal_id", F.lit("accepted").alias("_v"))
    judged = valid.select(*by, "proposal_id").join(accepted, [*by, "proposal_id"], "left")
    judged = judged.select(*by, "proposal_id", F.coalesce("_v", F.lit("duplicate")).alias("verdict"))
    invalid = prepared.join(valid_calls, by, "left_anti").select(*by, "proposal_id", F.lit("invalid").alias("verdict"))
    return judged.unionByName(invalid)


def _row_pairs(left: DataFrame, right: DataFrame, pad: Callable[[Box], Column] | None = None, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Near pairs of a page as the structs ``_a`` and ``_b`` of their rows."""
    pairs = near_pairs(left, right, ["page_id"], pad=pad, limit=limit)

    def row(df: DataFrame, prefix: str) -> Column:
        return F.struct(*[F.col(prefix + c).alias(c) for c in df.columns if c != "page_id"])

    return pairs.select("page_id", row(left, "a_").alias("_a"), row(right, "b_").alias("_b"))


def _claimed_boxes(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str,
    rank: Callable[[Column, Column, Column], Sequence[Column]], minimum: float, limit: int,
) -> DataFrame:
    """Boxes of ``left`` with the box of their page that they claim (``_l``, ``_r``), by coverage of at least ``minimum``."""

    def counts(score: Column, a: Column, b: Column) -> Column:
        return (score >= minimum) & (score > 0) & Box.struct(a).meets(Box.struct(b))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = ["page_id", "ord", "x", "y", "width", "height"]
        return _row_pairs(a.select(left_id, *keys), b.select(right_id, *keys), limit=limit)

    return greedy_claim(
        left, right, ["page_id"], left_id, right_id, lambda a, b: Box.struct(a).coverage(Box.struct(b)), counts, rank, pairs, limit=limit
    )


def snap_regions(
    regions: DataFrame, detections: DataFrame, minimum: float = 0.5, limit: int = ARRAY_GROUP_LIMIT
) -> DataFrame:
    """Give each region the box of its detection, best coverage first, each side at most once.

    Adds ``det_id`` (null when unmatched); matched regions take the detection's
    box, shape (``mask_polygons``) and layout box when those columns exist.
    """
    carried = [c for c in ("mask_polygons", "layout") if c in detections.columns]
    claimed = _claimed_boxes(
        regions, detections.select("page_id", "det_id", "ord", "x", "y", "width", "height", *carried), "region_id", "det_id",
        lambda s, a, b: [-s, a["ord"], a["region_id"], b["ord"], b["det_id"]], minimum, limit,
    )
    own = [c for c in regions.columns if c not in ("page_id", "region_id")]
    out = claimed.select("page_id", "_l.region_id", *[F.col(f"_l.{c}") for c in own], F.col("_r.det_id").alias("det_id"), "_r")
    changed = {c: F.coalesce(f"_r.{c}", c) for c in ("x", "y", "width", "height")}
    return out.withColumns(changed | {c: F.col(f"_r.{c}") for c in carried}).drop("_r")


def reidentify_regions(
    previous: DataFrame,
    detected: DataFrame,
    minimum: float = 0.25,
    limit: int = ARRAY_GROUP_LIMIT,
    recall: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Carry the identity and edits of earlier regions over to newly detected ones.

    Detected regions choose in their order; each takes the best still unused
    previous region with coverage of at least ``minimum``.

    Wide edits need not travel with every previous region: ``recall`` looks further
    columns up by those of ``previous``, for the claimed regions only.  It keeps all
    rows and columns; where nothing is claimed, those of ``previous`` are null.
    """
    keys = ["page_id", "region_id", "ord", "x", "y", "width", "height"]
    claimed = _claimed_boxes(
        detected, previous, "region_id", "region_id",
        lambda s, a, b: [a["ord"], a["region_id"], -s, b["ord"], b["region_id"]], minimum, limit,
    )
    told = claimed.select("page_id", F.col("_l").alias("_detected"), *[F.col(f"_r.{c}").alias(c) for c in previous.columns if c != "page_id"])
    if recall is not None:
        told = recall(told)
    own = {c: F.col(f"_detected.{c}") for c in detected.columns if c != "page_id"}
    carried = [c for c in told.columns if c not in (*keys, "_detected")]
    keeps_text = F.coalesce(F.trim("source_text") != "", F.lit(False)) if "source_text" in carried else F.lit(False)
    columns = [
        "page_id",
        F.coalesce("region_id", own["region_id"]).alias("region_id"),
        own["region_id"].alias("detected_id"),
        *[own[c].alias(c) for c in ("ord", "x", "y", "width", "height")],
    ]
    for c in carried:
        rule = keeps_text if c in ("source_text", "raw_source_text", "text_confirmed") else F.col("region_id").isNotNull()
        columns.append(F.when(rule, F.col(c)).otherwise(own.get(c, F.lit(None))).alias(c))
    return told.select(*columns)


def smallest_enclosure(texts: DataFrame, enclosures: DataFrame, share: float = 0.9, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """The smallest enclosure that holds ``share`` of each text box; null when none does."""
    pairs = near_pairs(texts.select("page_id", "region_id", "x", "y", "width", "height"), enclosures, ["page_id"], limit=limit)
    a, b = Box.columns("a_"), Box.columns("b_")
    best = (
        pairs.where(a.share_inside(b) >= share)
        .groupBy("page_id", F.col("a_region_id").alias("region_id"))
        .agg(F.min_by("b_enclosure_id", F.struct(b.area, F.col("b_ord"), F.col("b_enclosure_id"))).alias("enclosure_id"))
    )
    return texts.select("page_id", "region_id").join(best, ["page_id", "region_id"], "left")


def best_cluster_per_enclosure(enclosures: DataFrame, clusters: DataFrame, share: float = 0.6, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """For each enclosure the contained cluster with most glyphs (first on ties)."""
    pairs = near_pairs(clusters, enclosures, ["page_id"], limit=limit)
    inside = Box.columns("a_").share_inside(Box.columns("b_")) >= share
    best = (
        pairs.where(inside)
        .groupBy("page_id", F.col("b_enclosure_id").alias("enclosure_id"))
        .agg(
            F.min_by("a_cluster_id", F.struct(-F.col("a_glyph_count"), F.col("a_ord"), F.col("a_cluster_id"))).alias(
                "cluster_id"
            )
        )
    )
    return enclosures.select("page_id", "enclosure_id").join(best, ["page_id", "enclosure_id"], "left")


def uncovered_clusters(clusters: DataFrame, enclosures: DataFrame, share: float = 0.6, first: int = 12, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Clusters no enclosure holds, the ``first`` ones of each page in their order."""
    by = ["page_id"]
    crowded = _crowded_pages([clusters, enclosures], by, limit)
    cold, hot = split_hot(clusters, by, crowded)
    shapes, hot_shapes = split_hot(enclosures, by, crowded)
    # one join: the clusters are not shuffled a second time to drop the covered ones
    a, b = Box.columns(), Box.columns("b_")
    held = (F.col("page_id") == F.col("b_page_id")) & a.meets(b) & (a.share_inside(b) >= share)
    free = cold.join(shapes.select(*[F.col(c).alias("b_" + c) for c in ("page_id", "x", "y", "width", "height")]), held, "left_anti")
    if crowded is not None:
        pairs = near_pairs(hot, hot_shapes, by, limit=limit)
        covered = pairs.where(Box.columns("a_").share_inside(Box.columns("b_")) >= share).select(
            "page_id", F.col("a_cluster_id").alias("cluster_id")
        )
        free = free.unionByName(hot.join(covered.distinct(), ["page_id", "cluster_id"], "left_anti"))
    return top_rows(free, ["page_id"], [F.col("ord"), F.col("cluster_id")], first, "position")


def lines_inside_shapes(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Lines whose centre lies in the hull of one of the balloon's polygons; a balloon without polygons keeps all."""
    hulls = shapes.select("balloon_id", "mask_polygons")
    x, y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2

    def holds(polygon: Column) -> Column:
        xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
        return (x >= F.array_min(xs)) & (x <= F.array_max(xs)) & (y >= F.array_min(ys)) & (y <= F.array_max(ys))

    joined = lines.join(hulls, "balloon_id")
    return joined.where((F.size("mask_polygons") == 0) | F.exists("mask_polygons", holds)).drop("mask_polygons")


def assign_components(components: DataFrame, regions: DataFrame, pages: DataFrame, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Pixel components merged by the region they overlap most; others stay alone (``region_id`` null).

    ``components(page_id, component_id, x0, y0, x1, y1)`` are inclusive pixel bounds.
    Each page gives its size, and regions grow by max(0.005, 4 px of the short side).
    """
    sizes = pages.select("page_id", F.col("pixel_width").alias("pw"), F.col("pixel_height").alias("ph"))
    margin = F.greatest(F.lit(0.005), F.lit(4.0) / F.greatest(F.lit(1), F.least("pw", "ph")))
    b = Box.columns()
    dx, dy = b.width * margin, b.height * margin
    grown = Box(b.x - dx, b.y - dy, b.width + dx * 2, b.height + dy * 2).clamp()

    def pixel(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size - 1, value.cast("long")))

    bounds = regions.join(sizes, "page_id").select(
        "page_id", "region_id", "ord",
        pixel(F.floor(grown.x * F.col("pw")), F.col("pw")).alias("rx0"),
        pixel(F.floor(grown.y * F.col("ph")), F.col("ph")).alias("ry0"),
        pixel(F.ceil(grown.right * F.col("pw")) - 1, F.col("pw")).alias("rx1"),
        pixel(F.ceil(grown.bottom * F.col("ph")) - 1, F.col("ph")).alias("ry1"),
    )
    # pixel boxes are paired through the same spatial join, in pixel units
    left = components.select(
        "page_id", "component_id", "x0", "y0", "x1", "y1",
        F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"),
        (F.col("x1") - F.col("x0") + 1).cast("double").alias("width"),
        (F.col("y1") - F.col("y0") + 1).cast("double").alias("height"),
    )
    right = bounds.select(
        "page_id", "region_id", "ord", "rx0", "ry0", "rx1", "ry1",
        F.col("rx0").cast("double").alias("x"), F.col("ry0").cast("double").alias("y"),
        (F.col("rx1") - F.col("rx0") + 1).cast("double").alias("width"),
        (F.col("ry1") - F.col("ry0") + 1).cast("double").alias("height"),
    )
    pairs = near_pairs(left, right, ["page_id"], limit=limit)
    width = F.least("a_x1", "b_rx1") - F.greatest("a_x0", "b_rx0") + 1
    height = F.least("a_y1", "b_ry1") - F.greatest("a_y0", "b_ry0") + 1
    owner = (
        pairs.where((width > 0) & (height > 0))
        .groupBy("page_id", F.col("a_component_id").alias("component_id"))
        .agg(F.min_by("b_region_id", F.struct(-(width * height), F.col("b_ord"), F.col("b_region_id"))).alias("region_id"))
    )
    owned = components.join(owner, ["page_id", "component_id"], "left")
    merged = (
        owned.withColumn("_alone", F.when(F.col("region_id").isNull(), F.col("component_id")))
        .groupBy("page_id", "region_id", "_alone")
        .agg(
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
            F.count(F.lit(1)).alias("parts"),
        )
    )
    return merged.withColumnRenamed("_alone", "component_id")


def attribute_strokes(strokes: DataFrame, regions: DataFrame, selected: DataFrame, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """The smallest box, padded by 1.5 diameters, that holds each stroke point.

    Falls back to the page's selected region, then to its first region.
    """
    b = Box.columns()
    boxes = regions.select("page_id", "region_id", "ord", *b.named())
    # a stroke is a square of half-side 1.5 diameters around its point: it meets a box when the padded box holds the point
    reach = F.col("diameter") * 1.5
    points = strokes.select(
        "page_id", "stroke_id", "px", "py", "diameter",
        (F.col("px") - reach).alias("x"), (F.col("py") - reach).alias("y"),
        (reach * 2).alias("width"), (reach * 2).alias("height"),
    )
    pairs = near_pairs(points, boxes, ["page_id"], pad=lambda box: F.lit(1e-9), limit=limit)
    box, pad = Box.columns("b_"), F.col("a_diameter") * 1.5
    inside = (
        (F.col("a_px") >= box.x - pad) & (F.col("a_px") <= box.right + pad)
        & (F.col("a_py") >= box.y - pad) & (F.col("a_py") <= box.bottom + pad)
    )
    best = (
        pairs.where(inside)
        .groupBy("page_id", F.col("a_stroke_id").alias("stroke_id"))
        .agg(F.min_by("b_region_id", F.struct(box.area, F.col("b_ord"), F.col("b_region_id"))).alias("hit"))
    )
    first = regions.groupBy("page_id").agg(F.min_by("region_id", F.struct("ord", "region_id")).alias("first_region"))
    joined = strokes.select("page_id", "stroke_id").join(best, ["page_id", "stroke_id"], "left")
    joined = joined.join(selected.select("page_id", "selected_region"), "page_id", "left").join(first, "page_id", "left")
    return joined.select(
        "page_id", "stroke_id", F.coalesce("hit", "selected_region", "first_region").alias("region_id")
    )


def match_truth(truth: DataFrame, observed: DataFrame, reach: float = 0.06, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Each truth line, in order, takes the nearest unused observation within ``reach``; else an empty one.

    Both sides carry normalised centres ``cx, cy``.
    """

    def distance(a: Column, b: Column) -> Column:
        dx, dy = a["cx"] - b["cx"], a["cy"] - b["cy"]
        return F.sqrt(dx * dx + dy * dy)  # not hypot, whose last digit may differ: ties and the reach are exact

    def spot(df: DataFrame, key: str) -> DataFrame:
        zero = F.lit(0.0)
        at = [F.col("cx").alias("x"), F.col("cy").alias("y"), zero.alias("width"), zero.alias("height")]
        return df.select("page_id", key, "ord", "cx", "cy", *at)

    claimed = greedy_claim(
        truth, observed.select("page_id", "obs_id", "ord", "cx", "cy", "text"), ["page_id"], "truth_id", "obs_id",
        distance, lambda s, a, b: s <= reach, lambda s, a, b: [a["ord"], a["truth_id"], s, b["ord"], b["obs_id"]],
        lambda a, b: _row_pairs(spot(a, "truth_id"), spot(b, "obs_id"), lambda box: F.lit(reach), limit), limit=limit,
    )
    own = [c for c in truth.columns if c not in ("page_id", "truth_id")]
    out = claimed.select("page_id", "_r.obs_id", "_l.truth_id", *[F.col(f"_l.{c}") for c in own], F.col("_r.text").alias("_text"))
    return out.withColumn("observed", F.coalesce("_text", F.lit(""))).drop("_text")


def detections_to_regions(detections: DataFrame, style: dict | None = None) -> DataFrame:
    """New blank regions from balloons; ids derive from the keys, so a re-run gives the same ids."""
    extra = [F.lit(value).alias(name) for name, value in (style or {}).items()]
    box = Box.columns()
    return detections.select(
        "page_id",
        F.sha2(F.concat_ws("|", "page_id", "det_id"), 256).alias("region_id"),
        *box.named(),
        *box.named("bubble_"),
        *[c for c in ("mask_polygons", "layout") if c in detections.columns],
        F.lit("").alias("source_text"),
        F.lit(0.5).alias("confidence"),
        F.lit(False).alias("automatic_mask"),
        *extra,
    )


#: Places of one leaf block of the search tree, and blocks below one node.
LEAF_PLACES = 12
FANOUT = 6


def _interleaved(x: Column, y: Column) -> Column:
    """The bits of two whole numbers below 2**31 in turn (Z-order)."""

    def apart(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return apart(x).bitwiseOR(F.shiftleft(apart(y), 1))


def _blocks(places: DataFrame, by: str, limit: int) -> DataFrame:
    """``places(by, cx, cy, …)`` with ``_block``: about ``LEAF_PLACES`` places that follow each other in Z-order.

    Blocks are cut by count, so a crowded corner gets as many as it needs.
    """
    bounds = places.groupBy(by).agg(
        F.min("cx").alias("_x0"), F.min("cy").alias("_y0"), F.count(F.lit(1)).alias("_n"),
        F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("_span"),
    )
    steps = lambda v, low: F.when(F.col("_span") > 0, F.floor((F.col(v) - F.col(low)) / F.col("_span") * ((1 << 31) - 1))).otherwise(F.lit(0).cast("long"))
    keyed = places.join(bounds, by).withColumn("_z", _interleaved(steps("cx", "_x0"), steps("cy", "_y0")))
    ranked = number_rows(keyed, [by], [F.col("_z"), F.col("cx"), F.col("cy")], "_pos", limit)
    # the last block takes what is left, so no place is alone in its block unless it is the only one
    last = F.greatest(F.floor(F.col("_n") / LEAF_PLACES) - 1, F.lit(0))
    return ranked.withColumn("_block", F.least(F.floor((F.col("_pos") - 1) / LEAF_PLACES), last)).drop("_x0", "_y0", "_n", "_span", "_z", "_pos")


def _tree(blocks: DataFrame, by: str, largest: int) -> list[DataFrame]:
    """(by, _node, _x0, _x1, _y0, _y1) per level, leaves first, until at most ``FANOUT`` nodes of a group are left."""
    corners = [("_x0", "cx", F.min), ("_x1", "cx", F.max), ("_y0", "cy", F.min), ("_y1", "cy", F.max)]
    level = materialize(blocks.groupBy(by, F.col("_block").alias("_node")).agg(*[f(c).alias(n) for n, c, f in corners]))
    levels, nodes = [level], largest // LEAF_PLACES + 1
    while nodes > FANOUT:
        grouped = levels[-1].groupBy(by, F.floor(F.col("_node") / FANOUT).alias("_node"))
        levels.append(materialize(grouped.agg(*[f(n).alias(n) for n, _, f in corners])))
        nodes = nodes // FANOUT + 1
    return levels


def _apart() -> Column:
    dx, dy = F.col("o_cx") - F.col("cx"), F.col("o_cy") - F.col("cy")
    return dx * dx + dy * dy


def _met_in_tree(blocks: DataFrame, levels: list[DataFrame], by: str) -> DataFrame:
    """Pairs of a place and another one that may be its nearest.

    The nearest place of the own block bounds the search; from the top of the tree down
    only nodes that reach into that circle are followed.
    """
    other = blocks.select(by, "_block", *[F.col(c).alias("o_" + c) for c in ("cx", "cy", "ord", "key")])
    elsewhere = (F.col("o_cx") != F.col("cx")) | (F.col("o_cy") != F.col("cy"))
    bound = blocks.join(other, [by, "_block"]).where(elsewhere).groupBy(by, "cx", "cy").agg(F.min(_apart()).alias("_bound"))
    beyond_x = F.greatest(F.col("_x0") - F.col("cx"), F.col("cx") - F.col("_x1"), F.lit(0.0))
    beyond_y = F.greatest(F.col("_y0") - F.col("cy"), F.col("cy") - F.col("_y1"), F.lit(0.0))
    reached = beyond_x * beyond_x + beyond_y * beyond_y <= F.col("_bound")
    asked = ["cx", "cy", "_bound"]
    front = bound.join(broadcast_if_small(levels[-1]), by).where(reached).select(by, *asked, "_node")
    for level in levels[-2::-1]:
        below = level.withColumn("_above", F.floor(F.col("_node") / FANOUT))
        front = front.withColumnRenamed("_node", "_above").join(below, [by, "_above"]).where(reached).select(by, *asked, "_node")
    return front.withColumnRenamed("_node", "_block").join(other, [by, "_block"]).where(elsewhere)


def _nearest_places(places: DataFrame, by: str, limit: int, largest: int) -> DataFrame:
    """(by, cx, cy, d2, neighbour) of every place of ``places(by, cx, cy, ord, key)``, all of them distinct."""
    blocks = materialize(_blocks(places, by, limit))
    met = _met_in_tree(blocks, _tree(blocks, by, largest), by)
    best = F.min(F.struct(_apart().alias("d2"), "o_ord", F.col("o_key").alias("neighbour"))).alias("_best")
    return met.groupBy(by, "cx", "cy").agg(best).select(by, "cx", "cy", "_best.d2", "_best.neighbour")


def nearest_neighbour(boxes: DataFrame, by: str = "group_id", key: str = "glyph_id", limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """The other box of the group with the nearest centre (first in order on ties), null when alone.

    Ordinary groups compare all their boxes.  In a group above ``limit`` boxes that share
    their centre answer each other; the distinct centres are packed in Z-order into a tree
    of blocks of bounded size, which every centre searches within the distance of its
    nearest neighbour in its own block.  So the work per box grows with the logarithm of
    the group, however unevenly its boxes lie.
    """
    centers = boxes.select(
        by, F.col(key).alias("key"), "ord", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")
    )
    cold, dense = split_hot(centers, [by], hot_groups(centers, [by], limit))
    other = cold.select(by, *[F.col(c).alias("o_" + c) for c in ("key", "ord", "cx", "cy")])
    dx, dy = F.col("o_cx") - F.col("cx"), F.col("o_cy") - F.col("cy")
    rank = F.struct((dx * dx + dy * dy).alias("d2"), "o_ord", F.col("o_key").alias("neighbour"))
    near = cold.join(other, by).where(F.col("key") != F.col("o_key")).groupBy(by, "key").agg(F.min(rank).alias("_best"))
    out = cold.select(by, "key").join(near, [by, "key"], "left").select(by, F.col("key").alias(key), "_best.neighbour", "_best.d2")
    if dense is None:
        return out
    spot = [by, "cx", "cy"]
    dense = materialize(dense)
    lead = F.min(F.struct("ord", "key")).alias("_lead")
    spots = materialize(dense.groupBy(*spot).agg(F.count(F.lit(1)).alias("_boxes"), lead))
    largest = spots.groupBy(by).count().agg(F.max("count")).first()[0]
    places = spots.select(*spot, "_lead.ord", "_lead.key")
    found = _nearest_places(places, by, WINDOW_GROUP_LIMIT, largest)
    # on a shared spot the first box answers all others, and the second one answers the first
    shared = dense.join(spots.where("_boxes > 1"), spot)
    second = shared.where(F.col("key") != F.col("_lead.key")).groupBy(*spot).agg(F.min(F.struct("ord", "key")).alias("_next"))
    answer = F.when(F.col("key") == F.col("_lead.key"), F.col("_next.key")).otherwise(F.col("_lead.key"))
    beside = shared.join(second, spot).select(by, F.col("key").alias(key), answer.alias("neighbour"), F.lit(0.0).alias("d2"))
    alone = spots.where("_boxes = 1").join(found, spot, "left").select(by, F.col("_lead.key").alias(key), "neighbour", "d2")
    return out.unionByName(beside).unionByName(alone)
