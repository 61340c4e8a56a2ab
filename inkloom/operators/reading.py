"""Reading order, line assembly, natural order, renumbering, runs and top-k.

Rows or columns of boxes are bands: along the sorted axis a new band starts where
the gap to the previous box exceeds the tolerance.  (A pairwise tolerance test is
not a total order; bands give the same result whenever rows are separated.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box
from inkloom.functions.ordering import natural_key
from inkloom.functions.text import is_blank
from inkloom.operators.shifts import RunList
from inkloom.scale import (
    WINDOW_GROUP_LIMIT,
    broadcast_if_small,
    carried,
    hot_groups,
    number_rows,
    ordered_index,
    previous_values,
    split_hot,
    top_rows,
)
from inkloom.session import materialize


def banded_order(
    rows: DataFrame, by: Sequence[str], tie: Sequence[str], name: str, limit: int = WINDOW_GROUP_LIMIT
) -> DataFrame:
    """Position by (band of ``_axis``, ``_second``); ``_tol`` is constant within a group.

    Ordinary groups use windows on one shuffle.  In a large group the axis is first
    summarised in buckets one tolerance wide (a bucket never holds two bands), bands
    are found among the buckets, and rows are numbered across tasks.
    """
    cold, hot = split_hot(rows, by, hot_groups(rows, by, limit))
    axis = Window.partitionBy(*by).orderBy("_axis", "_second", *tie)
    jump = F.col("_axis") - F.lag("_axis").over(axis) > F.col("_tol")
    banded = cold.withColumn("_band", F.sum(F.coalesce(jump, F.lit(False)).cast("long")).over(axis))
    final = Window.partitionBy(*by).orderBy("_band", "_second", *tie)
    work = ["_axis", "_tol", "_second"]
    out = banded.withColumn(name, F.row_number().over(final).cast("long")).drop("_band", *work)
    if hot is None:
        return out
    bucketed = hot.withColumn("_bucket", F.floor(F.col("_axis") / F.col("_tol")))
    buckets = bucketed.groupBy(*by, "_bucket").agg(
        F.min("_axis").alias("_low"), F.max("_axis").alias("_high"), F.max("_tol").alias("_tol")
    )
    along = Window.partitionBy(*by).orderBy("_bucket")
    jump = F.col("_low") - F.lag("_high").over(along) > F.col("_tol")
    bands = buckets.withColumn("_band", F.sum(F.coalesce(jump, F.lit(False)).cast("long")).over(along))
    joined = bucketed.join(bands.select(*by, "_bucket", "_band"), [*by, "_bucket"])
    order = [F.col("_band"), F.col("_second"), *[F.col(t) for t in tie]]
    numbered = ordered_index(joined, by, order, name)
    return out.unionByName(numbered.select(*out.columns))


def _with_page_stats(rows: DataFrame, by: Sequence[str], stats: dict[str, Column], limit: int) -> DataFrame:
    """Group aggregates next to the rows: by window for ordinary groups, by join for large ones."""
    hot_keys = hot_groups(rows, by, limit)
    cold, hot = split_hot(rows, by, hot_keys)
    window = Window.partitionBy(*by)
    out = cold.withColumns({name: value.over(window) for name, value in stats.items()})
    if hot is None:
        return out
    table = hot.groupBy(*by).agg(*[value.alias(name) for name, value in stats.items()])
    return out.unionByName(hot.join(broadcast_if_small(table), list(by)).select(*out.columns))


def reading_order(regions: DataFrame, direction: str = "rightToLeft", limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """1-based ``reading_rank`` of every region on its page."""
    box = Box.columns()
    tall = F.count_if(box.height > box.width * 1.35)
    # a mean of decimals does not depend on the order of the rows, as the last digit of a mean of doubles does
    mean = F.avg(F.col("height").try_cast("decimal(38,18)"))
    stats = {"_tall": tall, "_n": F.count(F.lit(1)), "_mean_h": mean}
    rows = _with_page_stats(regions, ["page_id"], stats, limit)
    by_column = (F.col("_tall") * 2 >= F.col("_n")) | F.lit(direction == "topToBottom")
    forward = 1.0 if direction == "leftToRight" else -1.0
    row_forward = -1.0 if direction == "rightToLeft" else 1.0
    rows = rows.withColumns(
        {
            "_axis": F.when(by_column, box.center_x * forward).otherwise(box.center_y),
            "_second": F.when(by_column, box.center_y).otherwise(box.center_x * row_forward),
            "_tol": F.when(by_column, F.lit(0.08)).otherwise(F.greatest(F.lit(0.025), F.col("_mean_h").cast("double") * 0.65)),
        }
    ).drop("_tall", "_n", "_mean_h")
    return banded_order(rows, ["page_id"], ["ord", "region_id"], "reading_rank", limit)


def layout_order(boxes: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Rows by top edge (tolerance a quarter of the tallest box), then left edge: ``layout_rank``."""
    rows = _with_page_stats(boxes, ["page_id"], {"_tallest": F.max("height")}, limit)
    rows = rows.withColumns(
        {"_axis": F.col("y"), "_second": F.col("x"), "_tol": F.col("_tallest") * 0.25}
    ).drop("_tallest")
    return banded_order(rows, ["page_id"], ["ord", "region_id"], "layout_rank", limit)


def assemble_lines(lines: DataFrame, directions: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """One text per region from its recognised lines in reading order.

    ``lines(region_id, line_id, ord, text, x, y, width, height)``,
    ``directions(region_id, direction)``.  Horizontal lines join with a line break,
    vertical ones directly; blank lines are dropped.
    """
    box = Box.columns()
    vertical = F.col("direction") == "vertical"
    rows = (
        lines.where(~is_blank(F.col("text")))
        .join(directions, "region_id")
        .withColumns(
            {
                "_axis": F.when(vertical, -box.center_x).otherwise(box.center_y),
                "_second": F.when(vertical, box.y).otherwise(box.x),
                "_tol": F.lit(0.001),
            }
        )
    )
    placed = banded_order(rows, ["region_id"], ["ord", "line_id"], "line_rank", limit)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_rank", "text"))), lambda s: s["text"])
    joined = placed.groupBy("region_id", "direction").agg(texts.alias("_texts"), F.count(F.lit(1)).alias("lines"))
    return joined.select(
        "region_id", "direction", "lines",
        F.when(F.col("direction") == "horizontal", F.array_join("_texts", "\n"))
        .otherwise(F.array_join("_texts", ""))
        .alias("text"),
    )


def natural_order(paths: DataFrame, by: Sequence[str], path: str, name: str = "path_rank") -> DataFrame:
    """Position in numeric-aware path order; ties fall back to the raw path."""
    keyed = paths.withColumn("_natural", natural_key(F.col(path)))
    return number_rows(keyed, by, [F.col("_natural"), F.col(path)], name).drop("_natural")


def renumber_pages(pages: DataFrame, order: Sequence[Column], name: str = "page_index") -> DataFrame:
    """Contiguous 1-based index per project."""
    return number_rows(pages, ["project_id"], order, name)


def _shifted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of pages that keep together, from moves sorted by project and time."""
    now, runs = None, None

    def told() -> pa.RecordBatch:
        first, place = zip(*runs.runs())
        shift = [p - f for f, p in zip(first, place)]
        return pa.RecordBatch.from_pydict({"project_id": pa.array([now] * len(first), kind), "page_index": first, "shift": shift})

    for batch in batches:
        kind = batch.schema.field("project_id").type
        for project, start, offset, position, n in zip(*(batch.column(c).to_pylist() for c in ("project_id", "start", "offset", "position", "n"))):
            if runs is None or project != now:
                if runs is not None:
                    yield told()
                now, runs = project, RunList(n)
            runs.move(start, offset, position, n)
    if runs is not None:
        yield told()


def move_pages(pages: DataFrame, moves: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Apply page moves in ``seq`` order (then by page) to a contiguous ``page_index``.

    ``moves(project_id, seq, page_id, offset, position)``: an offset is clamped to the
    ends; an absolute position outside 1..n is ignored, and so are moves of unknown pages
    and moves without either.  The moves of a project stream in order through a list of
    runs, which holds at most three runs per move whatever the number of pages; the
    result is a piecewise shift of the old places, which all pages then look up once.
    ``limit`` is the number of pages of a project that one task may sort for that.
    """
    counts = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    places = pages.select("project_id", "page_id", F.col("page_index").cast("long").alias("start"))
    given = moves.where(F.col("offset").isNotNull() | F.col("position").isNotNull()).select(
        "project_id", "seq", "page_id", F.col("offset").cast("long").alias("offset"), F.col("position").cast("long").alias("position")
    )
    placed = given.join(places, ["project_id", "page_id"]).join(counts, "project_id")
    ordered = placed.repartition("project_id").sortWithinPartitions("project_id", "seq", "page_id")
    kind = dict(pages.dtypes)["project_id"]
    runs = materialize(ordered.mapInArrow(_shifted_runs, f"project_id {kind}, page_index long, shift long"))
    # every page takes the shift of the last run that begins at its place or before
    key = ["project_id"]
    marks = runs.select(*key, "page_index", F.lit(0).alias("_kind"), "shift")
    asked = pages.join(runs.select(*key).distinct(), key, "left_semi").select("*", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("shift"))
    log = asked.unionByName(marks, allowMissingColumns=True)
    told = carried(log, key, ["page_index", "_kind"], F.col("shift"), "_by", limit).where(F.col("_kind") == 1)
    moved = told.withColumn("page_index", (F.col("page_index") + F.col("_by")).cast(dict(pages.dtypes)["page_index"]))
    still = pages.join(runs.select(*key).distinct(), key, "left_anti")
    return moved.select(*pages.columns).unionByName(still)


def merge_runs(cells: DataFrame, by: Sequence[str] = ("group_id",), limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Maximal x-runs per row, equal runs of consecutive rows joined to rectangles (ends exclusive)."""
    by = list(by)
    rows = number_rows(cells.select(*by, "y", "x").distinct(), [*by, "y"], [F.col("x")], "_n", limit)
    runs = (
        rows.withColumn("_island", F.col("x") - F.col("_n"))
        .groupBy(*by, "y", "_island")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
        .drop("_island")
    )
    stacked = number_rows(runs, [*by, "x0", "x1"], [F.col("y")], "_n", limit)
    return (
        stacked.withColumn("_island", F.col("y") - F.col("_n"))
        .groupBy(*by, "x0", "x1", "_island")
        .agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
        .drop("_island")
    )


def ctc_decode(scores: DataFrame, charset: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Text and mean confidence per line from step scores; class 0 is the blank.

    ``scores(line_id, t, class, score)``; ``charset(class, letter)``.  Scores that are
    not already a probability vector go through softmax.  A step has one row per
    class of the model's character set, so its window is bounded by that set; classes
    outside ``charset`` take no part.
    """
    lines = scores.select("line_id").distinct()
    scores = scores.join(broadcast_if_small(charset.select("class").distinct()), "class", "left_semi")
    step = Window.partitionBy("line_id", "t")
    with_max = scores.withColumn("_max", F.max("score").over(step))
    best = with_max.groupBy("line_id", "t").agg(
        F.min_by("class", F.struct(-F.col("score"), F.col("class"))).alias("best"),
        F.max("score").alias("_top"),
        F.sum("score").alias("_sum"),
        F.bool_and(F.col("score").between(-0.0001, 1.0001)).alias("_unit"),
        F.sum(F.exp(F.col("score") - F.col("_max"))).alias("_total"),
    )
    probable = F.col("_unit") & (F.abs(F.col("_sum") - 1) < 0.02)
    p = F.when(probable, F.col("_top")).otherwise(1.0 / F.col("_total"))
    steps = best.select("line_id", "t", "best", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))
    steps = previous_values(steps, ["line_id"], [F.col("t")], {"_before": "best"}, limit)
    letters = charset.select(F.col("class").alias("best"), "letter")
    kept = steps.where((F.col("best") != 0) & ~F.col("best").eqNullSafe(F.col("_before"))).join(
        broadcast_if_small(letters), "best"
    )
    kept = kept.where(F.col("letter") != "blank")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("t", "letter"))), lambda s: s["letter"])
    decoded = kept.groupBy("line_id").agg(F.array_join(pieces, "").alias("text"), F.avg("p").alias("confidence"))
    return lines.join(decoded, "line_id", "left").select(
        "line_id", F.coalesce("text", F.lit("")).alias("text"), "confidence"
    )


def order_regions(regions: DataFrame) -> DataFrame:
    """Regions in page order."""
    return regions.orderBy("page_id", "ord", "region_id")


def top_k_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group in the given order, with their ``rank``."""
    return top_rows(rows, by, order, k, "rank")


def strongest_lines(lines: DataFrame, k: int = 3000) -> DataFrame:
    """The ``k`` most confident lines of a balloon, listed top-down and right-to-left."""
    kept = top_rows(lines, ["balloon_id"], [F.col("confidence").desc(), F.col("line_id")], k).drop("_rank")
    order = [F.col("y"), F.col("x").desc(), F.col("line_id")]
    return number_rows(kept, ["balloon_id"], order, "position")


def unique_names(files: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Free names for colliding files, in arrival order: ``a.png``, ``a-2.png``, ``a-3.png``, …

    ``files(dir, name, arrival)`` with unique arrivals.  Every file asks for its next
    name, a name goes to the earliest file that asks, and the others ask again; this
    settles on what a sequential pass would give.  The n-th file of a name can get
    no number below n, so it starts there.  A name only ever passes to an earlier
    file, so a file refused inside a run of numbers that earlier files hold asks
    next for the first number after the run.
    """
    pattern = r"^(.+?)(?:\.([^.]*))?$"
    with_number = r"^(.+)-([1-9][0-9]{0,17})\.([^.]*)$"
    first = number_rows(files, ["dir", "name"], [F.col("arrival")], "_k", limit)
    asking = first.withColumns(
        {"_stem": F.regexp_extract("name", pattern, 1), "_ext": F.regexp_extract("name", pattern, 2)}
    )
    while True:
        numbered = F.concat("_stem", F.lit("-"), F.col("_k").cast("string"), F.lit("."), "_ext")
        asked = materialize(asking.withColumn("final", F.when(F.col("_k") == 1, F.col("name")).otherwise(numbered)))
        owners = materialize(asked.groupBy("dir", "final").agg(F.min("arrival").alias("_owner")))
        judged = asked.join(owners, ["dir", "final"])
        refused = F.col("arrival") != F.col("_owner")
        if judged.where(refused).isEmpty():
            return asked.select(*files.columns, "final")
        held = owners.where(F.col("final").rlike(with_number)).select(
            "dir", "final", "_owner", F.regexp_extract("final", with_number, 1).alias("_s"),
            F.regexp_extract("final", with_number, 2).cast("long").alias("_no"), F.regexp_extract("final", with_number, 3).alias("_e"),
        )
        run = ["dir", "_s", "_e", "_run"]
        held = number_rows(held, ["dir", "_s", "_e"], [F.col("_no")], "_r", limit).withColumn("_run", F.col("_no") - F.col("_r"))
        runs = held.groupBy(*run).agg(F.max("_no").alias("_end"), F.max("_owner").alias("_latest"))
        judged = judged.join(held.join(runs, run).select("dir", "final", "_end", "_latest"), ["dir", "final"], "left")
        after = F.when(F.col("arrival") > F.col("_latest"), F.col("_end") + 1).otherwise(F.col("_k") + 1)
        asking = judged.withColumn("_k", F.when(refused, after).otherwise(F.col("_k"))).drop("final", "_owner", "_end", "_latest")
