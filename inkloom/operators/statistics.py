"""Histogram thresholds, dominant colours and mask coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.scale import top_rows


def otsu_threshold(values: DataFrame, by: Sequence[str], bin_column: str = "bin") -> DataFrame:
    """Histogram split with the largest between-class variance per group (first maximum).

    Values are counted per bin before anything else, so a group is at most 256 rows
    afterwards.  A constant group has threshold 128.
    """
    histogram = values.groupBy(*by, bin_column).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(bin_column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighted = F.col(bin_column) * F.col("_c")
    rows = histogram.select(
        *by, bin_column,
        F.sum("_c").over(group).alias("_n"),
        F.sum(weighted).over(group).cast("double").alias("_all"),
        F.sum("_c").over(upto).alias("_wb"),
        F.sum(weighted).over(upto).cast("double").alias("_sb"),
    )
    wf = F.col("_n") - F.col("_wb")
    gap = F.col("_sb") / F.col("_wb") - F.when(wf > 0, (F.col("_all") - F.col("_sb")) / wf)
    variance = F.when(wf > 0, (F.col("_wb") * wf).cast("double") * gap * gap)
    level = F.max_by(bin_column, F.when(wf > 0, F.struct(variance, -F.col(bin_column))))
    return (
        rows.groupBy(*by)
        .agg(F.coalesce(level, F.lit(128)).cast("long").alias("threshold"))
        .withColumns(
            {
                "glyph_threshold": F.least(F.greatest(F.col("threshold"), F.lit(60)), F.lit(200)),
                "ink_threshold": F.least(F.lit(192), F.greatest(F.lit(48), F.col("threshold") + 6)),
            }
        )
    )


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return F.floor((299 * red + 587 * green + 114 * blue) / 1000)


def dominant_colour(samples: DataFrame, groups: DataFrame | None = None, by: str = "group_id") -> DataFrame:
    """Mean colour of the fullest of 16 brightness bins (the brighter one on ties).

    A near-white mean in the top bin becomes pure white; a group of ``groups``
    without samples is white.
    """
    r, g, b = F.col("red").cast("long"), F.col("green").cast("long"), F.col("blue").cast("long")
    slot = F.least(F.lit(15), F.floor(luminance(r, g, b) * 16 / 256))
    bins = samples.groupBy(by, slot.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(r).alias("_r"), F.sum(g).alias("_g"), F.sum(b).alias("_b")
    )
    best = bins.groupBy(by).agg(F.max(F.struct("_c", "_bin", "_r", "_g", "_b")).alias("_m"))
    mean = {c: F.floor(F.col(f"_m._{c[0]}") / F.col("_m._c")) for c in ("red", "green", "blue")}
    colours = best.select(by, F.col("_m._bin").alias("_bin"), *[value.alias(name) for name, value in mean.items()])
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    paper = (F.col("_bin") == 15) & (luminance(r, g, b) >= 244) & (F.greatest(r, g, b) - F.least(r, g, b) <= 12)
    white = F.lit(255).cast("long")
    snapped = colours.select(by, *[F.when(paper, white).otherwise(F.col(c)).alias(c) for c in mean])
    if groups is None:
        return snapped
    joined = groups.select(by).distinct().join(snapped, by, "left")
    return joined.select(by, *[F.coalesce(F.col(c), white).alias(c) for c in mean])


def mask_coverage(
    components: DataFrame, searches: DataFrame, reject_border: bool = False, padding: int = 2, keep: int = 256
) -> DataFrame:
    """How much of a region's ink the kept glyph components cover.

    ``components(region_id, component_id, x0, y0, x1, y1, area, shape_share)`` in
    pixels, ends exclusive; ``shape_share`` is the part inside the balloon shape, or
    null without one.  ``searches(region_id, x0, y0, x1, y1, foreground)`` is the
    searched box and its ink pixels.
    """
    s = searches.select(
        "region_id", *[F.col(c).alias("s_" + c) for c in ("x0", "y0", "x1", "y1")], "foreground"
    )
    width, height = F.col("s_x1") - F.col("s_x0"), F.col("s_y1") - F.col("s_y0")
    pixels = F.greatest(width * height, F.lit(1))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    margin = max(1, padding)
    spans = (w / width >= 0.72) | (h / height >= 0.72)
    structural = spans & (F.col("area") / F.greatest(w * h, F.lit(1)) < 0.45)
    inside = F.coalesce(F.col("shape_share") >= 0.6, F.lit(True))
    touches = (
        (F.col("x0") <= F.col("s_x0") + margin) | (F.col("y0") <= F.col("s_y0") + margin)
        | (F.col("x1") >= F.col("s_x1") - margin) | (F.col("y1") >= F.col("s_y1") - margin)
    )
    rows = (
        components.join(s, "region_id")
        .where((width > 0) & (height > 0))
        .where(F.col("area") >= F.greatest(F.lit(2), F.floor(pixels * F.lit(0.00006))))
        .withColumns({"_structural": structural, "_touch": touches})
        .withColumn("_content", ~F.col("_structural") & inside)
    )
    border = F.col("_content") & F.col("_touch") if reject_border else F.lit(False)
    rows = rows.withColumn("_border", border).withColumn("_kept", F.col("_content") & ~F.col("_border"))
    largest = top_rows(
        rows.where(F.col("_kept")), ["region_id"], [F.col("area").desc(), F.col("component_id")], keep
    )
    covered = largest.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("area").alias("covered"), F.bool_or("_touch").alias("touches_border")
    )
    ignored = rows.groupBy("region_id").agg(
        F.max("foreground").alias("foreground"),
        F.sum(F.when(F.col("_structural") | F.col("_border"), F.col("area")).otherwise(0)).alias("ignored"),
    )
    joined = covered.join(ignored, "region_id")
    relevant = F.greatest(F.col("foreground") - F.col("ignored"), F.lit(1))
    ratio = F.least(F.lit(1.0), F.col("covered") / relevant)
    return joined.select(
        "region_id", "kept", "covered", "touches_border", ratio.alias("coverage_ratio"),
        ((ratio >= 0.9) & ~F.col("touches_border")).alias("coverage_complete"),
    )
