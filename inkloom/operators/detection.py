"""Raw detector output to normalised boxes, component filters, tiles and layout plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box, let
from inkloom.functions.text import visible_length

# Letters that decide between upright and flat typesetting.
HANGUL = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}]"
KANA_AND_HAN = r"[\x{3000}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
LATIN = r"[A-Za-z\x{00c0}-\x{024f}]"
ANY_EAST_ASIAN = (
    r"[\x{1100}-\x{11ff}\x{3000}-\x{30ff}\x{3130}-\x{318f}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
)
IDEOGRAPHIC_SPACE = "　"


def decode_detections(raw: DataFrame, pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Letterboxed centre-size boxes to clamped page boxes; weak and empty ones are dropped.

    ``raw(page_id, det_id, cx, cy, w, h, score, pad_x, pad_y, scale)``.
    """
    sizes = pages.select("page_id", "pixel_width", "pixel_height")
    strong = raw.where((F.col("score") >= threshold) & (F.col("w") > 0) & (F.col("h") > 0)).join(sizes, "page_id")

    def edge(center: str, half: Column, pad: str) -> Column:
        return (F.col(center) + half - F.col(pad)) / F.col("scale")

    left, right = edge("cx", -F.col("w") / 2, "pad_x"), edge("cx", F.col("w") / 2, "pad_x")
    top, bottom = edge("cy", -F.col("h") / 2, "pad_y"), edge("cy", F.col("h") / 2, "pad_y")
    box = Box(
        left / F.col("pixel_width"), top / F.col("pixel_height"),
        (right - left) / F.col("pixel_width"), (bottom - top) / F.col("pixel_height"),
    ).clamp()
    decoded = strong.select("page_id", "det_id", F.col("score").alias("confidence"), *box.named())
    return decoded.where((F.col("width") > 0) & (F.col("height") > 0))


#: Names under which a box object may hold its four numbers, in the order they are tried.
BOX_KEYS = ("bbox_2d", "bbox", "box", "text_box")


def read_grounding_boxes(replies: DataFrame) -> DataFrame:
    """(response_id, box_no, box ARRAY<DOUBLE>) from ``replies(response_id, json)``.

    Every item of the JSON array is four numbers, or an object with four numbers under
    one of ``BOX_KEYS``.  An item without them has a null box, which makes
    ``map_grounding_boxes`` reject its response.
    """
    items = F.try_variant_get(F.try_parse_json("json"), "$", "array<variant>")

    def numbers(item: Column) -> Column:
        forms = [F.try_variant_get(item, path, "array<double>") for path in ("$", *[f"$.{key}" for key in BOX_KEYS])]
        return F.coalesce(*[F.when(F.size(form) == 4, form) for form in forms])

    return replies.select("response_id", F.posexplode(F.transform(items, numbers)).alias("box_no", "box"))


def map_grounding_boxes(boxes: DataFrame, padding: float = 0.08, most: int = 16) -> DataFrame:
    """Model boxes on a 0..1000 scale to page boxes; one bad box rejects its whole response.

    ``boxes(response_id, box_no, box ARRAY<DOUBLE>, crop STRUCT<x,y,width,height> in
    pixels, image_width, image_height, clip STRUCT<x,y,width,height> or null)``.
    """
    value = lambda i: F.try_element_at("box", F.lit(i))
    numeric = F.forall("box", lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1000))

    def pixel(coordinate: Column, size: Column) -> Column:
        return F.bround(coordinate / 1000 * size)

    crop = Box.struct(F.col("crop"))
    w, h = F.col("image_width").cast("double"), F.col("image_height").cast("double")
    corners = F.struct(
        pixel(F.least(value(1), value(3)), crop.width).alias("l"),
        pixel(F.least(value(2), value(4)), crop.height).alias("t"),
        pixel(F.greatest(value(1), value(3)), crop.width).alias("r"),
        pixel(F.greatest(value(2), value(4)), crop.height).alias("b"),
    )

    def place(c: Column) -> Column:
        raw = Box((crop.x + c["l"]) / w, (crop.y + c["t"]) / h, (c["r"] - c["l"]) / w, (c["b"] - c["t"]) / h)
        positive = (c["r"] > c["l"]) & (c["b"] > c["t"])
        return let(raw.clamp().as_struct(), lambda box: F.struct(box.alias("raw"), positive.alias("positive")))

    def clip_to(placed: Column) -> Column:
        raw, clip = Box.struct(placed["raw"]), Box.struct(F.col("clip"))

        def judge(padded: Column) -> Column:
            free = F.struct(padded.alias("b"), placed["positive"].alias("ok"))
            inside = raw.overlap_area(clip) / raw.area
            held = let(
                Box.struct(padded).intersect(clip).as_struct(),
                lambda cut: F.struct(
                    cut.alias("b"),
                    (placed["positive"] & (inside >= 0.7) & (cut["width"] > 0) & (cut["height"] > 0)).alias("ok"),
                ),
            )
            return F.when(F.col("clip").isNull(), free).otherwise(held)

        return let(raw.expand(padding).as_struct(), judge)

    shaped = (F.size("box") == 4) & numeric & (crop.width > 0) & (crop.height > 0) & (w > 0) & (h > 0)
    judged = boxes.select(
        "response_id", "box_no", F.when(shaped, let(corners, lambda c: let(place(c), clip_to))).alias("_j")
    ).select("response_id", "box_no", F.coalesce("_j.ok", F.lit(False)).alias("_ok"), F.col("_j.b").alias("b"))
    valid = judged.groupBy("response_id").agg(F.bool_and("_ok").alias("_all"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_all") & (F.col("_n") <= most)
    )
    return judged.join(valid, "response_id").select("response_id", "box_no", "b.x", "b.y", "b.width", "b.height")


def union_grounding(mapped: DataFrame) -> DataFrame:
    """One box around all boxes of a response."""
    box = Box.columns()
    edges = mapped.groupBy("response_id").agg(
        F.min(box.x).alias("l"), F.min(box.y).alias("t"), F.max(box.right).alias("r"), F.max(box.bottom).alias("b")
    )
    whole = Box.edges(F.col("l"), F.col("t"), F.col("r"), F.col("b")).clamp()
    return edges.select("response_id", *whole.named())


def unclip_components(components: DataFrame, ratio: float = 1.4) -> DataFrame:
    """Text components grown by area x ratio / perimeter and taken back through the letterbox.

    ``components(component_id, x0, y0, x1, y1, confidence, model_width, model_height,
    pad_x, pad_y, scaled_width, scaled_height)`` with inclusive model pixels.
    """

    def edges(c: Column) -> Column:
        w, h = (c["x1"] - c["x0"] + 1).cast("double"), (c["y1"] - c["y0"] + 1).cast("double")
        grow = w * h * ratio / F.greatest(F.lit(1.0), (w + h) * 2)
        return let(grow, lambda g: F.struct(
            back(F.greatest(F.lit(0.0), c["x0"] - g), "pad_x", "scaled_width").alias("l"),
            back(F.greatest(F.lit(0.0), c["y0"] - g), "pad_y", "scaled_height").alias("t"),
            back(F.least(F.col("model_width").cast("double"), c["x1"] + 1 + g), "pad_x", "scaled_width").alias("r"),
            back(F.least(F.col("model_height").cast("double"), c["y1"] + 1 + g), "pad_y", "scaled_height").alias("b"),
        ))

    def back(value: Column, pad: str, size: str) -> Column:
        return (value - F.col(pad)) / F.col(size)

    # every step is bound: inlined, a side would name each corner dozens of times, in the filter once more
    box = let(let(F.struct("x0", "y0", "x1", "y1"), edges), lambda e: Box.edges(e["l"], e["t"], e["r"], e["b"]).clamp().as_struct())
    kept = F.filter(F.array(box), lambda b: (b["width"] > 0) & (b["height"] > 0))
    return components.select("component_id", "confidence", F.inline(kept))


def filter_enclosures(components: DataFrame) -> DataFrame:
    """White components that can be balloons.

    ``components(component_id, w, h, area, page_width, page_height, top, bottom, left, right)``;
    the last four are the interior coverages of the sides.
    """
    page = F.greatest(F.lit(1), F.col("page_width") * F.col("page_height")).cast("double")
    box_share = F.col("w") * F.col("h") / page
    framed = F.lit(True)
    for side in ("top", "bottom", "left", "right"):
        framed = framed & (F.col(side) >= 0.72)
    return components.where(
        (F.col("w") * F.col("h") > 0)
        & (F.col("area") / page >= 0.002)
        & box_share.between(0.004, 0.2)
        & (F.col("area") / (F.col("w") * F.col("h")) >= 0.45)
        & (F.col("w") / F.col("page_width") >= 0.04)
        & (F.col("h") / F.col("page_height") >= 0.02)
        & ~((box_share >= 0.04) & framed)
    )


def filter_glyphs(components: DataFrame) -> DataFrame:
    """Ink components that can be glyphs, by size, slimness, fill and bright surroundings."""
    short_page = F.least("page_width", "page_height").cast("double")
    least = F.greatest(F.lit(2), F.floor(short_page * 0.006))
    most = F.greatest(F.lit(4), F.floor(short_page * 0.055))
    long_side, short_side = F.greatest("w", "h"), F.least("w", "h")
    return components.where(
        long_side.between(least, most)
        & (F.col("area") <= most * most)
        & (short_side * 8 >= long_side)
        & (F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1)) >= 0.12)
        & (F.col("surround") >= 205)
    )


def scan_tiles(pages: DataFrame, columns: int = 3, rows: int = 3, overlap: float = 0.2) -> DataFrame:
    """Overlapping grid tiles of every page, numbered row by row."""
    width, height = 1.0 / columns, 1.0 / rows

    def clamp(start: float, length: float) -> tuple[float, float]:
        low = min(max(start, 0.0), 1.0)
        return low, min(max(start + length, low), 1.0) - low

    tiles = []
    for row in range(rows):
        for column in range(columns):
            x, w = clamp(column * width - width * overlap / 2, width * (1 + overlap))
            y, h = clamp(row * height - height * overlap / 2, height * (1 + overlap))
            tiles.append(
                F.struct(
                    F.lit(row * columns + column).alias("tile"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                    F.lit(w).alias("width"), F.lit(h).alias("height"),
                )
            )
    return pages.select("page_id", F.explode(F.array(*tiles)).alias("t")).select("page_id", "t.*")


def layout_plan(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Layout box, anchor, direction and first font size of every region.

    ``regions`` may carry box structs ``translation_bounds``, ``bubble_layout``,
    ``bubble_bounds``, a point ``translation_anchor``, ``style_direction``,
    ``detected_direction``, ``font_size``, ``minimum_font``, ``maximum_font``.
    """
    have = set(regions.columns)

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    rect = "struct<x:double,y:double,width:double,height:double>"
    bounds = Box.columns().as_struct()
    layout = F.coalesce(
        column("translation_bounds", rect), column("bubble_layout", rect), column("bubble_bounds", rect), bounds
    )
    rows = regions.join(pages.select("page_id", "pixel_width", "pixel_height"), "page_id").withColumn("layout", layout)
    box = Box.struct(F.col("layout"))
    anchor = F.coalesce(
        column("translation_anchor", "struct<x:double,y:double>"),
        F.struct(box.center_x.alias("x"), box.center_y.alias("y")),
    )
    target, both = F.col("translated_text"), F.concat("source_text", "translated_text")
    style = F.coalesce(column("style_direction", "string"), F.lit("automatic"))
    detected = F.coalesce(column("detected_direction", "string"), F.lit("automatic"))
    tall = F.contains("source_text", F.lit(IDEOGRAPHIC_SPACE)) | (F.col("height") > F.col("width") * 0.8)
    hangul = target.rlike(HANGUL)
    direction = (
        F.when(style != "automatic", style)
        .when(hangul, "horizontal")
        .when(target.rlike(LATIN) & ~target.rlike(KANA_AND_HAN), "horizontal")
        .when(detected != "automatic", detected)
        .when(both.rlike(ANY_EAST_ASIAN) & tall, "vertical")
        .otherwise("horizontal")
    )
    smallest = F.greatest(F.lit(4.0), F.coalesce(column("minimum_font", "double"), F.lit(9.0)))
    largest = F.least(F.lit(512.0), F.greatest(smallest, F.coalesce(column("maximum_font", "double"), F.lit(40.0))))
    pixels = F.greatest(F.lit(1.0), box.width * F.col("pixel_width") * box.height * F.col("pixel_height"))
    letters = F.greatest(F.lit(1), visible_length(F.col("source_text")))
    automatic = F.least(F.greatest(F.sqrt(pixels / letters) * 1.08, smallest), largest)
    return rows.select(
        "page_id", "region_id", "layout", anchor.alias("anchor"), direction.alias("direction"),
        (hangul & (direction == "vertical")).alias("korean_vertical"),
        F.coalesce(column("font_size", "double"), automatic).alias("font_size"),
    )
