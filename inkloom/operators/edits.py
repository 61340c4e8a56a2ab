"""Region edits, edit batches, agent results, invalidation and edit history."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box
from inkloom.functions.text import is_blank, none_if_blank, strip
from inkloom.scale import ARRAY_GROUP_LIMIT, WINDOW_GROUP_LIMIT, hot_groups, number_rows, previous_values, split_hot
from inkloom.session import materialize, written

BATCH_SIZE = (1, 64)
HISTORY_LIMIT = 50
HEX_COLOUR = r"^#([0-9A-F]{3}|[0-9A-F]{6})$"
AUTOMATIC_COLOUR = "AUTO"


# --- normalisation -----------------------------------------------------------


def hex_colour(value: Column) -> Column:
    """``#RRGGBB`` in capitals, null when the text is no hex colour."""
    text = F.upper(strip(value))
    long_form = F.regexp_replace(text, r"^#(.)(.)(.)$", r"#$1$1$2$2$3$3")
    return F.when(text.rlike(HEX_COLOUR), long_form)


def erase_colour(value: Column) -> Column:
    text = F.upper(strip(value))
    return F.when(text == AUTOMATIC_COLOUR, AUTOMATIC_COLOUR).otherwise(
        F.coalesce(hex_colour(text), F.lit(AUTOMATIC_COLOUR))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    """Clamped value; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


# Default style, and the limits of its numbers.
STYLE_DEFAULTS = {"text_color": "#111111", "stroke_color": "#FFFFFF"}
STYLE_RANGES = {"stroke_width": (0.0, 20.0), "opacity": (0.0, 1.0), "rotation": (-180.0, 180.0)}
FONT_RANGE = (4.0, 512.0)


def normalize_styles(styles: DataFrame) -> DataFrame:
    """Colours and sizes within their limits; an erase colour keeps its ``AUTO`` value."""
    changes: dict[str, Column] = {}
    for name, fallback in STYLE_DEFAULTS.items():
        if name in styles.columns:
            changes[name] = F.coalesce(hex_colour(F.col(name)), F.lit(fallback))
    for name, (low, high) in STYLE_RANGES.items():
        if name in styles.columns:
            changes[name] = clamp(F.col(name), low, high)
    if "erase_color" in styles.columns:
        changes["erase_color"] = erase_colour(F.coalesce("erase_color", F.lit(AUTOMATIC_COLOUR)))
    return styles.withColumns(changes)


def normalize_regions(regions: DataFrame) -> DataFrame:
    """Impose the region invariants; ``fixes`` names the rules that changed a row.

    Ratios clamp to 0..1, flags are distinct and sorted, polygons need three points
    and clamp to the page, optional boxes clamp.  The main box is left as it is.
    """
    changes: dict[str, Column] = {}
    rules: list[Column] = []

    def change(name: str, value: Column, rule: str) -> None:
        changes[name] = value
        rules.append(F.when(~F.col(name).eqNullSafe(value), F.lit(rule)))

    for name in ("translation_confidence", "mask_coverage"):
        if name in regions.columns:
            change(name, clamp(F.col(name), 0.0, 1.0), name)
    if "qa_flags" in regions.columns:
        change("qa_flags", F.array_sort(F.array_distinct("qa_flags")), "qa_flags")
    if "mask_polygons" in regions.columns:
        inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        point = lambda p: F.struct(inside(p["x"]).alias("x"), inside(p["y"]).alias("y"))
        polygons = F.transform(F.filter("mask_polygons", lambda g: F.size(g) >= 3), lambda g: F.transform(g, point))
        change("mask_polygons", polygons, "mask_polygons")
    for name in ("bubble_bounds", "bubble_layout", "translation_bounds"):
        if name in regions.columns:
            box = Box.struct(F.col(name)).clamp().as_struct()
            change(name, F.when(F.col(name).isNotNull(), box), name)
    if "strokes" in regions.columns:
        stroke = lambda s: s.withField("diameter", clamp(s["diameter"], 0.001, 1.0))
        change("strokes", F.transform("strokes", stroke), "strokes")
    return regions.withColumns({**changes, "fixes": F.array_compact(F.array(*rules))})


def rule_counts(normalized: DataFrame) -> DataFrame:
    """Rows changed per rule."""
    return normalized.select(F.explode("fixes").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


# --- edits -------------------------------------------------------------------

SIMPLE_FIELDS = ("font_name", "font_weight", "text_alignment", "is_visible", "writing_direction", "automatic_mask")
TRI_STATE_BOXES = ("bubble_bounds", "translation_bounds")


def text_updates(columns: set[str], source: Column, target: Column) -> dict[str, Column]:
    """Columns of a region whose source and translation are replaced by what is not null."""
    edited = source.isNotNull()
    updates = {"source_text": F.coalesce(source, "source_text"), "translated_text": F.coalesce(target, "translated_text")}
    if "raw_source_text" in columns:
        updates["raw_source_text"] = F.when(edited, F.coalesce("raw_source_text", "source_text")).otherwise(F.col("raw_source_text"))
    if "text_confirmed" in columns:
        updates["text_confirmed"] = F.col("text_confirmed") | edited
    return updates


def apply_region_edits(regions: DataFrame, edits: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Apply patches in ``seq`` order.

    An absent plain field is null; a field that can also be cleared is a struct
    ``(present, value)``.  Most fields are simply the last value written.  Texts need
    the value before each edit, which is the previous row of the region's text
    history, so no region is ever folded in memory.
    """
    have, got = set(edits.columns), set(regions.columns)
    seq = F.col("seq")
    edits = written(edits)  # read once per history and once for the last values
    absent = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    source, target = absent("source_text", "string"), absent("translated_text", "string")

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), seq))

    # texts: one history row per edit that may change the source
    originals = regions.select(
        "region_id", F.col("source_text").alias("_source0"), F.col("translated_text").alias("_target0")
    )
    touched = edits.select("region_id", "seq", source.alias("_source"), target.alias("_target"))
    sources = previous_values(
        touched.where(F.col("_source").isNotNull()), ["region_id"], [seq], {"_before": "_source"}, limit
    ).select("region_id", "seq", "_before")
    texts = touched.where(F.col("_source").isNotNull() | F.col("_target").isNotNull()).join(originals, "region_id")
    texts = texts.join(sources, ["region_id", "seq"], "left")
    changed = F.col("_source").isNotNull() & (F.col("_source") != F.coalesce("_before", "_source0"))
    effect = F.when(F.col("_target").isNotNull(), F.col("_target")).when(changed, F.lit(""))
    texts = texts.withColumn("_effect", effect).where(F.col("_effect").isNotNull())
    texts = materialize(texts.select("region_id", "seq", "_effect", "_target", "_target0"))
    effects = previous_values(
        texts, ["region_id"], [seq], {"_held": "_effect"}, limit
    )
    translated = effects.groupBy("region_id").agg(
        F.max_by("_effect", "seq").alias("_new_target"),
        F.bool_or(F.col("_target").isNotNull() & (F.col("_target") != F.coalesce("_held", "_target0"))).alias("_reset"),
    )

    # everything else: the last value written, in one map-side combined aggregate
    aggregates = [last(source).alias("_new_source")]
    fields: list[str] = []
    for name in SIMPLE_FIELDS:
        if name in have and name in got:
            value = F.nullif(F.col(name), F.lit("")) if name == "font_name" else F.col(name)
            aggregates.append(last(value).alias("_new_" + name))
            fields.append(name)
    for name in ("text_color", "stroke_color"):
        if name in have and name in got:
            aggregates.append(last(hex_colour(F.col(name))).alias("_new_" + name))
            fields.append(name)
    for name, (low, high) in STYLE_RANGES.items():
        if name in have and name in got:
            finite = F.when(~F.isnan(name) & (F.abs(name) != float("inf")), F.col(name))
            aggregates.append(last(clamp(finite, low, high)).alias("_new_" + name))
            fields.append(name)
    bounds_edited = F.lit(False)
    if "bounds" in have:
        aggregates.append(last(F.col("bounds")).alias("_new_bounds"))
        bounds_edited = F.col("bounds").isNotNull()
    boxes = [name for name in TRI_STATE_BOXES if name in have and name in got]
    for name in boxes:
        value = F.col(name)
        aggregates.append(F.max_by(value, F.when(value["present"], seq)).alias("_new_" + name))
    if "translation_anchor" in have and "translation_anchor" in got:
        value = F.col("translation_anchor")
        aggregates.append(F.max_by(value, F.when(value["present"], seq)).alias("_new_translation_anchor"))
    if "font_size" in have and "font_size" in got:
        automatic = absent("automatic_font_size", "boolean")
        none = F.struct(F.lit(True).alias("present"), F.lit(None).cast("double").alias("value"))
        sized = F.struct(
            F.lit(True).alias("present"), clamp(F.col("font_size")["value"], *FONT_RANGE).alias("value")
        )
        event = F.when(F.coalesce(automatic, F.lit(False)), none).when(F.col("font_size")["present"], sized)
        aggregates.append(F.max_by(event, F.when(event.isNotNull(), seq)).alias("_new_font_size"))
    keeps_mask = F.coalesce(absent("keep_mask", "boolean"), F.lit(False))
    geometry = (source.isNotNull() & ~keeps_mask) | bounds_edited
    if "bubble_bounds" in have:
        geometry = geometry | F.coalesce(F.col("bubble_bounds")["present"], F.lit(False))
    aggregates.append(F.bool_or(geometry).alias("_geometry"))
    latest = edits.groupBy("region_id").agg(*aggregates).join(translated, "region_id", "left")

    joined = regions.join(latest, "region_id", "left")
    updates = text_updates(got, F.col("_new_source"), F.col("_new_target"))
    reset = F.coalesce("_reset", F.lit(False))
    if "translation_confidence" in got:
        updates["translation_confidence"] = F.when(~reset, F.col("translation_confidence"))
    if "qa_flags" in got:
        updates["qa_flags"] = F.when(reset, F.array().cast("array<string>")).otherwise(F.col("qa_flags"))
    for name in fields:
        updates[name] = F.coalesce("_new_" + name, name)
    if "bounds" in have:
        moved = Box.struct(F.col("_new_bounds")).clamp()
        for part, value in zip(("x", "y", "width", "height"), moved):
            updates[part] = F.when(F.col("_new_bounds").isNotNull(), value).otherwise(F.col(part))
    for name in boxes:
        new = F.col("_new_" + name)
        placed = F.when(new["value"].isNotNull(), Box.struct(new["value"]).clamp().as_struct())
        updates[name] = F.when(F.coalesce(new["present"], F.lit(False)), placed).otherwise(F.col(name))
    if "_new_translation_anchor" in joined.columns:
        new = F.col("_new_translation_anchor")
        spot = F.struct(clamp(new["value"]["x"], 0.0, 1.0).alias("x"), clamp(new["value"]["y"], 0.0, 1.0).alias("y"))
        spot = F.when(new["value"].isNotNull(), spot)
        updates["translation_anchor"] = F.when(F.coalesce(new["present"], F.lit(False)), spot).otherwise(F.col("translation_anchor"))
    if "_new_font_size" in joined.columns:
        new = F.col("_new_font_size")
        updates["font_size"] = F.when(F.coalesce(new["present"], F.lit(False)), new["value"]).otherwise(F.col("font_size"))
    void = F.coalesce("_geometry", F.lit(False))
    if "mask_polygons" in got:
        empty = F.filter("mask_polygons", lambda p: F.lit(False))
        updates["mask_polygons"] = F.when(void, empty).otherwise(F.col("mask_polygons"))
    for name in ("mask_refined", "mask_complete"):
        if name in got:
            updates[name] = F.col(name) & ~void
    if "mask_coverage" in got:
        updates["mask_coverage"] = F.when(~void, F.col("mask_coverage"))
    return joined.withColumns({**updates, "geometry_changed": void}).select(*regions.columns, "geometry_changed")


def audit_completeness(expected: DataFrame, returned: DataFrame, request: str = "request_id", key: str = "region_id") -> DataFrame:
    """Missing, unexpected and repeated ids per request; complete only when the sets are equal without repeats."""
    want = expected.select(request, key).distinct().withColumn("_want", F.lit(1))
    got = returned.groupBy(request, key).agg(F.count(F.lit(1)).alias("_got"))
    both = want.join(got, [request, key], "full_outer")
    audit = both.groupBy(request).agg(
        F.count_if(F.col("_got").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_got") > 1).alias("repeated"),
    )
    clean = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0)
    return audit.withColumn("complete", clean)


def judge_batches(revisions: DataFrame, regions: DataFrame, batches: DataFrame, patches: DataFrame) -> DataFrame:
    """Verdict per edit batch.

    ``batches(batch_id, page_id, seq, expected_revision)``; ``patches(batch_id,
    region_id, …)``.  Of the valid batches of a page the first one is accepted; the
    later ones hold a revision that is stale by then.
    """
    known = regions.select("page_id", "region_id", F.lit(True).alias("_known"))
    of_page = patches.select("batch_id", "region_id").join(batches.select("batch_id", "page_id"), "batch_id")
    per_id = of_page.groupBy("batch_id", "page_id", "region_id").agg(F.count(F.lit(1)).alias("_times"))
    checked = per_id.join(known, ["page_id", "region_id"], "left").groupBy("batch_id").agg(
        F.sum("_times").alias("_size"), F.max("_times").alias("_most"), F.bool_and(F.col("_known").isNotNull()).alias("_all_known")
    )
    judged = batches.join(checked, "batch_id", "left").join(revisions, "page_id", "left")
    low, high = BATCH_SIZE
    verdict = (
        F.when(F.col("revision").isNull(), "unknown page")
        .when(~F.coalesce(F.col("_size").between(low, high), F.lit(False)), "size")
        .when(F.col("expected_revision") != F.col("revision"), "conflict")
        .when(F.col("_most") > 1, "duplicate id")
        .when(~F.col("_all_known"), "unknown id")
        .otherwise("accepted")
    )
    judged = judged.withColumn("_verdict", verdict)
    first = (
        judged.where(F.col("_verdict") == "accepted")
        .groupBy("page_id")
        .agg(F.min_by("batch_id", F.struct("seq", "batch_id")).alias("_first"))
    )
    late = (F.col("_verdict") == "accepted") & (F.col("batch_id") != F.col("_first"))
    return judged.join(first, "page_id", "left").select(
        "batch_id", "page_id", "seq", F.when(late, "conflict").otherwise(F.col("_verdict")).alias("verdict")
    )


def commit_edit_batches(
    revisions: DataFrame, regions: DataFrame, batches: DataFrame, patches: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, regions after the accepted batches, page effects).

    Page effects list the touched pages with their new stage and voided artifacts.
    """
    verdicts = judge_batches(revisions, regions, batches, patches)
    accepted = verdicts.where(F.col("verdict") == "accepted").select("batch_id", "page_id", "seq")
    accepted = materialize(accepted)
    edits = materialize(patches.join(accepted.select("batch_id", "seq"), "batch_id"))
    updated = apply_region_edits(regions, edits)
    effects = (
        updated.join(accepted.select("page_id").distinct(), "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.bool_or("geometry_changed").alias("_geometry"), F.bool_or(F.col("translated_text") != "").alias("_translated"))
        .select(
            "page_id",
            F.when(~F.col("_geometry") & F.col("_translated"), "translating").otherwise("maskReady").alias("stage"),
            F.col("_geometry").alias("mask_void"),
            F.lit(True).alias("preview_void"),
            F.lit(True).alias("output_void"),
        )
    )
    return verdicts, updated, effects


def reorder_regions(pages: DataFrame, regions: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict per page, regions in their new order, page effects).

    ``pages(page_id, revision)``; ``orders(page_id, expected_revision, region_id, position)``
    lists every region of a page once, against its current revision.  An accepted order
    renumbers ``ord`` from 0, voids preview and output, and sets stage and progress.
    """
    sent = orders.groupBy("page_id").agg(
        F.min("expected_revision").alias("_low"), F.max("expected_revision").alias("_high")
    )
    own = regions.join(sent.select("page_id"), "page_id", "left_semi")
    audit = audit_completeness(own, orders, "page_id", "region_id")
    judged = sent.join(pages.select("page_id", "revision"), "page_id", "left").join(audit, "page_id", "left")
    current = (F.col("_low") == F.col("revision")) & (F.col("_high") == F.col("revision"))
    verdict = (
        F.when(F.col("revision").isNull(), "unknown page")
        .when(~F.coalesce(current, F.lit(False)), "conflict")
        .when(~F.coalesce("complete", F.lit(False)), "id set differs")
        .otherwise("accepted")
    )
    verdicts = materialize(judged.select("page_id", verdict.alias("verdict")))
    accepted = verdicts.where(F.col("verdict") == "accepted").select("page_id")
    placed = number_rows(
        orders.join(accepted, "page_id", "left_semi").select("page_id", "region_id", "position"),
        ["page_id"], [F.col("position"), F.col("region_id")], "_place",
    )
    moved = regions.join(placed.select("page_id", "region_id", "_place"), ["page_id", "region_id"], "left")
    kind = dict(regions.dtypes)["ord"]
    moved = moved.withColumn("ord", F.coalesce(F.col("_place") - 1, F.col("ord")).cast(kind)).select(*regions.columns)
    effects = (
        regions.join(accepted, "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.bool_or(F.col("translated_text") != "").alias("_translated"))
        .select(
            "page_id",
            F.when(F.col("_translated"), "translating").otherwise("maskReady").alias("stage"),
            F.lit(0.25).alias("progress"),
            F.lit(True).alias("preview_void"),
            F.lit(True).alias("output_void"),
        )
    )
    return verdicts, moved, effects


# Kinds of rows that meet in a page.
REGION, RESULT, PAGE = range(3)


def _judged(pages: DataFrame, regions: DataFrame, results: DataFrame, whole: bool) -> DataFrame:
    """Regions, results and pages, which meet by page in one shuffle, with what their windows tell.

    A region has the answer it got in ``_new_…``; ``_verdict`` stands in one row per page that results name (in each
    row of ``pages`` for it, if it is listed).  Results travel in the columns of a region that they replace.  Unless
    ``whole``, the rows serve the verdicts only, and no text travels but sources that may clear a translation.
    """
    filled = lambda text: ~is_blank(F.col(text))
    source = F.col("source_text") if whole else F.when(F.col("translated_text").isNull(), F.col("source_text"))
    replaced = {
        "source_text": source, "translated_text": F.col("translated_text"), "literal_text": F.col("literal_text"), "speaker": F.col("speaker"),
        "tone": F.col("tone"), "translation_confidence": clamp(F.col("confidence"), 0.0, 1.0), "qa_flags": F.col("flags"),
    }
    names = list(replaced) if whole else ["source_text"]
    own = regions.where(F.col("page_id").isNotNull()).select(
        *(regions.columns if whole else ["page_id", "region_id", "source_text"]), F.lit(REGION).alias("_kind"),
        filled("source_text").alias("_first"), filled("translated_text").alias("_second"),
    )
    given = results.select(
        "page_id", "region_id", F.lit(RESULT).alias("_kind"), F.col("expected_revision").alias("_token"),
        F.when(F.col("source_text").isNotNull(), filled("source_text")).alias("_first"),
        F.when(F.col("translated_text").isNotNull(), filled("translated_text")).alias("_second"),
        *[replaced[name].alias(name) for name in names],
    )
    listed = pages.where(F.col("page_id").isNotNull()).select(
        "page_id", F.lit(PAGE).alias("_kind"), F.col("revision").alias("_token"),
        F.col("has_mask").alias("_first"), F.col("has_background").alias("_second"),
    )
    # results and pages that were joined by page lie as the regions are dealt here, and are not dealt again
    rows = own.repartition("page_id").unionByName(given, allowMissingColumns=True).unionByName(listed, allowMissingColumns=True)
    kind, token = F.col("_kind"), F.col("_token")
    meeting, ordered = Window.partitionBy("page_id", "region_id"), Window.partitionBy("page_id").orderBy("region_id")
    page = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # all windows share one sort
    answer = lambda name: F.first(F.when(kind == RESULT, F.col(name)), ignorenulls=True).over(meeting)
    expected = F.when(kind == RESULT, token)
    rows = rows.withColumns(  # windows of pages come first: their shuffle, if any, serves those of regions too
        {
            "_low": F.min(expected).over(page), "_high": F.max(expected).over(page),
            "_results": F.count_if(kind == RESULT).over(page), "_pages": F.count_if(kind == PAGE).over(page),
        }
    )
    rows = rows.withColumns(
        {
            "_wanted": F.count_if(kind == REGION).over(meeting), "_got": F.count_if(kind == RESULT).over(meeting),
            "_source": answer("_first"), "_target": answer("_second"),  # of a repeated id any answer will do, as the audit fails
            **{"_new_" + name: answer(name) for name in names},
        }
    )
    kept = F.when(_clears(), F.lit(False)).otherwise(F.col("_second"))
    has_texts = F.coalesce("_source", "_first") & F.coalesce("_target", kept)
    matched = F.col("region_id").isNotNull() & (F.col("_wanted") > 0) & (F.col("_got") == 1)
    rows = rows.withColumns(
        {
            "_complete": F.bool_and(F.when(kind != PAGE, matched)).over(page),
            "_filled": F.bool_and(F.when(kind == REGION, has_texts)).over(page),
            "_row": F.row_number().over(ordered),
        }
    )
    same = (F.col("_low") == token) & (F.col("_high") == token)
    verdict = (
        F.when((kind != PAGE) | token.isNull(), "unknown page")
        .when(~same, "conflict")
        .when(~(F.col("_first") & F.col("_second")), "mask data required")
        .when(~F.col("_complete"), "id set differs")
        .when(~F.coalesce("_filled", F.lit(False)), "blank text")
        .otherwise("accepted")
    )
    judges = F.when(F.col("_pages") > 0, kind == PAGE).otherwise(F.col("_row") == 1)
    return rows.withColumn("_verdict", F.when(judges & (F.col("_results") > 0), verdict))


def _clears() -> Column:
    """Whether the answer has a new source, and no translation to replace the one of the old source."""
    return F.coalesce(F.col("_target").isNull() & (F.col("_new_source_text") != F.col("source_text")), F.lit(False))


def submit_agent_results(
    pages: DataFrame, regions: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(verdict per page, regions after the accepted results).

    ``pages(page_id, revision, has_mask, has_background)``; ``results(page_id,
    expected_revision, region_id, source_text, translated_text, literal_text, speaker,
    tone, confidence, flags)``.  A page's results must name exactly its regions, once
    each, and leave no text blank; geometry is never touched, metadata is replaced.
    """
    # nothing is computed before one of the two frames is read; each reads the inputs for itself
    verdicts = _judged(pages, regions, results, whole=False).where(F.col("_verdict").isNotNull())
    verdicts = verdicts.select(F.col("page_id").cast(results.schema["page_id"].dataType), F.col("_verdict").alias("verdict"))

    nowhere = regions.where(F.col("page_id").isNull())
    accepted = F.bool_or(F.col("_verdict") == "accepted").over(Window.partitionBy("page_id"))
    rows = _judged(pages, regions, results, whole=True).withColumn("_hit", F.coalesce(accepted, F.lit(False)))
    hit = F.col("_hit")
    target = F.coalesce("_new_translated_text", F.when(_clears(), F.lit("")))
    values = {
        "literal_text": F.col("_new_literal_text"),
        "extracted_source_text": none_if_blank(F.col("_new_literal_text")),
        "speaker": F.col("_new_speaker"),
        "tone": F.col("_new_tone"),
        "translation_confidence": F.col("_new_translation_confidence"),
        "qa_flags": F.coalesce("_new_qa_flags", F.array().cast("array<string>")),
    }
    updates = text_updates(set(regions.columns), F.when(hit, F.col("_new_source_text")), F.when(hit, target))
    updates |= {c: F.when(hit, value).otherwise(F.col(c)) for c, value in values.items() if c in regions.columns}
    keys = {c: F.col(c).cast(regions.schema[c].dataType) for c in ("page_id", "region_id")}
    updated = rows.where(F.col("_kind") == REGION).withColumns(updates | keys).select(*regions.columns)
    return verdicts, updated.union(nowhere)


# What each cause makes void.
INVALIDATION = {
    "edit": ("output",),
    "batch": ("preview", "output"),
    "geometry": ("mask", "background", "preview", "output"),
    "extraction": ("preview", "output"),
    "reset": ("mask", "background", "preview", "output", "sidecar"),
    "eraseColor": ("background", "preview", "output"),
    "defaultFont": ("output",),
}


def invalidate_artifacts(artifacts: DataFrame, causes: DataFrame) -> DataFrame:
    """Artifacts that survive the causes of their page.

    ``causes(page_id, cause)``.  An erase-colour change touches only pages that have a background.
    """
    void = F.create_map(
        *[part for cause, kinds in INVALIDATION.items() for part in (F.lit(cause), F.array(*[F.lit(k) for k in kinds]))]
    )
    lost = causes.select("page_id", "cause", F.explode(F.try_element_at(void, F.col("cause"))).alias("kind"))
    backed = artifacts.where(F.col("kind") == "background").select("page_id").distinct().withColumn("_backed", F.lit(True))
    lost = lost.join(backed, "page_id", "left").where((F.col("cause") != "eraseColor") | F.col("_backed"))
    return artifacts.join(lost.select("page_id", "kind").distinct(), ["page_id", "kind"], "left_anti")


def invalidate_stages(pages: DataFrame, causes: DataFrame, regions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """New ``stage`` of every page that has a cause (the strongest one decides)."""
    rank = {"edit": 1, "defaultFont": 1, "batch": 2, "extraction": 3, "eraseColor": 4, "geometry": 5, "reset": 6}
    strength = F.create_map(*[p for cause, n in rank.items() for p in (F.lit(cause), F.lit(n))])
    backed = artifacts.where(F.col("kind") == "background").select("page_id").distinct().withColumn("_backed", F.lit(True))
    live = causes.join(backed, "page_id", "left").where((F.col("cause") != "eraseColor") | F.col("_backed"))
    ranked = F.struct(F.try_element_at(strength, F.col("cause")), F.col("cause"))  # of equally strong causes the last by name
    worst = live.groupBy("page_id").agg(F.max_by("cause", ranked).alias("cause"))
    texts = regions.groupBy("page_id").agg(F.bool_or(F.col("translated_text") != "").alias("_translated"))
    translated = F.coalesce("_translated", F.lit(False))
    cause = F.col("cause")
    stage = (
        F.when(cause == "reset", "scanned")
        .when(cause.isin("geometry", "eraseColor"), "maskReady")
        .when(cause == "extraction", "translating")
        .when(cause == "batch", F.when(translated, "translating").otherwise("maskReady"))
        .otherwise(F.when(translated, "typesetting").otherwise("maskReady"))
    )
    return pages.join(worst, "page_id").join(texts, "page_id", "left").select("page_id", "cause", stage.alias("stage"))


def adopt_extraction(regions: DataFrame, extracted: DataFrame) -> DataFrame:
    """Regions with newly read text take it and lose their translation and its metadata."""
    new = extracted.where(~is_blank(F.col("source_text"))).select(
        "region_id", F.col("source_text").alias("_s"), F.col("raw_source_text").alias("_r")
    )
    joined = regions.join(new, "region_id", "left")
    hit = F.col("_s").isNotNull()
    updates = {
        "source_text": F.coalesce("_s", "source_text"),
        "raw_source_text": F.when(hit, F.col("_r")).otherwise(F.col("raw_source_text")),
        "translated_text": F.when(hit, "").otherwise(F.col("translated_text")),
    }
    for name in ("literal_text", "extracted_source_text", "speaker", "tone", "translation_confidence"):
        if name in regions.columns:
            updates[name] = F.when(~hit, F.col(name))
    if "qa_flags" in regions.columns:
        updates["qa_flags"] = F.when(hit, F.array().cast("array<string>")).otherwise(F.col("qa_flags"))
    return joined.withColumns(updates).select(*regions.columns)


def change_default_font(regions: DataFrame, old: str, new: str) -> DataFrame:
    """Only regions still on the former default font follow the change."""
    return regions.withColumn("font_name", F.when(F.col("font_name") == old, new).otherwise(F.col("font_name")))


def pending_masks(regions: DataFrame) -> DataFrame:
    """Regions to refine: without a mask, or refined but incomplete."""
    return regions.where((F.size("mask_polygons") == 0) | (F.col("mask_refined") & ~F.col("mask_complete")))


def merge_by_id(regions: DataFrame, refined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Take ``columns`` from the refined rows where there is one."""
    new = refined.select("region_id", F.lit(True).alias("_hit"), *[F.col(c).alias("_" + c) for c in columns])
    joined = regions.join(new, "region_id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in columns}).select(*regions.columns)


def duplicate_regions(regions: DataFrame, requests: DataFrame, offset: float = 0.025) -> DataFrame:
    """Insert a shifted, maskless copy right after each requested region; ``position`` is the new 1-based order."""
    copies = requests.select("page_id", "region_id", "new_id").join(regions, ["page_id", "region_id"])
    box = Box.columns()
    x = F.least(F.greatest(box.x + offset, F.lit(0.0)), F.greatest(F.lit(0.0), 1 - box.width))
    y = F.least(F.greatest(box.y + offset, F.lit(0.0)), F.greatest(F.lit(0.0), 1 - box.height))
    shifted = Box(x, y, box.width, box.height).clamp()
    changes = dict(zip(("x", "y", "width", "height"), shifted))
    if "mask_polygons" in regions.columns:
        changes["mask_polygons"] = F.filter("mask_polygons", lambda p: F.lit(False))
    for name in ("mask_refined", "mask_complete", "automatic_mask"):
        if name in regions.columns:
            changes[name] = F.lit(False)
    if "mask_coverage" in regions.columns:
        changes["mask_coverage"] = F.lit(None).cast("double")
    made = copies.withColumns(changes).withColumns({"_source": F.col("region_id"), "region_id": F.col("new_id"), "_copy": F.lit(1)})
    both = regions.withColumns({"_source": F.col("region_id"), "_copy": F.lit(0)}).unionByName(made.drop("new_id"))
    order = [F.col("ord"), F.col("_source"), F.col("_copy"), F.col("region_id").desc()]
    return number_rows(both, ["page_id"], order, "position").drop("_source", "_copy")


# --- merges ------------------------------------------------------------------


def merge_recognition(originals: DataFrame, recognized: DataFrame) -> DataFrame:
    """Take recognised texts by region id; geometry never changes and OCR maps are joined (new wins)."""
    fields = [c for c in ("raw_source_text", "source_text", "text_confirmed", "detected_direction", "extracted_source_text") if c in originals.columns]
    new = recognized.select(
        "region_id", F.lit(True).alias("_hit"), *[F.col(c).alias("_" + c) for c in [*fields, "ocr_results"]]
    )
    joined = originals.join(new, "region_id", "left")
    read = F.col("_hit").isNotNull() & ~is_blank(F.col("_source_text"))
    updates = {c: F.when(read, F.col("_" + c)).otherwise(F.col(c)) for c in fields}
    updates["ocr_results"] = join_maps(F.col("ocr_results"), F.col("_ocr_results"))
    return joined.withColumns(updates).select(*originals.columns)


def join_maps(first: Column, second: Column) -> Column:
    """Union of two maps, the second wins; independent of the session's duplicate-key setting."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.when(second.isNull(), first).when(first.isNull(), second).otherwise(F.map_concat(kept, second))


def ocr_merge(regions: DataFrame, ocr: DataFrame) -> DataFrame:
    """Store each model's result under its name; adopt its text only where the source is blank.

    ``ocr(region_id, model_id, text, confidence, direction)``; adopted text is never
    marked as confirmed.  With several models the first by name is adopted.
    """
    value = F.struct("text", "confidence", "direction")
    per_region = ocr.groupBy("region_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", value.alias("value"))))).alias("_ocr"),
        F.min_by(F.struct(strip(F.col("text")).alias("text"), "direction"), F.when(~is_blank(F.col("text")), F.col("model_id"))).alias("_read"),
    )
    joined = regions.join(per_region, "region_id", "left")
    adopt = is_blank(F.col("source_text")) & F.col("_read.text").isNotNull()
    updates = {
        "source_text": F.when(adopt, F.col("_read.text")).otherwise(F.col("source_text")),
        "raw_source_text": F.when(adopt, F.col("_read.text")).otherwise(F.col("raw_source_text")),
        "text_confirmed": F.col("text_confirmed") & ~adopt,
        "detected_direction": F.when(adopt & (F.col("_read.direction") != "automatic"), F.col("_read.direction")).otherwise(F.col("detected_direction")),
        "ocr_results": join_maps(F.col("ocr_results"), F.col("_ocr")),
    }
    return joined.withColumns(updates).select(*regions.columns)


def merge_translations(originals: DataFrame, drafts: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovery overrides draft, draft overrides original; missing rows keep the original."""
    draft = drafts.select("region_id", F.col("translated_text").alias("_d"))
    late = recovered.select("region_id", F.col("translated_text").alias("_r"))
    joined = originals.join(draft, "region_id", "left").join(late, "region_id", "left")
    return joined.withColumn("translated_text", F.coalesce("_r", "_d", "translated_text")).select(*originals.columns)


# --- history -----------------------------------------------------------------

HISTORY = "struct<undo:array<string>,redo:array<string>,current:string>"


def _replay_in_order(keep: int):
    """Histories of pages whose log entries come sorted by page and time; holds one history at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, open_page, kind = None, False, None
        undo, redo, current = [], [], ""

        def told() -> pa.RecordBatch:
            row = {"page_id": pa.array([page], kind), "undo": [undo], "redo": [redo], "current": [current]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("page_id", kind), ("undo", pa.list_(pa.string())), ("redo", pa.list_(pa.string())), ("current", pa.string())]))

        for batch in batches:
            kind = batch.schema.field("page_id").type
            for of, first, action, state in zip(*(batch.column(c).to_pylist() for c in ("page_id", "_s0", "action", "state"))):
                if not open_page or of != page:
                    if open_page:
                        yield told()
                    page, open_page, undo, redo, current = of, True, [], [], first
                if action == "edit":
                    if (undo[-1] if undo else None) != current:
                        undo.append(current)
                    undo, redo, current = undo[-keep:], [], state
                elif action == "undo" and undo:
                    redo.append(current)
                    current = undo.pop()
                elif action == "redo" and redo:
                    undo.append(current)
                    current = redo.pop()
        if open_page:
            yield told()

    return run


def replay_edits(log: DataFrame, start: DataFrame | None = None, keep: int = HISTORY_LIMIT, limit: int = ARRAY_GROUP_LIMIT) -> DataFrame:
    """Undo and redo stacks after replaying an edit log.

    ``log(page_id, seq, action, state)``: 'edit' moves to ``state`` and remembers the
    former one (unless it equals the last remembered), keeps the last ``keep`` and
    clears the redo stack; 'undo' and 'redo' step once.  A page with up to ``limit``
    entries is folded over one array; the entries of longer logs stream past one history
    of the page, sorted by Spark, so the number of jobs does not depend on their length.
    """
    entries = log.select("page_id", "seq", "action", "state")
    if start is None:
        entries = entries.withColumn("_s0", F.lit(""))
    else:
        first = start.select("page_id", F.coalesce("state", F.lit("")).alias("_s0"))
        entries = entries.join(first, "page_id", "left").withColumn("_s0", F.coalesce("_s0", F.lit("")))
    cold, hot = split_hot(entries, ["page_id"], hot_groups(log, ["page_id"], limit))
    empty = F.array().cast("array<string>")

    def last(stack: Column) -> Column:
        return F.try_element_at(stack, F.lit(-1))

    def drop_last(stack: Column) -> Column:
        return F.slice(stack, F.lit(1), F.size(stack) - 1)

    def packed(undo: Column, redo: Column, current: Column) -> Column:
        return F.struct(undo.alias("undo"), redo.alias("redo"), current.alias("current"))

    def step(h: Column, entry: Column) -> Column:
        undo, redo, now = h["undo"], h["redo"], h["current"]
        grown = F.when(last(undo).eqNullSafe(now), undo).otherwise(F.concat(undo, F.array(now)))
        cut = F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), F.lit(keep))
        edited = packed(cut, empty, entry["state"])
        undone = packed(drop_last(undo), F.concat(redo, F.array(now)), last(undo))
        redone = packed(F.concat(undo, F.array(now)), drop_last(redo), last(redo))
        return (
            F.when(entry["action"] == "edit", edited)
            .when((entry["action"] == "undo") & (F.size(undo) > 0), undone)
            .when((entry["action"] == "redo") & (F.size(redo) > 0), redone)
            .otherwise(h)
        )

    listed = cold.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "state"))).alias("_log"), F.first("_s0").alias("_s0"))
    fresh = packed(empty, empty, F.col("_s0")).cast(HISTORY)
    out = listed.select("page_id", F.aggregate("_log", fresh, step).alias("h")).select("page_id", "h.undo", "h.redo", "h.current")
    if hot is None:
        return out
    ordered = hot.repartition("page_id").sortWithinPartitions("page_id", "seq", "action", "state")
    schema = f"page_id {dict(log.dtypes)['page_id']}, undo array<string>, redo array<string>, current string"
    return out.unionByName(ordered.mapInArrow(_replay_in_order(keep), schema))


def tail_log(entries: DataFrame, keep: int = 500, message_length: int = 8000, category_length: int = 80) -> DataFrame:
    """The last ``keep`` entries per application, texts trimmed and cut to their lengths, blank messages dropped."""
    from inkloom.scale import top_rows

    message = F.left(strip(F.col("message")), F.lit(message_length))
    category = F.left(strip(F.col("category")), F.lit(category_length))
    clean = entries.withColumns(
        {"message": message, "category": F.when(category == "", "App").otherwise(F.coalesce(category, F.lit("App")))}
    ).where(F.col("message") != "")
    return top_rows(clean, ["app"], [F.col("ts").desc(), F.col("entry_id").desc()], keep, "age")


def recover_jobs(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """Jobs found queued or running after a restart are cancelled."""
    open_job = F.col("status").isin("queued", "running")
    return jobs.withColumns(
        {
            "current_page": F.when(~open_job, F.col("current_page")),
            "finished_at": F.when(open_job, F.current_timestamp() if now is None else now).otherwise(F.col("finished_at")),
            "status": F.when(open_job, "cancelled").otherwise(F.col("status")),
        }
    )
