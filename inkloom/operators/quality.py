"""Translation checks, application of model output, and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import clip01
from inkloom.functions.text import (
    cluster_length,
    compact,
    multiset_overlap,
    none_if_blank,
    number_tokens,
    strip,
    visible_length,
)
from inkloom.operators.glossary import glossary_hits
from inkloom.scale import WINDOW_GROUP_LIMIT, ranked_values

# The flags a translation may carry.
QA_FLAGS = (
    "missingTranslation",
    "glossaryMismatch",
    "numberMismatch",
    "excessiveLength",
    "modelUncertain",
    "sourceTextLeak",
    "reviewAdjusted",
)
# Fixed values per length mode: longest translation accepted, and the budget named in a prompt.
LENGTH_LIMIT = {"faithful": 2.4, "balanced": 1.8, "compact": 1.35}
LENGTH_BUDGET = {"faithful": 2.0, "balanced": 1.55, "compact": 1.2}
# Transcript kinds kept, and the openings that mark a sound effect.
ACCEPTED_KINDS = ("dialogue", "caption", "title")
SOUND_EFFECT_PREFIXES = ("sfx:", "sfx：", "soundeffect:")


def sorted_flags(*rules: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*rules))))


def qa_check(regions: DataFrame, glossary: DataFrame | None, language: str, mode: str = "balanced") -> DataFrame:
    """Sorted quality flags per region in ``qa_flags``.

    A glossary term counts for a region only when it occurs in the region's own
    text, so the term hits are found per region and never paired page-wide.
    """
    translated = strip(F.col("translated_text"))
    checked = regions
    mismatch: Column = F.lit(False)
    if glossary is not None:
        wrong = (
            glossary_hits(regions, glossary, language, carry=["source_text", "translated_text"])
            .where(
                F.contains(F.lower("source_text"), F.lower("source_term"))
                & ~F.contains(F.lower(translated), F.lower("preferred_translation"))
            )
            .select("page_id", "region_id", F.lit(True).alias("_mismatch"))
            .distinct()
        )
        checked = regions.join(wrong, ["page_id", "region_id"], "left")
        mismatch = F.coalesce(F.col("_mismatch"), F.lit(False))
    too_long = cluster_length(translated) > F.greatest(F.lit(1), cluster_length(F.col("source_text"))) * LENGTH_LIMIT[mode]
    flags = sorted_flags(
        F.when(translated == "", "missingTranslation"),
        F.when(F.col("translation_confidence") < 0.65, "modelUncertain"),
        F.when(mismatch, "glossaryMismatch"),
        F.when(number_tokens(F.col("source_text")) != number_tokens(translated), "numberMismatch"),
        F.when(too_long, "excessiveLength"),
    )
    return checked.withColumn("qa_flags", flags).drop("_mismatch")


def qa_summary(flagged: DataFrame) -> DataFrame:
    """Flag frequencies and the share of flagged regions, per project and overall (project null)."""
    per_flag = flagged.select("project_id", F.explode_outer("qa_flags").alias("flag"))
    counted = per_flag.groupBy("project_id", "flag").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.where(F.col("flag").isNotNull())
        .rollup("flag", "project_id")
        .agg(F.sum("n").alias("regions"), F.grouping("project_id").alias("all_projects"))
        .where(F.col("flag").isNotNull())
    )


def warning_share(flagged: DataFrame) -> DataFrame:
    """Per project: pages, pages with a warning other than ``reviewAdjusted``, and their share."""
    warned = F.exists("qa_flags", lambda f: f != "reviewAdjusted")
    pages = flagged.groupBy("project_id", "page_id").agg(F.bool_or(warned).alias("warned"))
    return pages.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("warned").alias("warned_pages"),
        F.avg(F.col("warned").cast("double")).alias("share"),
    )


def apply_translations(
    regions: DataFrame,
    items: DataFrame,
    drafts: DataFrame | None = None,
    preserve_literal: bool = True,
) -> DataFrame:
    """Put model items on their regions.

    ``items(region_id, literal, display, translated, speaker, tone, confidence, flags)``
    has one row per region.  With ``drafts(region_id, display)`` a display text that
    differs from its draft is flagged ``reviewAdjusted``.  A region without a usable
    item keeps its texts and is flagged ``missingTranslation``.
    """
    display = none_if_blank(F.coalesce("display", "translated"))
    usable = items.select(
        "region_id",
        display.alias("_display"),
        none_if_blank(F.col("literal")).alias("_literal"),
        none_if_blank(F.col("speaker")).alias("_speaker"),
        none_if_blank(F.col("tone")).alias("_tone"),
        F.when(F.col("confidence").isNotNull(), clip01(F.col("confidence"))).alias("_confidence"),
        F.col("flags").alias("_flags"),
    ).where(F.col("_display").isNotNull())
    joined = regions.join(usable, "region_id", "left")
    adjusted: Column = F.lit(None).cast("string")
    if drafts is not None:
        joined = joined.join(
            drafts.select("region_id", none_if_blank(F.col("display")).alias("_draft")), "region_id", "left"
        )
        adjusted = F.when(~F.col("_draft").eqNullSafe(F.col("_display")), F.lit("reviewAdjusted"))
    has = F.col("_display").isNotNull()
    known = F.array(*[F.lit(f) for f in QA_FLAGS])
    own = F.array_intersect(F.coalesce("_flags", F.array().cast("array<string>")), known)
    kept = F.coalesce("qa_flags", F.array().cast("array<string>"))
    literal = F.coalesce("_literal", "_display") if preserve_literal else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "literal_text": F.when(has, literal).otherwise(F.col("literal_text")),
            "translated_text": F.coalesce("_display", "translated_text"),
            "speaker": F.when(has, F.col("_speaker")).otherwise(F.col("speaker")),
            "tone": F.when(has, F.col("_tone")).otherwise(F.col("tone")),
            "translation_confidence": F.when(has, F.col("_confidence")).otherwise(F.col("translation_confidence")),
            "qa_flags": F.array_sort(
                F.when(has, F.array_union(own, F.array_compact(F.array(adjusted)))).otherwise(
                    F.array_union(kept, F.array(F.lit("missingTranslation")))
                )
            ),
        }
    ).select(*regions.columns)


def normalize_script(
    rows: DataFrame, mapping: DataFrame, language: str = "lang", text: str = "translated_text"
) -> DataFrame:
    """Fold Chinese translations into the script their target language asks for.

    ``mapping(script, from_char, to_char)`` is the caller's table of single characters
    for scripts ``zh-hant`` and ``zh-hans``; other targets are untouched.  Of several rows
    for one character the smallest ``to_char`` counts.  A script is at most one row per
    character of Unicode, so its two strings are broadcast.
    """
    single = mapping.where((F.length("from_char") == 1) & (F.length("to_char") == 1) & F.col("script").isin("zh-hant", "zh-hans"))
    entry = F.struct("from_char", "to_char")
    tables = (
        single.groupBy("script", "from_char")
        .agg(F.min("to_char").alias("to_char"))
        .groupBy(F.col("script").alias("_script"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_pairs"))
        .select(
            "_script",
            F.array_join(F.transform("_pairs", lambda p: p["from_char"]), "").alias("_from"),
            F.array_join(F.transform("_pairs", lambda p: p["to_char"]), "").alias("_to"),
        )
    )
    tag = F.lower(F.replace(F.col(language), F.lit("_"), F.lit("-")))
    keyed = rows.withColumn("_script", F.regexp_extract(tag, "^(zh-han[ts])(?:-.*)?$", 1))
    joined = keyed.join(F.broadcast(tables), "_script", "left")
    fold = F.call_function("translate", F.col(text), F.col("_from"), F.col("_to"))
    return joined.withColumn(text, F.when(F.col("_from").isNull(), F.col(text)).otherwise(fold)).select(*rows.columns)


def accept_transcripts(items: DataFrame) -> DataFrame:
    """Keep dialogue, captions and titles with visible text that is not a sound effect."""
    packed = compact(F.col("text"))
    effect = F.lit(False)
    for prefix in SOUND_EFFECT_PREFIXES:
        effect = effect | F.startswith(packed, F.lit(prefix))
    kind = F.lower(strip(F.col("kind")))
    return (
        items.where(kind.isin(*ACCEPTED_KINDS) & (packed != "") & ~effect)
        .withColumn("text", strip(F.col("text")))
        .withColumn("kind", kind)
    )


def plausible_boxes(
    regions: DataFrame, per_character: float = 0.008, blank_area: float | None = None, text: str = "source_text"
) -> DataFrame:
    """Regions whose area per visible character is believable.

    Without visible text a region is kept only when ``blank_area`` allows its area.
    """
    area, visible = F.col("width") * F.col("height"), visible_length(F.col(text))
    blank_ok = F.lit(False)
    if blank_area is not None:
        blank_ok = (F.col("width") > 0) & (F.col("height") > 0) & (area <= blank_area)
    return regions.where(F.when(visible > 0, area / visible <= per_character).otherwise(blank_ok))


def char_overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Multiset share of the shorter text's characters that the longer one has, in one row expression."""
    return pairs.withColumn("overlap", multiset_overlap(compact(F.col(left)), compact(F.col(right))))


def accuracy_report(matches: DataFrame, expected: str = "expected", observed: str = "observed") -> DataFrame:
    """Exact lines, edits and character error rate per page and overall (page null).

    Equal pairs of a page are counted first, so each is scored once, and a line that
    repeats any number of times is one row after the map side.
    """
    counted = matches.groupBy("page", expected, observed).agg(F.count(F.lit(1)).alias("_n"))
    scored = counted.select(
        "page",
        "_n",
        (F.col(expected) == F.col(observed)).alias("exact"),
        F.levenshtein(expected, observed).alias("edits"),
        F.length(expected).alias("chars"),
    )
    return (
        scored.rollup("page")
        .agg(
            F.sum("_n").alias("lines"),
            F.sum(F.when(F.col("exact"), F.col("_n")).otherwise(0)).alias("exact_lines"),
            F.sum(F.col("edits") * F.col("_n")).alias("edits"),
            F.sum(F.col("chars") * F.col("_n")).alias("characters"),
            F.grouping("page").cast("int").alias("overall"),
        )
        .withColumn("cer", F.when(F.col("characters") > 0, F.col("edits") / F.col("characters")))
    )


def latency_report(samples: DataFrame, numbered: DataFrame, limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """First call and median of the warm calls (after the third) per model and configuration.

    ``numbered`` is ``samples`` with the 1-based ``iteration`` of each call.
    """
    runs = numbered.groupBy("model", "configuration").agg(F.count(F.lit(1)).alias("calls"))
    warm = numbered.join(runs, ["model", "configuration"]).where(
        F.col("iteration") > F.least(F.lit(3), F.col("calls") - 1)
    )
    middle = {"_low": F.floor((F.col("_n") - 1) / 2), "_high": F.floor(F.col("_n") / 2)}
    medians = ranked_values(warm, ["model", "configuration"], "ms", middle, limit).select(
        "model", "configuration", (F.col("_low") * 0.5 + F.col("_high") * 0.5).alias("warm_median_ms")
    )
    cold = numbered.where(F.col("iteration") == 1).select("model", "configuration", F.col("ms").alias("cold_ms"))
    report = runs.join(medians, ["model", "configuration"], "left").join(cold, ["model", "configuration"])
    if "load_ms" in samples.columns:
        loads = samples.groupBy("model", "configuration").agg(F.max("load_ms").alias("load_ms"))
        report = report.join(loads, ["model", "configuration"])
    return report


def output_delta(samples: DataFrame, baseline: object) -> DataFrame:
    """Largest absolute difference of a configuration's output to the baseline configuration.

    ``samples(model, configuration, position, value)`` is the exploded last output.
    """
    keyed = ["model", "position"]
    reference = samples.where(F.col("configuration") == baseline).select(*keyed, F.col("value").alias("_base"))
    return (
        samples.join(reference, keyed)
        .groupBy("model", "configuration")
        .agg(F.max(F.abs(F.col("value") - F.col("_base"))).alias("max_delta"))
    )


def device_histogram(operations: DataFrame, devices: list[str]) -> DataFrame:
    """Operations per device, one column per device."""
    return operations.groupBy("model", "configuration").pivot("device", devices).count().na.fill(0)
