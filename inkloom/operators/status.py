"""Where each page stands and what has to be done next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import is_blank, strip

ARTIFACT_KINDS = ("mask", "background", "preview", "output")
STABLE_STAGES = ("pending", "scanned", "maskReady", "translationReady", "completed", "failed")

# Share of the whole job that a stage starts at, and how much of it the stage fills.
STAGE_BANDS = {
    "pending": (0.0, 0.0),
    "scanned": (0.02, 0.0),
    "detectingText": (0.0, 0.25),
    "maskReady": (0.25, 0.0),
    "translating": (0.25, 0.4),
    "translationReady": (0.65, 0.0),
    "superResolving": (0.65, 0.35),
    "composing": (0.65, 0.35),
    "recognizing": (0.0, 0.15),
    "masking": (0.55, 0.05),
    "restoringBackground": (0.6, 0.25),
    "typesetting": (0.85, 0.15),
    "completed": (1.0, 0.0),
    "failed": (0.0, 0.0),
}


def artifact_flags(artifacts: DataFrame) -> DataFrame:
    """One row per page: ``has_<kind>`` and ``<kind>_at``."""
    columns = []
    for kind in ARTIFACT_KINDS:
        is_kind = F.col("kind") == kind
        columns.append(F.coalesce(F.bool_or(is_kind), F.lit(False)).alias(f"has_{kind}"))
        columns.append(F.max(F.when(is_kind, F.col("modified_at"))).alias(f"{kind}_at"))
    return artifacts.groupBy("page_id").agg(*columns)


def with_flags(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    joined = pages.join(artifact_flags(artifacts), "page_id", "left")
    return joined.withColumns({f"has_{k}": F.coalesce(F.col(f"has_{k}"), F.lit(False)) for k in ARTIFACT_KINDS})


def region_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("region_count"),
        F.count_if(is_blank(F.col("source_text"))).alias("missing_source"),
        F.count_if(is_blank(F.col("translated_text"))).alias("missing_translation"),
        F.count_if(~F.col("mask_complete")).alias("incomplete_masks"),
        F.count_if(F.col("translated_text") == "").alias("empty_translation"),
    )


REGION_COUNTS = ("region_count", "missing_source", "missing_translation", "incomplete_masks", "empty_translation")


def with_region_counts(pages: DataFrame, regions: DataFrame) -> DataFrame:
    joined = pages.join(region_counts(regions), "page_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in REGION_COUNTS})


def next_action(region_source: str = "local") -> Column:
    start = "detectMasks" if region_source == "local" else "submitRegions"
    return (
        F.when(F.col("region_count") == 0, start)
        .when(~(F.col("has_mask") & F.col("has_background")), "detectMasks")
        .when(F.col("missing_source") > 0, "writeSourceText")
        .when((F.col("missing_translation") > 0) | ~F.col("has_preview"), "writeTranslation")
        .when(~F.col("has_output"), "compose")
        .otherwise("done")
    )


def page_task_summary(
    pages: DataFrame, regions: DataFrame, artifacts: DataFrame, region_source: str = "local"
) -> DataFrame:
    """Counts, artifact flags and the next action of every page."""
    state = with_flags(with_region_counts(pages, regions), artifacts)
    return state.select(
        *pages.columns,
        "region_count",
        "missing_source",
        "missing_translation",
        "incomplete_masks",
        "empty_translation",
        *[f"has_{k}" for k in ARTIFACT_KINDS],
        next_action(region_source).alias("next_action"),
    )


def workspace_pages(tasks: DataFrame, pending_only: bool = True) -> DataFrame:
    """The pages to list, each with the totals of its project."""
    totals = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("next_action") != "done").alias("pending_pages"),
    )
    listed = tasks.where(F.col("next_action") != "done") if pending_only else tasks
    return listed.join(totals, "project_id")


def workspace_totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("next_action") != "done").alias("pending_pages"),
    )


def stage_of_flags() -> Column:
    return (
        F.when(F.col("has_output"), "completed")
        .when(F.col("has_preview"), "translationReady")
        .when(F.col("has_mask") & F.col("has_background"), "maskReady")
        .otherwise("scanned")
    )


def derive_stage(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stage implied by the artifacts; a stored stage that was mid-work falls back to it with a note."""
    state = with_flags(pages, artifacts)
    derived = stage_of_flags()
    if "stage" not in pages.columns:
        return state.select(*pages.columns, derived.alias("stage"))
    stage = F.col("stage")
    interrupted = ~stage.isin(*STABLE_STAGES)
    lost = (
        ((stage == "translationReady") & ~F.col("has_preview"))
        | ((stage == "maskReady") & ~(F.col("has_mask") & F.col("has_background")))
        | ((stage == "completed") & ~F.col("has_output"))
    )
    return state.select(
        *[c for c in pages.columns if c not in ("stage", "error")],
        F.when(interrupted | lost, derived).otherwise(stage).alias("stage"),
        F.when(interrupted, F.lit("interrupted")).alias("error"),
    )


def stale_outputs(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Void outputs older than their preview, then derive the stage again."""
    state = with_flags(pages, artifacts)
    stale = F.coalesce(
        F.col("has_output") & F.col("has_preview") & (F.col("output_at") < F.col("preview_at")), F.lit(False)
    )
    state = state.withColumn("output_void", stale).withColumn("has_output", F.col("has_output") & ~stale)
    return state.select(*pages.columns, "output_void", "has_output", stage_of_flags().alias("stage"))


def project_summary(staged: DataFrame, updated_at: str) -> DataFrame:
    return staged.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("stage") == "completed").alias("completed_pages"),
        F.max(updated_at).alias("updated_at"),
    )


def job_progress(job_pages: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Share of settled pages and final status per job.

    ``job_pages(job_id, page_id, outcome)`` has one row per page with outcome
    completed, failed or null.  Jobs without pages (from ``jobs``) have progress 0.
    """
    done, failed = F.count_if(F.col("outcome") == "completed"), F.count_if(F.col("outcome") == "failed")
    rolled = job_pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("pages"), done.alias("completed"), failed.alias("failed")
    )
    if jobs is not None:
        rolled = jobs.join(rolled, "job_id", "left").na.fill(0, ["pages", "completed", "failed"])
    settled = F.col("completed") + F.col("failed")
    cancelled = F.coalesce(F.col("cancelled"), F.lit(False)) if "cancelled" in rolled.columns else F.lit(False)
    return rolled.withColumn(
        "progress", F.when(F.col("pages") > 0, settled / F.col("pages")).otherwise(F.lit(0.0))
    ).withColumn(
        "status",
        F.when(cancelled, "cancelled")
        .when(settled < F.col("pages"), "running")
        .when(F.col("failed") > 0, "completedWithErrors")
        .otherwise("completed"),
    )


def incomplete_counts(regions: DataFrame) -> DataFrame:
    """Per page: regions lacking a text, untranslated ones, and ones with a real quality warning."""
    blank_source, blank_target = is_blank(F.col("source_text")), is_blank(F.col("translated_text"))
    warned = F.exists("qa_flags", lambda f: f != "reviewAdjusted")
    return regions.groupBy("page_id").agg(
        F.count_if(blank_source | blank_target).alias("incomplete"),
        F.count_if(blank_target).alias("untranslated"),
        F.count_if(warned).alias("warned"),
    )


def search_pages(pages: DataFrame, query: str = "", stage: str = "all") -> DataFrame:
    """Case-insensitive substring over title and path, with a stage filter."""
    needle = query.strip().lower()
    kept = pages
    if needle:
        haystack = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("rel_path", F.lit(""))))
        kept = kept.where(F.contains(haystack, F.lit(needle)))
    if stage == "pending":
        return kept.where(F.col("stage").isin("pending", "scanned"))
    return kept if stage == "all" else kept.where(F.col("stage") == stage)


def stage_progress(stage: Column, fraction: Column) -> Column:
    """Overall 0..1 progress of a page from its stage and the fraction done in that stage."""
    value = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
    branches = [
        (stage == name, F.lit(start) + value * span) for name, (start, span) in STAGE_BANDS.items()
    ]
    return reduce(lambda chain, b: chain.when(*b), branches[1:], F.when(*branches[0]))


def project_stage_progress(events: DataFrame) -> DataFrame:
    return events.withColumn("progress", stage_progress(F.col("stage"), F.col("fraction")))


def available_operations(tasks: DataFrame) -> DataFrame:
    """Operations a page allows now, from its artifacts and region counts."""
    some = F.col("region_count") > 0
    operations = F.array_compact(
        F.array(
            F.lit("page.inspect"),
            F.lit("page.update"),
            F.when(F.col("has_mask") & F.col("has_background") & some, "page.prepare_agent_task"),
            F.when(some, "region.batch_update"),
            F.when(F.col("region_count") > 1, "region.reorder"),
            F.when(F.col("has_preview") & (F.col("empty_translation") == 0), "page.render"),
        )
    )
    return tasks.withColumn("operations", operations)


def render_scale(pages: DataFrame, images: DataFrame) -> DataFrame:
    """How much larger an image is than its page, never below 1."""
    width = F.col("image_width").cast("double") / F.greatest(F.col("pixel_width"), F.lit(1))
    height = F.col("image_height").cast("double") / F.greatest(F.col("pixel_height"), F.lit(1))
    return pages.join(images, "page_id").withColumn("scale", F.greatest(F.lit(1.0), F.least(width, height)))


def has_step_data(step: str) -> Column:
    if step == "mask":
        return F.col("has_mask") & F.col("has_background")
    if step == "translate":
        texts = (F.col("missing_source") == 0) & (F.col("missing_translation") == 0)
        return texts & (F.col("has_preview") | F.col("has_output"))
    if step == "compose":
        return F.col("has_output")
    return F.lit(True)


def pending_work(tasks: DataFrame, step: str, force: bool = False) -> DataFrame:
    """Pages whose data for ``step`` is missing, or all of them when forced."""
    return tasks if force else tasks.where(~has_step_data(step))


def pending_steps(tasks: DataFrame, steps: tuple[str, ...] = ("mask", "translate", "compose")) -> DataFrame:
    """(page_id, step) for every step whose data is missing, in one pass over the tasks."""
    missing = F.array_compact(F.array(*[F.when(~has_step_data(s), F.lit(s)) for s in steps]))
    return tasks.select("page_id", F.explode(missing).alias("step"))


def plan_stage_work(tasks: DataFrame, operation: str, force: bool = False) -> DataFrame:
    """Steps to run per page for a batch operation, why, and which kind of model each needs.

    ``tasks`` is the output of ``page_task_summary`` with a ``stage`` column.
    """
    some = F.col("region_count") > 0
    masked = F.col("has_mask") & F.col("has_background")
    translated = some & (F.col("missing_source") == 0) & (F.col("missing_translation") == 0)
    translation_ready = F.col("has_preview") & (~some | translated)
    composed = (F.col("stage") == "completed") & F.col("has_output")

    def step(rule: Column, name: str, reason: str, model: Column) -> Column:
        return F.when(rule, F.struct(F.lit(name).alias("step"), F.lit(reason).alias("reason"), model.alias("model_needed")))

    none, detector, translator = F.lit("none"), F.lit("detector"), F.lit("translation")
    needs_text = F.when(some & (F.lit(force) | ~translated), translator).otherwise(none)
    recipes = {
        "detectMasks": [step(F.lit(True), "detect", "requested", detector)],
        "translate": [step(F.lit(True), "translate", "forced" if force else "requested", needs_text)],
        "retranslate": [step(F.lit(True), "translate", "forced", F.when(some, translator).otherwise(none))],
        "extractText": [step(F.lit(True), "recognize", "requested", F.when(some, F.lit("recognizer")).otherwise(none))],
        "superResolve": [step(F.lit(True), "superResolve", "requested", F.lit("image"))],
        "compose": [step(F.lit(True), "compose", "requested", none)],
        "fullPage": [
            step(~masked, "detect", "no mask data", detector),
            step(
                ~translation_ready,
                "translate",
                "no translation data",
                F.when(~masked | (some & ~translated), translator).otherwise(none),
            ),
            step(~composed, "compose", "no current output", none),
        ],
    }
    planned = F.filter(F.array(*recipes[operation]), lambda s: s.isNotNull())
    return tasks.select("project_id", "page_id", F.posexplode(planned).alias("step_no", "s")).select(
        "project_id", "page_id", "step_no", "s.step", "s.reason", "s.model_needed"
    )


def folder_rollup(pages: DataFrame, path: str = "rel_path") -> DataFrame:
    """Pages, visible pages and selected pages under every folder prefix ('' is the root).

    ``pages`` may carry boolean ``visible`` and ``selected``.  Rows are summed
    per folder first, so the prefix expansion works on folders, not on pages.
    """
    parts = F.filter(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    flag = lambda name: F.col(name) if name in pages.columns else F.lit(False)
    per_folder = (
        pages.select("project_id", folders.alias("folders"), flag("visible").alias("v"), flag("selected").alias("s"))
        .groupBy("project_id", "folders")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("v"), F.count_if("s").alias("s"))
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size("folders")), lambda n: F.array_join(F.slice("folders", F.lit(1), n), "/")
    )
    return (
        per_folder.select("project_id", F.explode(prefixes).alias("folder"), "n", "v", "s")
        .groupBy("project_id", "folder")
        .agg(F.sum("n").alias("pages"), F.sum("v").alias("visible_pages"), F.sum("s").alias("selected_pages"))
    )


def url_path(url: Column) -> Column:
    """Path of a URL without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")


def trimmed_title(title: Column) -> Column:
    """A page title after an update: null when blank or longer than 200 characters."""
    clean = strip(title)
    return F.when((clean != "") & (F.length(clean) <= 200), clean)
