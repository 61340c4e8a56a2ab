"""Status, planning and roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.operators import sets, status
from inkloom.plans.catalog import query

TASK_VIEWS = ("fx_pages", "fx_regions", "fx_artifacts")
TASKS_SQL = """
flags AS (
  SELECT page_id, bool_or(kind = 'mask') AS has_mask, bool_or(kind = 'background') AS has_background,
         bool_or(kind = 'preview') AS has_preview, bool_or(kind = 'output') AS has_output,
         max(CASE WHEN kind = 'preview' THEN modified_at END) AS preview_at,
         max(CASE WHEN kind = 'output' THEN modified_at END) AS output_at
  FROM fx_artifacts GROUP BY page_id),
counts AS (
  SELECT page_id, count(*) AS region_count, count(*) FILTER (trim(source_text) = '') AS missing_source,
         count(*) FILTER (trim(translated_text) = '') AS missing_translation,
         count(*) FILTER (NOT mask_complete) AS incomplete_masks
  FROM fx_regions GROUP BY page_id),
state AS (
  SELECT p.*, coalesce(region_count, 0) AS region_count, coalesce(missing_source, 0) AS missing_source,
         coalesce(missing_translation, 0) AS missing_translation, coalesce(incomplete_masks, 0) AS incomplete_masks,
         coalesce(has_mask, false) AS has_mask, coalesce(has_background, false) AS has_background,
         coalesce(has_preview, false) AS has_preview, coalesce(has_output, false) AS has_output,
         preview_at, output_at
  FROM fx_pages p LEFT JOIN counts USING (page_id) LEFT JOIN flags USING (page_id)),
tasks AS (
  SELECT *, CASE WHEN region_count = 0 THEN 'detectMasks' WHEN NOT (has_mask AND has_background) THEN 'detectMasks'
                 WHEN missing_source > 0 THEN 'writeSourceText'
                 WHEN missing_translation > 0 OR NOT has_preview THEN 'writeTranslation'
                 WHEN NOT has_output THEN 'compose' ELSE 'done' END AS next_action,
         CASE WHEN has_output THEN 'completed' WHEN has_preview THEN 'translationReady'
              WHEN has_mask AND has_background THEN 'maskReady' ELSE 'scanned' END AS stage
  FROM state)
"""


def epoch_seconds(name):
    """Seconds since 1970 of a zone-less timestamp, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))


def tasks(v):
    return status.page_task_summary(v.pages(), v.regions(), v.artifacts())


def staged(v):
    return tasks(v).withColumn("stage", status.stage_of_flags())


@query(
    "page_task_summary",
    f"""WITH {TASKS_SQL} SELECT page_id, project_id, title, rel_path, region_count, missing_source, missing_translation,
    incomplete_masks, has_mask, has_background, has_preview, has_output, next_action FROM tasks""",
    TASK_VIEWS,
)
def _(v):
    return tasks(v).drop("pixel_width", "pixel_height", "empty_translation")


@query(
    "workspace_pages",
    f"""WITH {TASKS_SQL}, totals AS (SELECT project_id, count(*) AS total_pages,
      count(*) FILTER (next_action <> 'done') AS pending_pages FROM tasks GROUP BY project_id)
    SELECT project_id, page_id, next_action, total_pages, pending_pages
    FROM tasks JOIN totals USING (project_id) WHERE next_action <> 'done'""",
    TASK_VIEWS,
)
def _(v):
    return status.workspace_pages(tasks(v)).select(
        "project_id", "page_id", "next_action", "total_pages", "pending_pages"
    )


@query(
    "project_summary",
    f"""WITH {TASKS_SQL}, latest AS (SELECT page_id, max(modified_at) AS touched FROM fx_artifacts GROUP BY page_id)
    SELECT project_id, count(*) AS page_count, count(*) FILTER (stage = 'completed') AS completed_pages,
           epoch(max(touched))::BIGINT AS updated_at
    FROM tasks LEFT JOIN latest USING (page_id) GROUP BY project_id""",
    TASK_VIEWS,
)
def _(v):
    latest = v.artifacts().groupBy("page_id").agg(F.max("modified_at").alias("touched"))
    pages = status.derive_stage(v.pages(), v.artifacts()).join(latest, "page_id", "left")
    return status.project_summary(pages, "touched").withColumn("updated_at", epoch_seconds("updated_at"))


@query("derive_stage", f"WITH {TASKS_SQL} SELECT page_id, stage FROM tasks", TASK_VIEWS)
def _(v):
    return status.derive_stage(v.pages(), v.artifacts()).select("page_id", "stage")


@query(
    "restore_stage",
    f"""WITH {TASKS_SQL}, stored AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'translating' WHEN 1 THEN 'completed'
          WHEN 2 THEN 'translationReady' WHEN 3 THEN 'maskReady' WHEN 4 THEN 'failed' ELSE 'pending' END AS kept FROM tasks)
    SELECT page_id,
      CASE WHEN kept = 'translating' OR (kept = 'translationReady' AND NOT has_preview)
             OR (kept = 'maskReady' AND NOT (has_mask AND has_background)) OR (kept = 'completed' AND NOT has_output)
           THEN stage ELSE kept END AS stage,
      CASE WHEN kept = 'translating' THEN 'interrupted' END AS error FROM stored""",
    TASK_VIEWS,
)
def _(v):
    names = F.array(
        *[F.lit(s) for s in ("translating", "completed", "translationReady", "maskReady", "failed", "pending")]
    )
    stored = v.pages().select("page_id", F.get(names, (F.col("page_id") % 6).cast("int")).alias("stage"))
    return status.derive_stage(stored, v.artifacts())


@query(
    "stale_outputs",
    f"""WITH {TASKS_SQL}, judged AS (SELECT *, coalesce(has_output AND has_preview AND output_at < preview_at, false) AS output_void FROM state)
    SELECT page_id, output_void, has_output AND NOT output_void AS has_output,
      CASE WHEN has_output AND NOT output_void THEN 'completed' WHEN has_preview THEN 'translationReady'
           WHEN has_mask AND has_background THEN 'maskReady' ELSE 'scanned' END AS stage FROM judged""",
    TASK_VIEWS,
)
def _(v):
    return status.stale_outputs(v.pages().select("page_id"), v.artifacts())


JOB_PAGES_SQL = """
job_pages AS (SELECT job_id, page_id,
    CASE arg_max(kind, event_id) WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' END AS outcome
  FROM fx_events GROUP BY job_id, page_id)
"""


def job_pages(v):
    last = v.events().groupBy("job_id", "page_id").agg(F.max_by("kind", "event_id").alias("kind"))
    return last.select(
        "job_id", "page_id", F.when(F.col("kind").isin("completed", "failed"), F.col("kind")).alias("outcome")
    )


@query(
    "job_progress",
    f"""WITH {JOB_PAGES_SQL} SELECT job_id, pages, completed, failed, round((completed + failed)::DOUBLE / pages, 6) AS progress,
      CASE WHEN completed + failed < pages THEN 'running' WHEN failed > 0 THEN 'completedWithErrors' ELSE 'completed' END AS status
    FROM (SELECT job_id, count(*) AS pages, count(*) FILTER (outcome = 'completed') AS completed,
                 count(*) FILTER (outcome = 'failed') AS failed FROM job_pages GROUP BY job_id)""",
    ("fx_events",),
)
def _(v):
    return status.job_progress(job_pages(v)).withColumn("progress", F.round("progress", 6))


@query(
    "incomplete_counts",
    """SELECT page_id, count(*) FILTER (source_text = '' OR translated_text = '') AS incomplete,
      count(*) FILTER (translated_text = '') AS untranslated,
      count(*) FILTER (partkey % 5 = 0 OR confidence < 0.3) AS warned FROM fx_regions GROUP BY page_id""",
    ("fx_regions",),
)
def _(v):
    flags = F.array_compact(
        F.array(
            F.when(F.col("partkey") % 2 == 0, "reviewAdjusted"),
            F.when(F.col("partkey") % 5 == 0, "numberMismatch"),
            F.when(F.col("confidence") < 0.3, "modelUncertain"),
        )
    )
    return status.incomplete_counts(v.regions().withColumn("qa_flags", flags))


@query(
    "search_pages",
    f"""WITH {TASKS_SQL} SELECT page_id, title, rel_path, stage FROM tasks
    WHERE contains(lower(title || ' ' || rel_path), 'p7') AND stage IN ('pending', 'scanned')""",
    TASK_VIEWS,
)
def _(v):
    return status.search_pages(status.derive_stage(v.pages(), v.artifacts()), " P7 ", "pending").select(
        "page_id", "title", "rel_path", "stage"
    )


@query(
    "stage_progress",
    """SELECT event_id, stage, fraction, round(CASE stage WHEN 'detectingText' THEN 0.25 * fraction WHEN 'translating' THEN 0.25 + 0.4 * fraction
      WHEN 'composing' THEN 0.65 + 0.35 * fraction WHEN 'typesetting' THEN 0.85 + 0.15 * fraction WHEN 'scanned' THEN 0.02
      WHEN 'completed' THEN 1 ELSE 0 END::DOUBLE, 6) AS progress
    FROM (SELECT event_id, k::DOUBLE / 100 AS fraction,
       (['detectingText','translating','composing','typesetting','scanned','completed','failed'])[event_id % 7 + 1] AS stage FROM fx_events)""",
    ("fx_events",),
)
def _(v):
    stages = ("detectingText", "translating", "composing", "typesetting", "scanned", "completed", "failed")
    names = F.array(*[F.lit(s) for s in stages])
    events = v.events().select(
        "event_id", (F.col("k").cast("double") / 100).alias("fraction"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("stage")
    )
    return status.project_stage_progress(events).withColumn("progress", F.round("progress", 6))


@query(
    "available_operations",
    f"""WITH {TASKS_SQL}, empties AS (SELECT page_id, count(*) FILTER (translated_text = '') AS empty FROM fx_regions GROUP BY page_id)
    SELECT page_id, concat_ws(',', 'page.inspect', 'page.update',
      CASE WHEN has_mask AND has_background AND region_count > 0 THEN 'page.prepare_agent_task' END,
      CASE WHEN region_count > 0 THEN 'region.batch_update' END, CASE WHEN region_count > 1 THEN 'region.reorder' END,
      CASE WHEN has_preview AND coalesce(empty, 0) = 0 THEN 'page.render' END) AS operations
    FROM tasks LEFT JOIN empties USING (page_id)""",
    TASK_VIEWS,
)
def _(v):
    return status.available_operations(tasks(v)).select(
        "page_id", F.array_join("operations", ",").alias("operations")
    )


@query(
    "render_scale",
    """SELECT page_id, kind, round(greatest(1.0, least((pixel_width * (1 + page_id % 3))::DOUBLE / pixel_width,
        (pixel_height * (1 + page_id % 2))::DOUBLE / pixel_height)), 6) AS scale
    FROM fx_pages JOIN fx_artifacts USING (page_id)""",
    ("fx_pages", "fx_artifacts"),
)
def _(v):
    pages = v.pages()
    images = (
        v.artifacts()
        .join(pages, "page_id")
        .select(
            "page_id",
            "kind",
            (F.col("pixel_width") * (1 + F.col("page_id") % 3)).alias("image_width"),
            (F.col("pixel_height") * (1 + F.col("page_id") % 2)).alias("image_height"),
        )
    )
    return status.render_scale(pages, images).select("page_id", "kind", F.round("scale", 6).alias("scale"))


@query(
    "pending_work",
    f"""WITH {TASKS_SQL} SELECT page_id, 'mask' AS step FROM tasks WHERE NOT (has_mask AND has_background)
    UNION ALL SELECT page_id, 'translate' FROM tasks WHERE NOT (missing_source = 0 AND missing_translation = 0 AND (has_preview OR has_output))
    UNION ALL SELECT page_id, 'compose' FROM tasks WHERE NOT has_output""",
    TASK_VIEWS,
)
def _(v):
    return status.pending_steps(tasks(v))


@query(
    "plan_stage_work",
    f"""WITH {TASKS_SQL}, judged AS (SELECT *, has_mask AND has_background AS masked,
        region_count > 0 AND missing_source = 0 AND missing_translation = 0 AS translated FROM tasks)
    SELECT project_id, page_id, 'detect' AS step, 'no mask data' AS reason, 'detector' AS model_needed, 0 AS step_no FROM judged WHERE NOT masked
    UNION ALL SELECT project_id, page_id, 'translate', 'no translation data',
       CASE WHEN NOT masked OR (region_count > 0 AND NOT translated) THEN 'translation' ELSE 'none' END,
       (NOT masked)::INTEGER FROM judged WHERE NOT (has_preview AND (region_count = 0 OR translated))
    UNION ALL SELECT project_id, page_id, 'compose', 'no current output', 'none',
       (NOT masked)::INTEGER + (NOT (has_preview AND (region_count = 0 OR translated)))::INTEGER FROM judged WHERE NOT has_output""",
    TASK_VIEWS,
)
def _(v):
    return status.plan_stage_work(staged(v), "fullPage")


@query(
    "folder_rollup",
    f"""WITH {TASKS_SQL}, parts AS (SELECT project_id, page_id, has_output AS visible, page_id % 4 = 0 AS selected,
        list_slice(string_split(rel_path, '/'), 1, -2) AS folders FROM tasks),
    prefixes AS (SELECT project_id, visible, selected, array_to_string(list_slice(folders, 1, n), '/') AS folder
      FROM (SELECT *, unnest(range(0, len(folders) + 1)) AS n FROM parts))
    SELECT project_id, folder, count(*) AS pages, count(*) FILTER (visible) AS visible_pages,
      count(*) FILTER (selected) AS selected_pages FROM prefixes GROUP BY project_id, folder""",
    TASK_VIEWS,
)
def _(v):
    pages = status.with_flags(v.pages(), v.artifacts()).select(
        "project_id", "rel_path", F.col("has_output").alias("visible"), (F.col("page_id") % 4 == 0).alias("selected")
    )
    return status.folder_rollup(pages)


@query(
    "folder_rollup_urls",
    r"""WITH parts AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '/') AS p FROM pages),
    kept AS (SELECT list_filter(p, lambda s: s <> '') AS p FROM parts),
    folders AS (SELECT CASE WHEN len(p) > 1 THEN list_slice(p, 1, len(p) - 1) ELSE [] END AS f FROM kept)
    SELECT 0 AS project_id, array_to_string(list_slice(f, 1, n), '/') AS folder, count(*) AS pages
    FROM (SELECT f, unnest(range(0, len(f) + 1)) AS n FROM folders) GROUP BY folder""",
)
def _(v):
    pages = v.raw("pages").select(F.lit(0).alias("project_id"), status.url_path(F.col("url")).alias("rel_path"))
    return status.folder_rollup(pages).select("project_id", "folder", "pages")


@query(
    "intersect_selection",
    """WITH sel AS (SELECT DISTINCT o_custkey % 50 AS project_id, o_orderkey * 2 AS page_id FROM orders WHERE o_custkey % 50 <> 7),
    valid AS (SELECT p.project_id, p.page_id FROM fx_pages p SEMI JOIN sel s ON s.project_id = p.project_id AND s.page_id = p.page_id),
    firsts AS (SELECT project_id, min(page_id) AS page_id FROM fx_pages GROUP BY project_id)
    SELECT project_id, page_id FROM valid
    UNION ALL SELECT project_id, page_id FROM firsts WHERE project_id NOT IN (SELECT project_id FROM valid)""",
    ("fx_pages",),
)
def _(v):
    selection = (
        v.pages().where(F.col("project_id") != 7).select("project_id", (F.col("page_id") * 2).alias("page_id"))
    )
    return sets.intersect_selection(selection, v.pages(), "page_id")
