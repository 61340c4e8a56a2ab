"""Streaming and file round-trip queries.

Stream queries replay the whole event table through Structured Streaming and
return the final state; the SQL states what that state must be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.operators import quality
from inkloom.plans.catalog import query
from inkloom.session import scratch_path
from inkloom.sources import files
from inkloom.streaming import jobs


def events(v, order=None):
    """The event table as a stream; its micro-batches ascend by ``order`` where one is given."""
    if order is None:
        stream = jobs.stream_of(v.spark, v.directory, "events")
    else:
        stream = jobs.replay_of(v.spark, v.directory, "events", order)
    return stream.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


K = "regexp_extract(props, '[0-9]+', 0)::INTEGER AS k"


def stored_events(v):
    return v.raw("events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def page_events(v, stored=False):
    kind = F.col("event_type")
    return (stored_events(v) if stored else events(v, "event_id")).select(
        F.col("user_id").alias("page_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "started").when(kind == "view", "activity").when(kind == "click", "region")
        .when(kind == "error", "stage").otherwise(F.when(F.col("k") % 2 == 0, "completed").otherwise("failed")).alias("kind"),
        F.concat(F.lit("s"), F.col("k") % 3).alias("stage"),
        (F.col("k").cast("double") / 100).alias("fraction"),
        F.concat(F.lit("a"), F.col("k") % 2).alias("activity"),
        (F.col("k") - 5).alias("current"),
        F.col("k").alias("total"),
    )


PAGE_EVENTS_SQL = f"""
ev AS (SELECT user_id AS page_id, event_id AS seq, k, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'activity' WHEN 'click' THEN 'region' WHEN 'error' THEN 'stage'
     ELSE CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'failed' END END AS kind, 's' || (k % 3) AS stage, k::DOUBLE / 100 AS fraction, 'a' || (k % 2) AS activity FROM (SELECT *, {K} FROM events))
"""
EMPTY = "kind: '', k: 0, run: false, stage: NULL::VARCHAR, fraction: NULL::DOUBLE, activity: NULL::VARCHAR, cur: NULL::INTEGER, tot: NULL::INTEGER"


def _page(run, stage, fraction, activity, cur, tot):
    return f"{{kind: '', k: 0, run: {run}, stage: {stage}, fraction: {fraction}, activity: {activity}, cur: {cur}, tot: {tot}}}"


@query(
    "live_page_state",
    f"""WITH {PAGE_EVENTS_SQL}, lists AS (SELECT page_id, list({{kind: kind, k: k, run: false, stage: stage, fraction: fraction, activity: activity, cur: NULL::INTEGER, tot: NULL::INTEGER}} ORDER BY seq) AS l FROM ev GROUP BY page_id),
    done AS (SELECT page_id, list_reduce(list_prepend({{{EMPTY}}}, l), lambda s, e: CASE
      WHEN e.kind = 'started' THEN {_page('true', 's.stage', 's.fraction', "'preparingPage'", 'NULL::INTEGER', 'NULL::INTEGER')}
      WHEN NOT s.run THEN s
      WHEN e.kind IN ('completed', 'failed') THEN {_page('false', 'e.kind', 's.fraction', 'NULL::VARCHAR', 'NULL::INTEGER', 'NULL::INTEGER')}
      WHEN e.kind = 'stage' THEN {_page('true', 'e.stage', 'e.fraction', 's.activity', 's.cur', 's.tot')}
      WHEN e.kind = 'activity' THEN {_page('true', 's.stage', 's.fraction', 'e.activity', 'CASE WHEN s.activity = e.activity THEN s.cur END', 'CASE WHEN s.activity = e.activity THEN s.tot END')}
      ELSE {_page('true', 's.stage', 's.fraction', 's.activity', 'greatest(0, e.k - 5)', 'e.k')} END) AS s FROM lists)
    SELECT page_id, s.run AS running, s.stage AS stage, s.fraction AS fraction, s.activity AS activity, s.cur AS current, s.tot AS total FROM done""",
)
def _(v):
    return jobs.live_page_state(page_events(v, stored=True))


@query(
    "latest_stage",
    f"WITH {PAGE_EVENTS_SQL} SELECT page_id, arg_max(stage, seq) AS stage, arg_max(fraction, seq) AS fraction FROM ev GROUP BY page_id",
)
def _(v):
    return jobs.latest(jobs.run_to_end(jobs.latest_stage(page_events(v)), "stages"), "page_id")


@query(
    "reasoning_sessions",
    f"""WITH ev AS (SELECT user_id AS app, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'error' THEN 'finished' ELSE 'updated' END AS kind, 'r' || (k % 2) AS session, props AS text FROM (SELECT *, {K} FROM events)),
    lists AS (SELECT app, list({{kind: kind, session: session, text: text, active: false}} ORDER BY seq) AS l FROM ev GROUP BY app),
    done AS (SELECT app, list_reduce(list_prepend({{kind: '', session: NULL::VARCHAR, text: '', active: false}}, l), lambda s, e: CASE
      WHEN e.kind = 'started' THEN {{kind: '', session: e.session, text: '', active: true}}
      WHEN s.session IS DISTINCT FROM e.session THEN s
      WHEN e.kind = 'updated' THEN {{kind: '', session: s.session, text: left(e.text, 32000), active: s.active}}
      ELSE {{kind: '', session: s.session, text: s.text, active: false}} END) AS s FROM lists)
    SELECT app, s.session AS session, s.text AS text, s.active AS active FROM done""",
)
def _(v):
    kind = F.col("event_type")
    log = stored_events(v).select(
        F.col("user_id").alias("app"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", "started").when(kind == "error", "finished").otherwise("updated").alias("kind"),
        F.concat(F.lit("r"), F.col("k") % 2).alias("session"), F.col("props").alias("text"),
    )
    return jobs.reasoning_sessions(log)


@query(
    "dedupe_submissions",
    """WITH ev AS (SELECT user_id AS key, event_id AS seq, event_type = 'error' AS finish, event_id AS job FROM events),
    lists AS (SELECT key, list({finish: finish, job: job, open: NULL::BIGINT, last: NULL::BIGINT, reused: 0::BIGINT} ORDER BY seq) AS l FROM ev GROUP BY key),
    done AS (SELECT key, list_reduce(list_prepend({finish: false, job: 0::BIGINT, open: NULL::BIGINT, last: NULL::BIGINT, reused: 0::BIGINT}, l), lambda s, e: CASE
      WHEN e.finish THEN {finish: false, job: 0::BIGINT, open: NULL::BIGINT, last: s.last, reused: s.reused}
      WHEN s.open IS NULL THEN {finish: false, job: 0::BIGINT, open: e.job, last: e.job, reused: s.reused}
      ELSE {finish: false, job: 0::BIGINT, open: s.open, last: s.last, reused: s.reused + 1} END) AS s FROM lists)
    SELECT key, s.open AS open_job, s.last AS last_job, s.reused AS reused FROM done""",
)
def _(v):
    # an 'error' finishes whatever job is open for its key
    log = stored_events(v).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "finish").otherwise("submit").alias("kind"),
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("job_id"),
    )
    return jobs.dedupe_submissions(log).select("key", "open_job", F.try_element_at("accepted", F.lit(-1)).alias("last_job"), "reused")


@query(
    "job_rollup",
    """SELECT job_id, count(*) FILTER (kind = 'started') AS starts, count(*) FILTER (kind = 'completed') AS done, count(*) FILTER (kind = 'failed') AS failed,
      arg_max(kind, event_id) AS last_kind, max(event_id) AS last_seq FROM fx_events GROUP BY job_id""",
    ("fx_events",),
)
def _(v):
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "started", "view", "activity", "click", "progress", "error", "failed", "purchase", "completed")])
    stream = events(v).select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.try_element_at(kinds, F.col("event_type")).alias("kind")
    )
    return jobs.latest(jobs.run_to_end(jobs.job_rollup(stream), "rollup"), "job_id")


@query(
    "event_rates",
    "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS window_start, kind, count(*) AS events FROM fx_events GROUP BY ALL",
    ("fx_events",),
)
def _(v):
    # in order of time, so that the watermark leaves nothing out
    stream = events(v, F.col("ts").cast("timestamp")).select(
        "ts",
        F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "activity")
        .when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "error", "failed").otherwise("completed").alias("kind"),
    )
    written = jobs.latest(jobs.run_to_end(jobs.event_rates(stream), "rates"), "window_start", "kind")
    return written.withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "retry_failed",
    """WITH failures AS (SELECT DISTINCT job_id, page_id FROM fx_events WHERE kind = 'failed')
    SELECT job_id || '-retry' AS new_job, 'translate' AS operation, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS page_ids, 'queued' AS status FROM failures GROUP BY job_id""",
    ("fx_events",),
)
def _(v):
    table = v.events()
    listed = table.select("job_id").distinct().withColumn("operation", F.lit("translate"))
    retried = jobs.retry_failed(listed, table.where(F.col("kind") == "failed"))
    return retried.withColumn("page_ids", F.array_join("page_ids", ","))


STATUS_SQL = "SELECT o_orderkey AS job_id, (['queued', 'running', 'completed', 'failed'])[o_orderkey % 4 + 1] AS status FROM orders"


def listed_jobs(v):
    names = F.array(*[F.lit(x) for x in ("queued", "running", "completed", "failed")])
    return v.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("status"))


@query("cancel_open", f"SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status FROM ({STATUS_SQL})")
def _(v):
    return jobs.cancel_open(listed_jobs(v))


@query("clear_finished", f"SELECT * FROM ({STATUS_SQL}) WHERE status IN ('queued', 'running')")
def _(v):
    return jobs.clear_finished(listed_jobs(v))


@query(
    "log_tail_stream",
    """SELECT user_id % 3 AS app, event_id AS entry_id, trim(message) AS message FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE ' ' || props || ' ' END AS message FROM events)
    WHERE trim(message) <> '' QUALIFY row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) <= 500""",
)
def _(v):
    stream = events(v).select(
        (F.col("user_id") % 3).alias("app"), F.col("event_id").alias("entry_id"), "ts", F.col("event_type").alias("category"),
        F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "props", F.lit(" "))).alias("message"),
    )
    return jobs.log_tail_stream(stream).select("app", "entry_id", "message")


@query(
    "replay_edit_stream",
    """WITH log AS (SELECT user_id AS page_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'edit' END AS action, 'k' || (regexp_extract(props, '[0-9]+', 0)::INTEGER % 4) AS state FROM events),
    lists AS (SELECT page_id, list({a: action, s: state, u: []::VARCHAR[], r: []::VARCHAR[], c: ''} ORDER BY seq) AS l FROM log GROUP BY page_id),
    done AS (SELECT page_id, list_reduce(list_prepend({a: '', s: '', u: []::VARCHAR[], r: []::VARCHAR[], c: ''}, l), lambda h, e: CASE
       WHEN e.a = 'edit' THEN {a: '', s: '', u: list_slice(CASE WHEN len(h.u) > 0 AND h.u[-1] = h.c THEN h.u ELSE list_append(h.u, h.c) END, -50, -1), r: []::VARCHAR[], c: e.s}
       WHEN e.a = 'undo' AND len(h.u) > 0 THEN {a: '', s: '', u: h.u[1:len(h.u) - 1], r: list_append(h.r, h.c), c: h.u[-1]}
       WHEN e.a = 'redo' AND len(h.r) > 0 THEN {a: '', s: '', u: list_append(h.u, h.c), r: h.r[1:len(h.r) - 1], c: h.r[-1]} ELSE h END) AS h FROM lists)
    SELECT page_id, array_to_string(h.u, ',') AS undo, array_to_string(h.r, ',') AS redo, h.c AS current FROM done""",
)
def _(v):
    kind = F.col("event_type")
    log = events(v, "event_id").select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "undo").when(kind == "purchase", "redo").otherwise("edit").alias("action"),
        F.concat(F.lit("k"), F.col("k") % 4).alias("state"),
    )
    final = jobs.none_late(jobs.latest(jobs.run_to_end(jobs.replay_edit_stream(log), "history"), "page_id"))
    return final.select("page_id", F.array_join("undo", ",").alias("undo"), F.array_join("redo", ",").alias("redo"), "current")


@query(
    "estimate_region",
    """SELECT event_id, (CASE WHEN n <= 0 OR p <= 0.55::DOUBLE THEN 0 ELSE least(n, greatest(1, ceil((p - 0.55::DOUBLE) / (1 - 0.55::DOUBLE) * n))) END)::INTEGER AS region_index
    FROM (SELECT event_id, k::DOUBLE / 90 AS p0, least(k::DOUBLE / 90, 1.0) AS p, event_id % 9 AS n FROM fx_events)""",
    ("fx_events",),
)
def _(v):
    stream = events(v).select("event_id", (F.col("k").cast("double") / 90).alias("progress"), (F.col("event_id") % 9).alias("total"))
    return jobs.run_to_end(jobs.estimate_region(stream), "estimate", "append").select("event_id", "region_index")


# --- files written from the tables and read back --------------------------------


@query(
    "sidecar_round_trip",
    """SELECT 'ch' || (page_id % 20) || '/p' || (page_id % 137) || '-' || page_id || '.png' AS rel_path, region_id,
      (row_number() OVER (PARTITION BY page_id ORDER BY ord, region_id) - 1)::INTEGER AS ord, source_text, translated_text, mask_complete, 'automatic' AS detected_direction, true AS automatic_mask
    FROM fx_regions WHERE page_id IN (SELECT o_orderkey FROM orders)""",
    ("fx_regions",),
)
def _(v):
    root = scratch_path(v.spark, "sidecars")
    documents = files.sidecar_documents(v.pages(), v.regions(), "zh-Hant")
    files.write_sidecars(documents, root, 1)
    rows = files.sidecar_regions(files.read_sidecar_versions(v.spark, root)[0])
    return rows.select(
        "rel_path", "region_id", "ord", "source_text", "translated_text", "mask_complete", "detected_direction", "automatic_mask"
    )


@query(
    "scan_pages",
    """SELECT folder, row_number() OVER (ORDER BY n) AS scan_index FROM (SELECT DISTINCT o_orderkey % 137 AS n, 'p' || (o_orderkey % 137) AS folder FROM orders)""",
)
def _(v):
    # one file per folder; a package folder and files that are no images are not listed
    root = scratch_path(v.spark, "scan")
    rows = v.raw("orders").select(F.concat(F.lit("p"), F.col("o_orderkey") % 137).alias("folder"), "o_orderstatus")
    rows = rows.groupBy("folder").agg(F.min("o_orderstatus").alias("value"))
    dealt = rows.repartition(4, "folder")
    dealt.write.partitionBy("folder").option("extension", "png").csv(f"{root}/pages")
    dealt.select("value", F.concat("folder", F.lit(".app")).alias("folder")).write.partitionBy("folder").option("extension", "png").csv(f"{root}/kits")
    dealt.write.partitionBy("folder").option("extension", "txt").csv(f"{root}/notes")
    found = files.scan_pages(v.spark, root)
    return found.select(F.regexp_extract("rel_path", "folder=([^/]*)/", 1).alias("folder"), F.col("scan_index").cast("long").alias("scan_index"))


@query(
    "read_sidecars",
    """SELECT 'p' || (o_orderkey % 97) AS rel_path, CASE WHEN o_orderkey % 97 % 5 = 0 THEN 'corrupt' WHEN o_orderkey % 97 % 7 = 0 THEN 'unsupported version' ELSE 'read' END AS outcome,
      CASE WHEN o_orderkey % 97 % 5 > 0 AND o_orderkey % 97 % 7 > 0 THEN count(*) END AS entries FROM orders GROUP BY o_orderkey % 97""",
)
def _(v):
    # one sidecar file per folder; every fifth is cut off, every seventh comes from a later version
    root = scratch_path(v.spark, "str-files")
    page = F.col("o_orderkey") % 97
    bounds = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("width"), F.lit(0.2).alias("height"))
    entry = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(0).alias("order"), bounds.alias("bounds"), F.lit("text").alias("sourceText"))
    pages = v.raw("orders").groupBy(page.alias("page")).agg(F.collect_list(entry).alias("entries"))
    version = F.when((F.col("page") % 7 == 0) & (F.col("page") % 5 > 0), files.SIDECAR_VERSION + 1).otherwise(files.SIDECAR_VERSION)
    body = F.to_json(F.struct(version.alias("schemaVersion"), F.concat(F.lit("p"), "page").alias("sourceRelativePath"), "entries"))
    cut = F.when(F.col("page") % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body)
    written = pages.select("page", cut.alias("body")).repartition(4, "page").write.partitionBy("page")
    written.option("extension", "str").option("quote", "").option("sep", "\u0001").csv(root)
    good, bad = files.read_sidecars(v.spark, root)
    read = good.select(F.col("sourceRelativePath").alias("rel_path"), F.lit("read").alias("outcome"), F.size("entries").cast("long").alias("entries"))
    name = F.concat(F.lit("p"), F.regexp_extract("file", "page=([0-9]+)", 1))
    return read.unionByName(bad.select(name.alias("rel_path"), F.col("fault").alias("outcome"), F.lit(None).cast("long").alias("entries")))


@query(
    "read_snapshots",
    """WITH p AS (SELECT project_id, count(*) AS pages, min(page_id) AS first_page FROM fx_pages GROUP BY project_id)
    SELECT project_id::VARCHAR AS project_id, CASE WHEN project_id % 4 = 0 THEN 1 ELSE 4 END AS schema_version,
      CASE WHEN project_id % 2 = 0 THEN 'Project ' || project_id WHEN project_id % 3 = 0 THEN 'dir' || project_id ELSE '未命名專案' END AS name,
      first_page::VARCHAR AS selection, pages FROM p""",
    ("fx_pages",),
)
def _(v):
    root = scratch_path(v.spark, "snapshots")
    key = F.col("project_id")
    pages = v.pages().groupBy("project_id").agg(
        F.collect_list(F.struct(F.col("page_id").cast("string").alias("id"), "title")).alias("pages"), F.min("page_id").cast("string").alias("first")
    )
    written = pages.select(
        F.when(key % 4 != 0, 4).alias("schemaVersion"),
        key.cast("string").alias("projectID"),
        F.when(key % 2 == 0, F.concat(F.lit("Project "), key)).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("/src/dir"), key, F.lit("/"))).alias("sourceDirectoryURL"),
        F.col("first").alias("selectedPageID"),
        F.when(key % 4 != 0, F.array("first")).alias("selectedPageIDs"),
        "pages",
    )
    written.write.json(root)
    return files.read_snapshots(v.spark, root).select(
        "project_id", "schema_version", "name", F.array_join("selection", ",").alias("selection"),
        F.size("pages").cast("long").alias("pages"),
    )


@query(
    "read_truth_lines",
    """SELECT 'p' || page_id AS file, (row_number() OVER (PARTITION BY page_id ORDER BY component_id) - 1)::INTEGER AS line_no, component_id AS text,
      round((min_x + min_x + w)::DOUBLE / 2 / 1000, 6) AS cx FROM fx_components""",
    ("fx_components",),
)
def _(v):
    root = scratch_path(v.spark, "truth")
    box = F.array(*[c.cast("int") for c in (F.col("min_x"), F.col("min_y"), F.col("min_x") + F.col("w"), F.col("min_y") + F.col("h"))])
    lines = v.components().groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("component_id").alias("text"), box.alias("box")))).alias("lines")
    )
    page = F.struct(F.lit(1000).alias("width"), F.lit(1000).alias("height"), "lines")
    lines.select(F.to_json(F.create_map(F.concat(F.lit("p"), "page_id"), page)).alias("value")).write.text(root)
    # one document per line here; the reader takes whole files as well as lines
    return files.read_truth_lines(v.spark, root, whole_files=False).select("file", "line_no", "text", F.round("cx", 6).alias("cx"))


@query(
    "migrate_sidecars",
    """WITH r AS (SELECT *, page_id % 3 AS kind FROM fx_regions WHERE page_id % 3 <> 0)
    SELECT region_id, CASE WHEN kind = 1 THEN 'old ' || source_text ELSE source_text END AS source_text, CASE WHEN kind = 1 THEN 'legacy' ELSE 'rebuilt' END AS origin FROM r""",
    ("fx_regions",),
)
def _(v):
    page = F.col("page_id")
    target = F.concat(F.lit("/in/"), page, F.lit(".str"))
    pages = v.pages().select(
        page, target.alias("target_path"),
        F.when(page % 3 == 0, target).when(page % 3 == 1, F.concat(F.lit("/out/"), page, F.lit(".str"))).alias("sidecar_path"),
        (page % 3 == 0).alias("sidecar_exists"),
    )
    legacy = v.regions().withColumn("source_text", F.concat(F.lit("old "), "source_text"))
    return files.migrate_sidecars(pages, v.regions(), legacy).select("region_id", "source_text", "origin")


@query(
    "write_report",
    """SELECT page, overall, lines, edits, characters, round(edits::DOUBLE / characters, 6) AS cer FROM (
      SELECT page, grouping(page)::BIGINT AS overall, count(*) AS lines, sum(levenshtein(translate(expected, letters, marks), translate(observed, letters, marks)))::BIGINT AS edits, sum(length(expected))::BIGINT AS characters
      FROM fx_truth, fx_letters GROUP BY ROLLUP (page))""",
    ("fx_truth", "fx_letters"),
)
def _(v):
    root = scratch_path(v.spark, "report")
    files.write_report(quality.accuracy_report(v.truth()), root)
    fields = "page string, overall bigint, lines bigint, edits bigint, characters bigint, cer double"
    return v.spark.read.schema(fields).json(root).withColumn("cer", F.round("cer", 6))
