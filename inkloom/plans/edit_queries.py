"""Identity, edit, invalidation and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.operators import edits, identity, sets
from inkloom.plans.catalog import query
from inkloom.session import materialize

FLAGS = "array<string>"


def page_files(v, prefix="/src/"):
    key = F.col("o_orderkey")
    return v.raw("orders").select(
        (F.col("o_custkey") % 50).alias("project_id"),
        key,
        F.concat(F.lit("k"), key, F.lit("/p"), key % 137, F.lit(".png")).alias("rel_path"),
        (800 + 100 * (key % 5)).cast("int").alias("pixel_width"),
        (1200 + 100 * (key % 7)).cast("int").alias("pixel_height"),
    )


FILES_SQL = """
files AS (SELECT o_custkey % 50 AS project_id, o_orderkey AS k, 'k' || o_orderkey || '/p' || (o_orderkey % 137) || '.png' AS rel_path,
   (800 + 100 * (o_orderkey % 5))::INTEGER AS w, (1200 + 100 * (o_orderkey % 7))::INTEGER AS h FROM orders),
prev AS (SELECT project_id, k AS page_id, k AS prev_index, '/src/' || rel_path AS path, rel_path, 'P' || (k % 137) AS title, w, h FROM files),
scan AS (SELECT project_id, k * 2 AS scan_index, CASE k % 4 WHEN 0 THEN '/src/' || rel_path WHEN 1 THEN '/new/' || rel_path WHEN 2 THEN '/src/moved/' || rel_path ELSE '/src/x/' || replace(rel_path, '/p', '/q') END AS path,
    CASE k % 4 WHEN 2 THEN 'moved/' || rel_path WHEN 3 THEN 'x/' || replace(rel_path, '/p', '/q') ELSE rel_path END AS rel_path, w, h FROM files
  UNION ALL SELECT project_id, k * 2 - 1, '/src/copy/' || rel_path, 'copy/' || rel_path, w, h FROM files WHERE k % 7 = 0),
included AS (SELECT * FROM scan s WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.project_id = s.project_id AND p.page_id % 13 = 0 AND p.rel_path = s.rel_path))
"""


def scan_tables(v):
    files, k, rel = page_files(v), F.col("o_orderkey"), F.col("rel_path")
    previous = files.select(
        "project_id", k.alias("page_id"), k.alias("prev_index"), F.concat(F.lit("/src/"), rel).alias("path"), "rel_path",
        F.concat(F.lit("P"), k % 137).alias("title"), "pixel_width", "pixel_height",
    )
    renamed = F.concat(F.lit("x/"), F.replace(rel, F.lit("/p"), F.lit("/q")))
    kind = k % 4
    moved_rel = F.when(kind == 2, F.concat(F.lit("moved/"), rel)).when(kind == 3, renamed).otherwise(rel)
    root = F.when(kind == 1, "/new/").otherwise("/src/")
    first = files.select(
        "project_id", (k * 2).alias("scan_index"), F.concat(root, moved_rel).alias("path"), moved_rel.alias("rel_path"),
        "pixel_width", "pixel_height",
    )
    copies = files.where(k % 7 == 0).select(
        "project_id", (k * 2 - 1).alias("scan_index"), F.concat(F.lit("/src/copy/"), rel).alias("path"),
        F.concat(F.lit("copy/"), rel).alias("rel_path"), "pixel_width", "pixel_height",
    )
    return first.unionByName(copies), previous


@query(
    "exclude_removed",
    f"WITH {FILES_SQL} SELECT project_id, scan_index, rel_path FROM included",
)
def _(v):
    scan, previous = scan_tables(v)
    excluded = previous.where(F.col("page_id") % 13 == 0)
    return identity.exclude_removed(scan, excluded).select("project_id", "scan_index", "rel_path")


def relink_sql(relative: bool) -> str:
    exact = "coalesce(p1.page_id, p2.page_id)" if relative else "p1.page_id"
    order = "prev_index NULLS LAST, scan_index" if relative else "scan_index"
    return f"""WITH {FILES_SQL},
    fps AS (SELECT project_id, lower(title) || '|' || w || 'x' || h AS fp, count(*) AS n, min(page_id) AS moved FROM prev GROUP BY ALL HAVING count(*) = 1),
    linked AS (SELECT s.*, {exact} AS exact, CASE WHEN p1.page_id IS NOT NULL THEN 'path' WHEN {exact} IS NOT NULL THEN 'relative' END AS rule, f.moved
      FROM included s LEFT JOIN prev p1 ON p1.project_id = s.project_id AND p1.path = s.path
      LEFT JOIN prev p2 ON p2.project_id = s.project_id AND p2.rel_path = s.rel_path
      LEFT JOIN fps f ON f.project_id = s.project_id AND f.fp = lower(regexp_extract(s.path, '([^/]*)\\.png$', 1)) || '|' || s.w || 'x' || s.h),
    settled AS (SELECT l.project_id, l.scan_index, CASE WHEN exact IS NOT NULL THEN exact
        WHEN moved IS NOT NULL AND NOT EXISTS (SELECT 1 FROM linked e WHERE e.project_id = l.project_id AND e.scan_index < l.scan_index AND (e.exact = l.moved OR (e.exact IS NULL AND e.moved = l.moved))) THEN moved END AS page_id, rule, exact FROM linked l),
    named AS (SELECT s.project_id, s.scan_index, s.page_id, CASE WHEN s.exact IS NOT NULL THEN s.rule WHEN s.page_id IS NOT NULL THEN 'fingerprint' ELSE 'new' END AS linked_by, p.prev_index
       FROM settled s LEFT JOIN prev p ON p.project_id = s.project_id AND p.page_id = s.page_id)
    SELECT project_id, scan_index, page_id, linked_by, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS page_index FROM named"""


@query("relink_scan", relink_sql(True))
def _(v):
    scan, previous = scan_tables(v)
    included = identity.exclude_removed(scan, previous.where(F.col("page_id") % 13 == 0))
    return identity.relink_scan(included, previous, keep=[]).select("project_id", "scan_index", "page_id", "linked_by", "page_index")


@query("relink_scan_by_path", relink_sql(False))
def _(v):
    scan, previous = scan_tables(v)
    included = identity.exclude_removed(scan, previous.where(F.col("page_id") % 13 == 0))
    return identity.relink_scan(included, previous, use_relative=False, keep=[]).select(
        "project_id", "scan_index", "page_id", "linked_by", "page_index"
    )


@query(
    "fingerprint_pages",
    """SELECT project_id, page_id, lower(title) || '|' || pixel_width || 'x' || pixel_height AS fingerprint,
      count(*) OVER (PARTITION BY project_id, lower(title), pixel_width, pixel_height) AS sharing FROM fx_pages""",
    ("fx_pages",),
)
def _(v):
    return identity.fingerprint_pages(v.pages()).select("project_id", "page_id", "fingerprint", "sharing")


REVISION_SQL = """
folded AS (SELECT page_id, count(*) AS n, bit_xor(('0x' || left(md5(to_json({'ord': ord, 'region_id': region_id, 'source_text': source_text, 'translated_text': translated_text})), 15))::BIGINT) AS x
  FROM fx_regions GROUP BY page_id),
revisions AS (SELECT page_id, sha256(concat_ws('|', to_json({'pixel_height': pixel_height, 'pixel_width': pixel_width, 'rel_path': rel_path, 'title': title}), coalesce(n, 0)::VARCHAR, coalesce(x, 0)::VARCHAR)) AS revision
  FROM fx_pages LEFT JOIN folded USING (page_id))
"""


def revisions(v):
    return identity.page_revision(
        v.pages(), v.regions(), ["title", "rel_path", "pixel_width", "pixel_height"],
        ["region_id", "ord", "source_text", "translated_text"],
    )


@query("page_revision", f"WITH {REVISION_SQL} SELECT page_id, revision FROM revisions", ("fx_pages", "fx_regions"))
def _(v):
    return revisions(v)


@query(
    "plan_outputs",
    r"""WITH r AS (SELECT project_id, page_id, CASE page_id % 9 WHEN 0 THEN '/' || rel_path WHEN 1 THEN '../' || rel_path WHEN 2 THEN '' WHEN 3 THEN 'a/p' || (page_id % 5) || '.webp' ELSE rel_path END AS rel_path FROM fx_pages),
    p AS (SELECT *, CASE WHEN rel_path = '' THEN 'empty' WHEN starts_with(rel_path, '/') THEN 'absolute' WHEN starts_with(rel_path, '../') THEN 'dot segment' END AS rejected,
       regexp_replace(rel_path, '\.[^./]*$', '') AS stem FROM r),
    q AS (SELECT project_id, page_id, rejected, CASE WHEN rejected IS NULL THEN '/in/' || stem || '.str' END AS sidecar_path, CASE WHEN rejected IS NULL THEN '/out/' || stem || '.png' END AS output_path FROM p)
    SELECT *, CASE WHEN output_path IS NOT NULL THEN count(*) OVER (PARTITION BY project_id, output_path) END AS collisions FROM q""",
    ("fx_pages",),
)
def _(v):
    kind, rel = F.col("page_id") % 9, F.col("rel_path")
    pages = v.pages().select(
        "project_id", "page_id",
        F.when(kind == 0, F.concat(F.lit("/"), rel)).when(kind == 1, F.concat(F.lit("../"), rel)).when(kind == 2, "")
        .when(kind == 3, F.concat(F.lit("a/p"), F.col("page_id") % 5, F.lit(".webp"))).otherwise(rel).alias("rel_path"),
    )
    return identity.plan_outputs(pages, "/in/", "/out").drop("rel_path")


@query(
    "safe_project_dirs",
    r"""WITH p AS (SELECT c_custkey AS project_id, CASE c_custkey % 6 WHEN 0 THEN 'a/b' WHEN 1 THEN ' .. ' WHEN 2 THEN '::' ELSE c_mktsegment || '\' || (c_custkey % 40) END AS name,
        CASE WHEN c_custkey % 10 = 0 THEN '/out/a_b/' ELSE '/src' END AS source_dir FROM customer),
    c AS (SELECT *, CASE WHEN trim(name) IN ('', '.', '..') OR trim(array_to_string(list_filter(regexp_split_to_array(trim(name), '[/\\:]'), lambda s: s <> ''), '_')) IN ('', '.', '..') THEN NULL
        ELSE array_to_string(list_filter(regexp_split_to_array(trim(name), '[/\\:]'), lambda s: s <> ''), '_') END AS component, rtrim(source_dir, '/') AS src FROM p),
    t AS (SELECT project_id, CASE WHEN coalesce('/out/' || component, '/out') = src OR starts_with(coalesce('/out/' || component, '/out'), src || '/') THEN NULL ELSE coalesce('/out/' || component, '/out') END AS output_dir FROM c)
    SELECT project_id, output_dir, CASE WHEN output_dir IS NOT NULL THEN count(*) OVER (PARTITION BY output_dir) END AS sharing FROM t""",
)
def _(v):
    key = F.col("c_custkey")
    projects = v.raw("customer").select(
        key.alias("project_id"),
        F.when(key % 6 == 0, "a/b").when(key % 6 == 1, " .. ").when(key % 6 == 2, "::")
        .otherwise(F.concat("c_mktsegment", F.lit("\\"), key % 40)).alias("name"),
        F.when(key % 10 == 0, "/out/a_b/").otherwise("/src").alias("source_dir"),
    )
    return identity.safe_project_dirs(projects, "/out").select("project_id", "output_dir", "sharing")


def editable(v):
    return v.regions().withColumns(
        {
            "raw_source_text": F.lit(None).cast("string"),
            "text_confirmed": F.lit(False),
            "translation_confidence": F.col("confidence"),
            "qa_flags": F.array(F.lit("modelUncertain")),
            "font_size": F.lit(12.0),
        }
    )


def patches(v):
    box = F.struct(
        F.col("new_x").alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("width"), F.lit(0.3).alias("height")
    )
    return v.edits().select(
        "region_id", "page_id", "seq", "source_text", "translated_text",
        F.when(F.col("new_x").isNotNull(), box).alias("bounds"),
        F.struct(F.col("clear_font_size").alias("present"), F.lit(None).cast("double").alias("value")).alias("font_size"),
    )


def folded_sql(edit_rows: str) -> str:
    """``after``: every region after a sequential pass over its edits."""
    return f"""
entries AS (
  SELECT region_id, -1::BIGINT AS seq, NULL::VARCHAR AS es, NULL::VARCHAR AS et, NULL::DOUBLE AS nx, false AS cf, source_text AS s, translated_text AS t, NULL::VARCHAR AS raw, false AS conf, false AS reset, false AS geo, x, 12.0::DOUBLE AS fs FROM fx_regions
  UNION ALL SELECT region_id, seq, source_text, translated_text, new_x, clear_font_size, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({edit_rows})),
logs AS (SELECT region_id, list({{es: es, et: et, nx: nx, cf: cf, s: s, t: t, raw: raw, conf: conf, reset: reset, geo: geo, x: x, fs: fs}} ORDER BY seq) AS l FROM entries GROUP BY region_id),
after AS (SELECT region_id, list_reduce(l, lambda a, e: {{es: NULL::VARCHAR, et: NULL::VARCHAR, nx: NULL::DOUBLE, cf: false,
   s: coalesce(e.es, a.s),
   t: CASE WHEN e.et IS NOT NULL THEN e.et WHEN e.es IS NOT NULL AND e.es <> a.s THEN '' ELSE a.t END,
   raw: CASE WHEN e.es IS NOT NULL THEN coalesce(a.raw, a.s) ELSE a.raw END,
   conf: a.conf OR e.es IS NOT NULL,
   reset: a.reset OR (e.et IS NOT NULL AND e.et <> CASE WHEN e.es IS NOT NULL AND e.es <> a.s AND e.et IS NULL THEN '' ELSE a.t END),
   geo: a.geo OR e.es IS NOT NULL OR e.nx IS NOT NULL,
   x: coalesce(e.nx, a.x), fs: CASE WHEN e.cf THEN NULL ELSE a.fs END}}) AS r FROM logs)
"""


AFTER = """r.s AS source_text, r.t AS translated_text, r.raw AS raw_source_text, r.conf AS text_confirmed,
  r.geo AS geometry_changed, round(r.x, 6) AS x, r.fs AS font_size"""


@query(
    "apply_region_edits",
    f"""WITH {folded_sql('SELECT * FROM fx_edits')}
    SELECT a.region_id, {AFTER}, CASE WHEN NOT r.reset THEN b.confidence END AS translation_confidence,
      CASE WHEN r.reset THEN '' ELSE 'modelUncertain' END AS qa_flags, b.mask_complete AND NOT r.geo AS mask_complete
    FROM after a JOIN fx_regions b ON b.region_id = a.region_id""",
    ("fx_regions", "fx_edits"),
)
def _(v):
    after = edits.apply_region_edits(editable(v), patches(v))
    return after.select(
        "region_id", "source_text", "translated_text", "raw_source_text", "text_confirmed", "geometry_changed",
        F.round("x", 6).alias("x"), "font_size", "translation_confidence",
        F.array_join("qa_flags", ",").alias("qa_flags"), "mask_complete",
    )


BATCHES_SQL = f"""{REVISION_SQL},
patches AS (SELECT page_id || '-' || (seq // 150) AS batch_id, e.* FROM fx_edits e),
batches AS (SELECT batch_id, page_id, min(seq) AS seq FROM patches GROUP BY ALL),
checked AS (SELECT batch_id, sum(n) AS size, max(n) AS most FROM (SELECT batch_id, region_id, count(*) AS n FROM patches GROUP BY ALL) GROUP BY batch_id),
judged AS (SELECT b.*, CASE WHEN size NOT BETWEEN 1 AND 64 THEN 'size' WHEN b.page_id % 4 = 0 THEN 'conflict' WHEN most > 1 THEN 'duplicate id' ELSE 'accepted' END AS v FROM batches b JOIN checked USING (batch_id)),
verdicts AS (SELECT batch_id, page_id, seq, CASE WHEN v = 'accepted' AND row_number() OVER (PARTITION BY page_id, v ORDER BY seq, batch_id) > 1 THEN 'conflict' ELSE v END AS verdict FROM judged)
"""


def batch_tables(v):
    patch = patches(v).withColumn("batch_id", F.concat("page_id", F.lit("-"), F.floor(F.col("seq") / 150)))
    batches = patch.groupBy("batch_id", "page_id").agg(F.min("seq").alias("seq"))
    current = materialize(revisions(v))
    batches = batches.join(current, "page_id", "left").select(
        "batch_id", "page_id", "seq",
        F.when(F.col("page_id") % 4 == 0, "stale").otherwise(F.col("revision")).alias("expected_revision"),
    )
    return current, editable(v), batches, patch.drop("page_id", "seq")


@query(
    "commit_edit_batches",
    f"WITH {BATCHES_SQL} SELECT batch_id, page_id, seq, verdict FROM verdicts",
    ("fx_pages", "fx_regions", "fx_edits"),
)
def _(v):
    current, regions, batches, patch = batch_tables(v)
    return edits.judge_batches(current, regions, batches, patch)


@query(
    "commit_edit_effects",
    f"""WITH {BATCHES_SQL}, ok AS (SELECT p.* FROM patches p JOIN verdicts w ON w.batch_id = p.batch_id AND verdict = 'accepted'),
    {folded_sql('SELECT region_id, seq, source_text, translated_text, new_x, clear_font_size FROM ok')},
    touched AS (SELECT b.page_id, bool_or(r.geo) AS geo, bool_or(r.t <> '') AS tr FROM after a JOIN fx_regions b ON b.region_id = a.region_id WHERE b.page_id IN (SELECT page_id FROM ok) GROUP BY b.page_id)
    SELECT page_id, CASE WHEN NOT geo AND tr THEN 'translating' ELSE 'maskReady' END AS stage, geo AS mask_void, true AS preview_void, true AS output_void FROM touched""",
    ("fx_pages", "fx_regions", "fx_edits"),
)
def _(v):
    return edits.commit_edit_batches(*batch_tables(v))[2]


RESULTS_SQL = f"""{REVISION_SQL},
flags AS (SELECT page_id, bool_or(kind = 'mask') AS has_mask, bool_or(kind = 'background') AS has_background FROM fx_artifacts GROUP BY page_id),
results AS (SELECT page_id, region_id, 'S' || source_text AS source_text, CASE WHEN page_id % 6 = 0 THEN ' ' ELSE 'T' || ord END AS translated_text FROM fx_regions WHERE NOT (page_id % 5 = 0 AND ord = 2)),
verdicts AS (SELECT p.page_id, CASE WHEN p.page_id % 7 = 0 THEN 'conflict' WHEN NOT (coalesce(has_mask, false) AND coalesce(has_background, false)) THEN 'mask data required'
    WHEN p.n <> q.n THEN 'id set differs' WHEN p.page_id % 6 = 0 THEN 'blank text' ELSE 'accepted' END AS verdict
  FROM (SELECT page_id, count(*) AS n FROM results GROUP BY page_id) p JOIN (SELECT page_id, count(*) AS n FROM fx_regions GROUP BY page_id) q USING (page_id) LEFT JOIN flags USING (page_id))
"""


def agent_tables(v):
    kinds = v.artifacts().groupBy("page_id").agg(
        F.bool_or(F.col("kind") == "mask").alias("has_mask"), F.bool_or(F.col("kind") == "background").alias("has_background")
    )
    current = materialize(revisions(v))
    pages = current.join(kinds, "page_id", "left").na.fill(False, ["has_mask", "has_background"])
    page, ord_ = F.col("page_id"), F.col("ord")
    results = v.regions().where(~((page % 5 == 0) & (ord_ == 2))).join(current, "page_id").select(
        "page_id", "region_id",
        F.when(page % 7 == 0, "stale").otherwise(F.col("revision")).alias("expected_revision"),
        F.concat(F.lit("S"), "source_text").alias("source_text"),
        F.when(page % 6 == 0, " ").otherwise(F.concat(F.lit("T"), ord_)).alias("translated_text"),
        F.concat(F.lit(" L"), ord_).alias("literal_text"), F.lit("a").alias("speaker"), F.lit("calm").alias("tone"),
        (F.col("confidence") * 2).alias("confidence"), F.array(F.lit("sourceTextLeak")).alias("flags"),
    )
    regions = editable(v).withColumns(
        {c: F.lit(None).cast("string") for c in ("literal_text", "extracted_source_text", "speaker", "tone")}
    )
    return pages, regions, results


@query(
    "submit_agent_verdicts",
    f"WITH {RESULTS_SQL} SELECT page_id, verdict FROM verdicts",
    ("fx_pages", "fx_regions", "fx_artifacts"),
)
def _(v):
    return edits.submit_agent_results(*agent_tables(v))[0]


@query(
    "submit_agent_results",
    f"""WITH {RESULTS_SQL} SELECT b.region_id, CASE WHEN hit THEN 'S' || b.source_text ELSE b.source_text END AS source_text,
      CASE WHEN hit THEN 'T' || b.ord ELSE b.translated_text END AS translated_text, CASE WHEN hit THEN 'L' || b.ord END AS extracted_source_text,
      CASE WHEN hit THEN least(b.confidence * 2, 1.0) ELSE b.confidence END AS translation_confidence, CASE WHEN hit THEN 'sourceTextLeak' ELSE 'modelUncertain' END AS qa_flags
    FROM (SELECT r.*, v.verdict IS NOT NULL AND v.verdict = 'accepted' AS hit FROM fx_regions r LEFT JOIN verdicts v USING (page_id)) b""",
    ("fx_pages", "fx_regions", "fx_artifacts"),
)
def _(v):
    return edits.submit_agent_results(*agent_tables(v))[1].select(
        "region_id", "source_text", "translated_text", "extracted_source_text", "translation_confidence",
        F.array_join("qa_flags", ",").alias("qa_flags"),
    )


ORDER_SQL = """
sent AS (SELECT page_id, region_id, ord, translated_text FROM fx_regions WHERE NOT (page_id % 5 = 0 AND ord = 2)),
judged AS (SELECT p.page_id, CASE WHEN p.page_id % 7 = 0 THEN 'conflict' WHEN p.n <> q.n THEN 'id set differs' ELSE 'accepted' END AS verdict
  FROM (SELECT page_id, count(*) AS n FROM sent GROUP BY page_id) p JOIN (SELECT page_id, count(*) AS n FROM fx_regions GROUP BY page_id) q USING (page_id))
"""


def reordered(v):
    page, ord_ = F.col("page_id"), F.col("ord")
    pages = materialize(revisions(v))
    orders = v.regions().where(~((page % 5 == 0) & (ord_ == 2))).join(pages, "page_id").select(
        "page_id", "region_id", F.when(page % 7 == 0, "stale").otherwise(F.col("revision")).alias("expected_revision"), (-ord_).alias("position")
    )
    return edits.reorder_regions(pages, v.regions().select("page_id", "region_id", "ord", "translated_text"), orders)


@query("reorder_verdicts", f"WITH {ORDER_SQL} SELECT page_id, verdict FROM judged", ("fx_regions",))
def _(v):
    return reordered(v)[0]


@query(
    "reorder_regions",
    f"""WITH {ORDER_SQL} SELECT r.region_id, CASE WHEN verdict = 'accepted' THEN (row_number() OVER (PARTITION BY r.page_id ORDER BY -ord, r.region_id) - 1)::INTEGER ELSE ord::INTEGER END AS ord,
      CASE WHEN verdict = 'accepted' THEN CASE WHEN bool_or(translated_text <> '') OVER (PARTITION BY r.page_id) THEN 'translating' ELSE 'maskReady' END END AS stage
    FROM fx_regions r LEFT JOIN judged USING (page_id)""",
    ("fx_regions",),
)
def _(v):
    _, regions, effects = reordered(v)
    return regions.join(effects, "page_id", "left").select("region_id", F.col("ord").cast("int").alias("ord"), "stage")


CAUSES = ("edit", "batch", "geometry", "extraction", "reset", "eraseColor", "defaultFont")
CAUSES_SQL = f"""
causes AS (SELECT DISTINCT user_id AS page_id, ({list(CAUSES)})[event_id % 7 + 1] AS cause FROM events),
backed AS (SELECT DISTINCT page_id FROM fx_artifacts WHERE kind = 'background'),
live AS (SELECT * FROM causes c WHERE cause <> 'eraseColor' OR page_id IN (SELECT page_id FROM backed))
"""


def causes(v):
    names = F.array(*[F.lit(c) for c in CAUSES])
    return v.raw("events").select(
        F.col("user_id").alias("page_id"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("cause")
    ).distinct()


@query(
    "invalidate_artifacts",
    f"""WITH {CAUSES_SQL} SELECT page_id, kind FROM fx_artifacts a WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.page_id = a.page_id AND (
       (cause IN ('edit', 'defaultFont') AND kind = 'output') OR (cause IN ('batch', 'extraction') AND kind IN ('preview', 'output'))
       OR cause IN ('geometry', 'reset') OR (cause = 'eraseColor' AND kind IN ('background', 'preview', 'output'))))""",
    ("fx_artifacts",),
)
def _(v):
    return edits.invalidate_artifacts(v.artifacts(), causes(v)).select("page_id", "kind")


@query(
    "invalidate_stages",
    f"""WITH {CAUSES_SQL}, ranked AS (SELECT page_id, arg_max(cause, (CASE cause WHEN 'edit' THEN 1 WHEN 'defaultFont' THEN 1 WHEN 'batch' THEN 2 WHEN 'extraction' THEN 3 WHEN 'eraseColor' THEN 4 WHEN 'geometry' THEN 5 ELSE 6 END, cause)) AS cause FROM live GROUP BY page_id),
    tr AS (SELECT page_id, bool_or(translated_text <> '') AS t FROM fx_regions GROUP BY page_id)
    SELECT p.page_id, cause, CASE WHEN cause = 'reset' THEN 'scanned' WHEN cause IN ('geometry', 'eraseColor') THEN 'maskReady' WHEN cause = 'extraction' THEN 'translating'
      WHEN NOT coalesce(t, false) THEN 'maskReady' WHEN cause = 'batch' THEN 'translating' ELSE 'typesetting' END AS stage
    FROM fx_pages p JOIN ranked USING (page_id) LEFT JOIN tr USING (page_id)""",
    ("fx_pages", "fx_regions", "fx_artifacts"),
)
def _(v):
    return edits.invalidate_stages(v.pages(), causes(v), v.regions(), v.artifacts())


@query(
    "change_default_font",
    """SELECT region_id, CASE partkey % 3 WHEN 1 THEN 'new' ELSE 'f' || (partkey % 3) END AS font_name FROM fx_boxes""",
    ("fx_boxes",),
)
def _(v):
    regions = v.boxes().select("region_id", F.concat(F.lit("f"), F.col("partkey") % 3).alias("font_name"))
    return edits.change_default_font(regions, "f1", "new")


@query(
    "adopt_extraction",
    """SELECT region_id, CASE WHEN ord % 3 = 0 THEN 'new ' || ord ELSE source_text END AS source_text, CASE WHEN ord % 3 = 0 THEN '' ELSE translated_text END AS translated_text,
      CASE WHEN ord % 3 <> 0 THEN confidence END AS translation_confidence FROM fx_regions""",
    ("fx_regions",),
)
def _(v):
    extracted = v.boxes().select(
        "region_id", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("new "), "ord")).otherwise(" ").alias("source_text"),
        F.lit("raw").alias("raw_source_text"),
    )
    return edits.adopt_extraction(editable(v), extracted).select(
        "region_id", "source_text", "translated_text", "translation_confidence"
    )


POLYGONS = "array<array<struct<x:double,y:double>>>"


def masked(v):
    point = F.struct(F.col("x"), F.col("y"))
    polygon = F.array(F.array(point, point, point))
    return v.boxes().withColumns(
        {
            "mask_polygons": F.when(F.col("partkey") % 3 == 0, F.array().cast(POLYGONS)).otherwise(polygon),
            "mask_refined": F.col("partkey") % 2 == 0,
            "mask_coverage": F.col("confidence") * 1.5,
        }
    )


@query(
    "pending_masks",
    "SELECT region_id FROM fx_boxes WHERE partkey % 3 = 0 OR (partkey % 2 = 0 AND NOT mask_complete)",
    ("fx_boxes",),
)
def _(v):
    return edits.pending_masks(masked(v)).select("region_id")


@query(
    "duplicate_regions",
    """WITH made AS (SELECT page_id, ord, region_id AS source, 1 AS c, region_id || '+' AS region_id, round(least(greatest(x + 0.025, 0), greatest(0, 1 - width)), 6) AS x, false AS mask_complete FROM fx_boxes WHERE partkey % 10 < 3
      UNION ALL SELECT page_id, ord, region_id, 0, region_id, round(x, 6), mask_complete FROM fx_boxes)
    SELECT page_id, region_id, x, mask_complete, row_number() OVER (PARTITION BY page_id ORDER BY ord, source, c) AS position FROM made""",
    ("fx_boxes",),
)
def _(v):
    requests = v.boxes().where(F.col("partkey") % 10 < 3).select(
        "page_id", "region_id", F.concat("region_id", F.lit("+")).alias("new_id")
    )
    return edits.duplicate_regions(masked(v), requests).select(
        "page_id", "region_id", F.round("x", 6).alias("x"), "mask_complete", "position"
    )


@query(
    "normalize_regions",
    """SELECT rule, count(*) AS rows FROM (
      SELECT 'mask_coverage' AS rule FROM fx_boxes WHERE confidence * 1.5::DOUBLE > 1
      UNION ALL SELECT 'mask_polygons' FROM fx_boxes WHERE partkey % 3 <> 0 AND suppkey % 2 = 0
      UNION ALL SELECT 'qa_flags' FROM fx_boxes WHERE ord % 2 = 0
      UNION ALL SELECT 'bubble_bounds' FROM fx_boxes WHERE ord % 3 = 0) GROUP BY rule""",
    ("fx_boxes",),
)
def _(v):
    ord_ = F.col("ord")
    two = F.array(F.array(F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"))))
    beyond = F.struct(
        F.lit(0.5).alias("x"), F.lit(-0.5).alias("y"), F.lit(0.25).alias("width"), F.lit(2.0).alias("height")
    )
    rows = masked(v).withColumns(
        {
            "mask_polygons": F.when(F.col("suppkey") % 2 == 0, F.when(F.col("partkey") % 3 == 0, F.col("mask_polygons")).otherwise(two)).otherwise(F.col("mask_polygons")),
            "qa_flags": F.when(ord_ % 2 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))),
            "bubble_bounds": F.when(ord_ % 3 == 0, beyond),
        }
    )
    return edits.rule_counts(edits.normalize_regions(rows))


@query(
    "normalize_styles",
    """WITH s AS (SELECT p_partkey, (['#abc', ' #A1b2C3 ', 'red', '#12345', 'auto'])[p_partkey % 5 + 1] AS c FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#AABBCC' WHEN 1 THEN '#A1B2C3' ELSE '#111111' END AS text_color,
      CASE p_partkey % 5 WHEN 0 THEN '#AABBCC' WHEN 1 THEN '#A1B2C3' ELSE 'AUTO' END AS erase_color, least(p_partkey % 30, 20)::DOUBLE AS stroke_width FROM s""",
)
def _(v):
    key = F.col("p_partkey")
    codes = F.array(*[F.lit(c) for c in ("#abc", " #A1b2C3 ", "red", "#12345", "auto")])
    code = F.get(codes, (key % 5).cast("int"))
    styles = v.raw("part").select(
        key, code.alias("text_color"), code.alias("erase_color"), (key % 30).cast("double").alias("stroke_width")
    )
    return edits.normalize_styles(styles)


@query(
    "merge_recognition",
    """SELECT region_id, CASE WHEN ord % 4 = 0 THEN source_text ELSE 'read ' || ord END AS source_text, ord % 4 <> 0 AS text_confirmed,
      'm1:new,m2:' || ord AS ocr FROM fx_regions""",
    ("fx_regions",),
)
def _(v):
    def results(**texts):
        return F.map_from_arrays(F.array(*[F.lit(k) for k in texts]), F.array(*texts.values()))

    base = v.regions().withColumns(
        {
            "raw_source_text": F.lit(None).cast("string"),
            "text_confirmed": F.lit(False),
            "ocr_results": results(m1=F.lit("old"), m2=F.col("ord").cast("string")),
        }
    )
    read = F.when(F.col("ord") % 4 == 0, "  ").otherwise(F.concat(F.lit("read "), "ord"))
    recognized = v.boxes().select(
        "region_id", read.alias("source_text"), read.alias("raw_source_text"), F.lit(True).alias("text_confirmed"),
        results(m1=F.lit("new")).alias("ocr_results"),
    )
    merged = edits.merge_recognition(base, recognized)
    entries = F.transform(F.array_sort(F.map_entries("ocr_results")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return merged.select("region_id", "source_text", "text_confirmed", F.array_join(entries, ",").alias("ocr"))


@query(
    "ocr_merge",
    """SELECT region_id, CASE WHEN trim(source_text) = '' AND partkey % 4 <> 0 THEN 'seen ' || partkey ELSE source_text END AS source_text,
      NOT (trim(source_text) = '' AND partkey % 4 <> 0) AS text_confirmed, 2::INTEGER AS models FROM fx_regions""",
    ("fx_regions",),
)
def _(v):
    base = v.regions().withColumns(
        {
            "raw_source_text": F.lit(None).cast("string"),
            "text_confirmed": F.lit(True),
            "detected_direction": F.lit("automatic"),
            "ocr_results": F.lit(None).cast("map<string,struct<text:string,confidence:double,direction:string>>"),
        }
    )
    text = F.when(F.col("partkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" seen "), "partkey", F.lit(" ")))
    one = v.boxes().select(
        "region_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id"), text.alias("text"), "confidence",
        F.lit("vertical").alias("direction"),
    )
    return edits.ocr_merge(base, one).select(
        "region_id", "source_text", "text_confirmed", F.size("ocr_results").alias("models")
    )


@query(
    "merge_translations",
    """SELECT region_id, CASE WHEN ord % 3 = 0 THEN 'r' || ord WHEN ord % 2 = 0 THEN 'd' || ord ELSE translated_text END AS translated_text FROM fx_regions""",
    ("fx_regions",),
)
def _(v):
    ord_ = F.col("ord")
    drafts = v.boxes().where(ord_ % 2 == 0).select("region_id", F.concat(F.lit("d"), ord_).alias("translated_text"))
    recovered = v.boxes().where(ord_ % 3 == 0).select("region_id", F.concat(F.lit("r"), ord_).alias("translated_text"))
    return edits.merge_translations(v.regions(), drafts, recovered).select("region_id", "translated_text")


RETURNED_SQL = """
returned AS (SELECT request_id, region_id FROM fx_expected WHERE NOT (request_id % 7 = 0 AND region_id LIKE '%-1')
  UNION ALL SELECT request_id, region_id FROM fx_expected WHERE request_id % 5 = 0 AND region_id LIKE '%-0'
  UNION ALL SELECT request_id, region_id || 'x' FROM fx_expected WHERE request_id % 9 = 0 AND region_id LIKE '%-0')
"""


def returned(v):
    want = v.expected_ids()
    first = want.where(F.endswith("region_id", F.lit("-0")))
    parts = want.where(~((F.col("request_id") % 7 == 0) & F.endswith("region_id", F.lit("-1"))))
    again = first.where(F.col("request_id") % 5 == 0)
    foreign = first.where(F.col("request_id") % 9 == 0).withColumn("region_id", F.concat("region_id", F.lit("x")))
    return parts.unionByName(again).unionByName(foreign)


@query(
    "audit_completeness",
    f"""WITH {RETURNED_SQL}, got AS (SELECT request_id, region_id, count(*) AS n FROM returned GROUP BY ALL),
    b AS (SELECT coalesce(e.request_id, g.request_id) AS request_id, e.region_id AS w, g.n FROM fx_expected e FULL JOIN got g ON e.request_id = g.request_id AND e.region_id = g.region_id)
    SELECT request_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected, count(*) FILTER (n > 1) AS repeated,
      count(*) FILTER (n IS NULL OR w IS NULL OR n > 1) = 0 AS complete FROM b GROUP BY request_id""",
    ("fx_expected",),
)
def _(v):
    return edits.audit_completeness(v.expected_ids(), returned(v))


@query(
    "missing_ids",
    f"WITH {RETURNED_SQL} SELECT request_id, region_id FROM fx_expected EXCEPT SELECT request_id, region_id FROM returned",
    ("fx_expected",),
)
def _(v):
    return sets.missing_ids(v.expected_ids(), returned(v))


LOG_SQL = """
log AS (SELECT user_id AS page_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'edit' END AS action, 'k' || (regexp_extract(props, '[0-9]+', 0)::INTEGER % 4) AS state FROM events)
"""


def history_log(v):
    kind = F.col("event_type")
    return v.raw("events").select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "undo").when(kind == "purchase", "redo").otherwise("edit").alias("action"),
        F.concat(F.lit("k"), F.regexp_extract("props", "[0-9]+", 0).cast("int") % 4).alias("state"),
    )


@query(
    "replay_edits",
    f"""WITH {LOG_SQL}, lists AS (SELECT page_id, list({{a: action, s: state, u: []::VARCHAR[], r: []::VARCHAR[], c: ''}} ORDER BY seq) AS l FROM log GROUP BY page_id),
    done AS (SELECT page_id, list_reduce(list_prepend({{a: '', s: '', u: []::VARCHAR[], r: []::VARCHAR[], c: ''}}, l), lambda h, e: CASE
       WHEN e.a = 'edit' THEN {{a: '', s: '', u: list_slice(CASE WHEN len(h.u) > 0 AND h.u[-1] = h.c THEN h.u ELSE list_append(h.u, h.c) END, -50, -1), r: []::VARCHAR[], c: e.s}}
       WHEN e.a = 'undo' AND len(h.u) > 0 THEN {{a: '', s: '', u: h.u[1:len(h.u) - 1], r: list_append(h.r, h.c), c: h.u[-1]}}
       WHEN e.a = 'redo' AND len(h.r) > 0 THEN {{a: '', s: '', u: list_append(h.u, h.c), r: h.r[1:len(h.r) - 1], c: h.r[-1]}} ELSE h END) AS h FROM lists)
    SELECT page_id, array_to_string(h.u, ',') AS undo, array_to_string(h.r, ',') AS redo, h.c AS current FROM done""",
)
def _(v):
    return edits.replay_edits(history_log(v)).select(
        "page_id", F.array_join("undo", ",").alias("undo"), F.array_join("redo", ",").alias("redo"), "current"
    )


@query(
    "tail_log",
    """WITH e AS (SELECT user_id % 3 AS app, event_id AS entry_id, ts, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS category, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE ' ' || props || ' ' END AS message FROM events)
    SELECT app, entry_id, CASE WHEN trim(category) = '' THEN 'App' ELSE category END AS category, trim(message) AS message FROM e WHERE trim(message) <> ''
    QUALIFY row_number() OVER (PARTITION BY app ORDER BY ts DESC, entry_id DESC) <= 500""",
)
def _(v):
    key = F.col("event_id")
    entries = v.raw("events").select(
        (F.col("user_id") % 3).alias("app"), key.alias("entry_id"), "ts",
        F.when(key % 4 == 0, " ").otherwise(F.col("event_type")).alias("category"),
        F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "props", F.lit(" "))).alias("message"),
    )
    return edits.tail_log(entries).select("app", "entry_id", "category", "message")


@query(
    "recover_jobs",
    """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status,
      CASE WHEN o_orderstatus = 'F' THEN 7 END AS current_page, CASE WHEN o_orderstatus <> 'F' THEN 0::BIGINT END AS finished_at FROM orders""",
)
def _(v):
    state = F.col("o_orderstatus")
    jobs = v.raw("orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(state == "F", "completed").when(state == "P", "running").otherwise("queued").alias("status"),
        F.lit(7).alias("current_page"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    return edits.recover_jobs(jobs, F.timestamp_seconds(F.lit(0))).withColumn("finished_at", F.unix_timestamp("finished_at"))
