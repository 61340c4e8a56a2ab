"""Box matching, suppression and containment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions.boxes import Box
from inkloom.operators import sets, spatial
from inkloom.plans.catalog import query
from inkloom.plans.views_sql import area, coverage, iou, overlap_area

ITEM = "(e[1])"


def greedy_list_sql(order: str, fields: str, clash: str, source: str, by: str = "page_id") -> str:
    """``kept(by, k)``: the sequential pass over each group's ordered list."""
    return f"""
lists AS (SELECT {by}, list({{{fields}}} ORDER BY {order}) AS l FROM {source} GROUP BY {by}),
kept AS (SELECT {by}, list_reduce(list_transform(l, lambda e: [e]),
   lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM lists)
"""


BOX_FIELDS = "x: x, y: y, width: width, height: height"


@query(
    "overlap_pairs",
    f"""SELECT a.page_id, a.region_id AS a_region_id, b.region_id AS b_region_id, round({coverage('a', 'b')}, 6) AS coverage
    FROM fx_regions a JOIN fx_regions b ON a.page_id = b.page_id AND (a.ord, a.region_id) < (b.ord, b.region_id)
    WHERE {coverage('a', 'b')} >= 0.82 OR ({coverage('a', 'b')} >= 0.25 AND replace(a.source_text, ' ', '') <> ''
       AND replace(a.source_text, ' ', '') = replace(b.source_text, ' ', ''))""",
    ("fx_regions",),
)
def _(v):
    return spatial.overlap_pairs(v.regions()).withColumn("coverage", F.round("coverage", 6))


@query(
    "suppress_boxes",
    f"""WITH {greedy_list_sql('confidence DESC, region_id', f'id: region_id, c: confidence, {BOX_FIELDS}', f"{iou('k', ITEM)} >= 0.5", 'fx_boxes')}
    SELECT page_id, e.id AS det_id, e.c AS confidence FROM (SELECT page_id, unnest(list_slice(k, 1, 36)) AS e FROM kept)""",
    ("fx_boxes",),
)
def _(v):
    boxes = v.boxes().select("page_id", F.col("region_id").alias("det_id"), "x", "y", "width", "height", "confidence")
    return spatial.suppress_boxes(boxes).select("page_id", "det_id", "confidence")


def proposals(v):
    return v.detections().select(
        "page_id",
        F.concat(F.lit("c"), F.col("ord") % 3).alias("call_id"),
        F.col("det_id").alias("proposal_id"),
        "ord",
        "x", "y", "width", "height",
        F.when(F.col("ord") == 7, "").otherwise("said").alias("source_text"),
    )


BOTH = f"{overlap_area('a', 'b')} / {area('a')} >= 0.5 AND {overlap_area('a', 'b')} / {area('b')} >= 0.5"


@query(
    "reject_duplicate_boxes",
    f"""WITH prop AS (SELECT page_id, 'c' || (ord % 3) AS call_id, det_id AS proposal_id, ord, x, y, width, height, ord = 7 AS blank FROM fx_detections),
    calls AS (SELECT page_id, call_id, NOT bool_or(blank) AND count(*) BETWEEN 1 AND 64 AS ok FROM prop GROUP BY ALL),
    fresh AS (SELECT a.* FROM prop a JOIN calls c ON c.page_id = a.page_id AND c.call_id = a.call_id AND c.ok
       WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.page_id = a.page_id AND {BOTH})),
    {greedy_list_sql('ord, proposal_id', f'id: proposal_id, {BOX_FIELDS}', BOTH.replace('a.', 'k.').replace('b.', ITEM + '.'), 'fresh', 'page_id, call_id')},
    accepted AS (SELECT page_id, call_id, unnest(k).id AS proposal_id FROM kept)
    SELECT p.page_id, p.call_id, p.proposal_id,
      CASE WHEN NOT c.ok THEN 'invalid' WHEN a.proposal_id IS NOT NULL THEN 'accepted' ELSE 'duplicate' END AS verdict
    FROM prop p JOIN calls c ON c.page_id = p.page_id AND c.call_id = p.call_id
    LEFT JOIN accepted a ON a.page_id = p.page_id AND a.proposal_id = p.proposal_id""",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    return spatial.reject_duplicate_boxes(proposals(v), v.boxes())


def match_sql(pairs: str, order: str) -> str:
    return f"""
pairs AS ({pairs}),
plists AS (SELECT page_id, list({{l: l, r: r, s: s}} ORDER BY {order}) AS p FROM pairs GROUP BY page_id),
matched AS (SELECT page_id, list_reduce(list_transform(p, lambda e: [e]),
   lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: k.l = e[1].l OR k.r = e[1].r)) > 0 THEN acc ELSE list_concat(acc, e) END) AS m FROM plists),
matches AS (SELECT page_id, m.l AS l, m.r AS r, m.s AS s FROM (SELECT page_id, unnest(m) AS m FROM matched))
"""


SNAP_PAIRS = f"""SELECT a.page_id, a.region_id AS l, b.det_id AS r, {coverage('a', 'b')} AS s, a.ord AS lo, b.ord AS ro
  FROM fx_boxes a JOIN fx_detections b ON a.page_id = b.page_id WHERE {coverage('a', 'b')} >= 0.5"""


@query(
    "snap_regions",
    f"""WITH {match_sql(SNAP_PAIRS, 's DESC, lo, l, ro, r')}
    SELECT a.page_id, a.region_id, m.r AS det_id, round(coalesce(d.x, a.x), 6) AS x, round(coalesce(d.y, a.y), 6) AS y,
      coalesce(d.width, a.width) AS width, coalesce(d.height, a.height) AS height
    FROM fx_boxes a LEFT JOIN matches m ON m.page_id = a.page_id AND m.l = a.region_id
    LEFT JOIN fx_detections d ON d.page_id = a.page_id AND d.det_id = m.r""",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    snapped = spatial.snap_regions(v.boxes().select("page_id", "region_id", "ord", "x", "y", "width", "height"), v.detections())
    return snapped.select(
        "page_id", "region_id", "det_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "width", "height"
    )


REID_PAIRS = f"""SELECT a.page_id, a.det_id AS l, b.region_id AS r, {coverage('a', 'b')} AS s, a.ord AS lo, b.ord AS ro
  FROM fx_detections a JOIN fx_boxes b ON a.page_id = b.page_id WHERE {coverage('a', 'b')} >= 0.25"""


@query(
    "reidentify_regions",
    f"""WITH {match_sql(REID_PAIRS, 'lo, l, s DESC, ro, r')}
    SELECT d.page_id, coalesce(m.r, d.det_id) AS region_id, d.det_id AS detected_id,
      CASE WHEN trim(coalesce(b.source_text, '')) <> '' THEN b.source_text ELSE '' END AS source_text,
      b.translated_text
    FROM fx_detections d LEFT JOIN matches m ON m.page_id = d.page_id AND m.l = d.det_id
    LEFT JOIN fx_regions b ON b.page_id = d.page_id AND b.region_id = m.r""",
    ("fx_boxes", "fx_detections", "fx_regions"),
)
def _(v):
    previous = v.boxes().select("page_id", "region_id", "ord", "x", "y", "width", "height", "partkey", "suppkey")
    detected = v.detections().select(
        "page_id", F.col("det_id").alias("region_id"), "ord", "x", "y", "width", "height", F.lit("").alias("source_text")
    )
    out = spatial.reidentify_regions(previous, detected, recall=v.recalled)
    return out.select("page_id", "region_id", "detected_id", "source_text", "translated_text")


ENCLOSURES_SQL = """
encl AS (SELECT page_id, 'e' || region_id AS enclosure_id, ord, greatest(x - width * 0.25::DOUBLE, 0.0) AS x, greatest(y - height * 0.25::DOUBLE, 0.0) AS y,
   least(x + width * 1.25::DOUBLE, 1.0) AS x2, least(y + height * 1.25::DOUBLE, 1.0) AS y2 FROM fx_boxes),
enclosures AS (SELECT page_id, enclosure_id, ord, x, y, x2 - x AS width, y2 - y AS height FROM encl)
"""


def enclosures(v):
    b = Box.columns()
    grown = Box.edges(
        F.greatest(b.x - b.width * 0.25, F.lit(0.0)),
        F.greatest(b.y - b.height * 0.25, F.lit(0.0)),
        F.least(b.x + b.width * 1.25, F.lit(1.0)),
        F.least(b.y + b.height * 1.25, F.lit(1.0)),
    )
    return v.boxes().select("page_id", F.concat(F.lit("e"), "region_id").alias("enclosure_id"), "ord", *grown.named())


def inside(a: str, b: str) -> str:
    return f"({overlap_area(a, b)} / {area(a)})"


@query(
    "smallest_enclosure",
    f"""WITH {ENCLOSURES_SQL}
    SELECT t.page_id, t.region_id, arg_min(e.enclosure_id, (e.width * e.height, e.ord, e.enclosure_id)) AS enclosure_id
    FROM fx_boxes t LEFT JOIN enclosures e ON e.page_id = t.page_id AND {inside('t', 'e')} >= 0.9 GROUP BY ALL""",
    ("fx_boxes",),
)
def _(v):
    return spatial.smallest_enclosure(v.boxes(), enclosures(v))


def clusters(v):
    return v.boxes().select(
        "page_id", F.col("region_id").alias("cluster_id"), "ord", "x", "y", "width", "height",
        (F.col("partkey") % 17).alias("glyph_count"),
    )


@query(
    "best_cluster_per_enclosure",
    f"""WITH {ENCLOSURES_SQL}
    SELECT e.page_id, e.enclosure_id, arg_min(c.region_id, (-(c.partkey % 17), c.ord, c.region_id)) AS cluster_id
    FROM enclosures e LEFT JOIN fx_boxes c ON e.page_id = c.page_id AND {inside('c', 'e')} >= 0.6 GROUP BY ALL""",
    ("fx_boxes",),
)
def _(v):
    return spatial.best_cluster_per_enclosure(enclosures(v), clusters(v))


def detection_enclosures(v):
    return v.detections().select("page_id", F.col("det_id").alias("enclosure_id"), "ord", "x", "y", "width", "height")


UNCOVERED_SQL = f"""
free AS (SELECT * FROM fx_boxes c WHERE NOT EXISTS (SELECT 1 FROM fx_detections e WHERE e.page_id = c.page_id AND {inside('c', 'e')} >= 0.6)),
uncovered AS (SELECT page_id, region_id AS cluster_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY ord, region_id)::INTEGER AS position FROM free
  QUALIFY position <= 12)
"""


@query(
    "uncovered_clusters",
    f"WITH {UNCOVERED_SQL} SELECT page_id, cluster_id, position FROM uncovered",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    return spatial.uncovered_clusters(clusters(v), detection_enclosures(v)).select("page_id", "cluster_id", "position")


@query(
    "union_candidates",
    f"""WITH {UNCOVERED_SQL}, both_kinds AS (SELECT page_id, det_id AS candidate_id, ord, 0 AS source FROM fx_detections
      UNION ALL SELECT page_id, cluster_id, ord, 1 FROM uncovered)
    SELECT page_id, candidate_id, row_number() OVER (PARTITION BY page_id ORDER BY source, ord, candidate_id) AS candidate_index FROM both_kinds""",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    primary = v.detections().select("page_id", F.col("det_id").alias("candidate_id"), "ord")
    extra = spatial.uncovered_clusters(clusters(v), detection_enclosures(v)).select(
        "page_id", F.col("cluster_id").alias("candidate_id"), "ord"
    )
    return sets.union_candidates(primary, extra).drop("ord")


@query(
    "lines_inside_shapes",
    """WITH shapes AS (SELECT page_id, (page_id % 3)::DOUBLE / 10 AS l, (page_id % 4)::DOUBLE / 10 AS t FROM fx_pages)
    SELECT balloon_id, line_id FROM fx_lines JOIN shapes ON page_id = balloon_id
    WHERE balloon_id % 9 = 0 OR (x + width / 2 BETWEEN l AND l + 0.5 AND y + height / 2 BETWEEN t AND t + 0.45)""",
    ("fx_pages", "fx_lines"),
)
def _(v):
    page = F.col("page_id")
    left, top = (page % 3).cast("double") / 10, (page % 4).cast("double") / 10
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    polygon = F.array(point(left, top), point(left + 0.5, top), point(left + 0.5, top + 0.45), point(left, top + 0.45))
    shapes = v.pages().select(
        page.alias("balloon_id"),
        F.when(page % 9 == 0, F.array().cast("array<array<struct<x:double,y:double>>>"))
        .otherwise(F.array(polygon))
        .alias("mask_polygons"),
    )
    return spatial.lines_inside_shapes(v.lines(), shapes).select("balloon_id", "line_id")


@query(
    "assign_components",
    """WITH comp AS (SELECT page_id, component_id, min_x AS x0, min_y AS y0, min_x + w // 4 AS x1, min_y + h // 4 AS y1 FROM fx_components),
    grown AS (SELECT b.page_id, region_id, ord, pixel_width AS pw, pixel_height AS ph,
        greatest(x - width * m, 0.0) AS l, greatest(y - height * m, 0.0) AS t, least(x - width * m + (width + width * m * 2), 1.0) AS r, least(y - height * m + (height + height * m * 2), 1.0) AS bt
      FROM (SELECT *, greatest(0.005::DOUBLE, 4.0::DOUBLE / least(pixel_width, pixel_height)) AS m FROM fx_detections_as_regions JOIN fx_pages USING (page_id)) b),
    bounds AS (SELECT page_id, region_id, ord, greatest(0, least(pw - 1, floor(l * pw)))::BIGINT AS rx0, greatest(0, least(ph - 1, floor(t * ph)))::BIGINT AS ry0,
        greatest(0, least(pw - 1, ceil((l + (r - l)) * pw) - 1))::BIGINT AS rx1, greatest(0, least(ph - 1, ceil((t + (bt - t)) * ph) - 1))::BIGINT AS ry1 FROM grown),
    scored AS (SELECT c.page_id, component_id, region_id, ord, (least(x1, rx1) - greatest(x0, rx0) + 1) AS ow, (least(y1, ry1) - greatest(y0, ry0) + 1) AS oh
      FROM comp c JOIN bounds b ON b.page_id = c.page_id),
    owner AS (SELECT page_id, component_id, arg_min(region_id, (-(ow * oh), ord, region_id)) AS region_id FROM scored WHERE ow > 0 AND oh > 0 GROUP BY ALL)
    SELECT c.page_id, o.region_id, CASE WHEN o.region_id IS NULL THEN c.component_id END AS component_id,
      min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS parts
    FROM comp c LEFT JOIN owner o ON o.page_id = c.page_id AND o.component_id = c.component_id GROUP BY ALL""".replace(
        "fx_detections_as_regions", "(SELECT page_id, det_id AS region_id, ord, x, y, width, height FROM fx_detections)"
    ),
    ("fx_pages", "fx_components", "fx_detections"),
)
def _(v):
    components = v.components().select(
        "page_id", "component_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"),
        (F.col("min_x") + F.floor(F.col("w") / 4)).alias("x1"), (F.col("min_y") + F.floor(F.col("h") / 4)).alias("y1"),
    )
    regions = v.detections().select("page_id", F.col("det_id").alias("region_id"), "ord", "x", "y", "width", "height")
    return spatial.assign_components(components, regions, v.pages())


@query(
    "attribute_strokes",
    """WITH strokes AS (SELECT page_id, det_id AS stroke_id, x + width AS px, y + height AS py, 0.01::DOUBLE * (1 + ord) AS d FROM fx_detections),
    hits AS (SELECT s.page_id, stroke_id, arg_min(region_id, (width * height, ord, region_id)) AS hit FROM strokes s JOIN fx_boxes b ON b.page_id = s.page_id
      AND px BETWEEN x - d * 1.5::DOUBLE AND x + width + d * 1.5::DOUBLE AND py BETWEEN y - d * 1.5::DOUBLE AND y + height + d * 1.5::DOUBLE GROUP BY ALL),
    firsts AS (SELECT page_id, arg_min(region_id, (ord, region_id)) AS first_region, CASE WHEN page_id % 2 = 0 THEN arg_max(region_id, (ord, region_id)) END AS selected FROM fx_boxes GROUP BY page_id)
    SELECT s.page_id, s.stroke_id, coalesce(hit, selected, first_region) AS region_id FROM strokes s
    LEFT JOIN hits h ON h.page_id = s.page_id AND h.stroke_id = s.stroke_id LEFT JOIN firsts f ON f.page_id = s.page_id""",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    strokes = v.detections().select(
        "page_id", F.col("det_id").alias("stroke_id"), (F.col("x") + F.col("width")).alias("px"),
        (F.col("y") + F.col("height")).alias("py"), (F.lit(0.01) * (1 + F.col("ord"))).alias("diameter"),
    )
    selected = v.boxes().groupBy("page_id").agg(F.max_by("region_id", F.struct("ord", "region_id")).alias("r")).select(
        "page_id", F.when(F.col("page_id") % 2 == 0, F.col("r")).alias("selected_region")
    )
    return spatial.attribute_strokes(strokes, v.boxes(), selected)


@query(
    "nearest_neighbour",
    """WITH c AS (SELECT page_id AS group_id, region_id AS glyph_id, ord, x + width / 2 AS cx, y + height / 2 AS cy FROM fx_boxes)
    SELECT a.group_id, a.glyph_id, arg_min(b.glyph_id, ((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy), b.ord, b.glyph_id)) AS neighbour
    FROM c a LEFT JOIN c b ON a.group_id = b.group_id AND a.glyph_id <> b.glyph_id GROUP BY ALL""",
    ("fx_boxes",),
)
def _(v):
    glyphs = v.boxes().select(
        F.col("page_id").alias("group_id"), F.col("region_id").alias("glyph_id"), "ord", "x", "y", "width", "height"
    )
    return spatial.nearest_neighbour(glyphs).drop("d2")


TRUTH_PAIRS = """SELECT t.page_id, t.region_id AS l, o.det_id AS r, t.ord AS lo, o.ord AS ro,
    sqrt(power((t.x + t.width / 2) - (o.x + o.width / 2), 2) + power((t.y + t.height / 2) - (o.y + o.height / 2), 2)) AS s
  FROM fx_boxes t JOIN fx_detections o ON o.page_id = t.page_id"""


@query(
    "match_truth",
    f"""WITH {match_sql(f"SELECT * FROM ({TRUTH_PAIRS}) WHERE s <= 0.06", 'lo, l, s, ro, r')}
    SELECT t.page_id, t.region_id AS truth_id, m.r AS obs_id, coalesce('o' || m.r, '') AS observed
    FROM fx_boxes t LEFT JOIN matches m ON m.page_id = t.page_id AND m.l = t.region_id""",
    ("fx_boxes", "fx_detections"),
)
def _(v):
    center = [(F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")]
    truth = v.boxes().select("page_id", F.col("region_id").alias("truth_id"), "ord", *center)
    observed = v.detections().select(
        "page_id", F.col("det_id").alias("obs_id"), "ord", *center, F.concat(F.lit("o"), "det_id").alias("text")
    )
    return spatial.match_truth(truth, observed).select("page_id", "truth_id", "obs_id", "observed")


@query(
    "detections_to_regions",
    """SELECT page_id, sha256(page_id || '|' || det_id) AS region_id, round(x, 6) AS x, round(bubble_y, 6) AS bubble_y, '' AS source_text,
        0.5::DOUBLE AS confidence, false AS automatic_mask, 'PingFang TC' AS font_name
      FROM (SELECT *, y AS bubble_y FROM fx_detections)""",
    ("fx_detections",),
)
def _(v):
    made = spatial.detections_to_regions(v.detections(), {"font_name": "PingFang TC"})
    return made.select(
        "page_id", "region_id", F.round("x", 6).alias("x"), F.round("bubble_y", 6).alias("bubble_y"),
        "source_text", "confidence", "automatic_mask", "font_name",
    )


@query(
    "box_algebra",
    """WITH b AS (SELECT region_id, x, y, x + width AS r, y + height AS b, width, height FROM fx_boxes)
    SELECT region_id, round(width * height, 6) AS area, round(x + width / 2, 6) AS center_x,
      round(least(r + width * 0.5::DOUBLE, 1.0) - greatest(x - width * 0.5::DOUBLE, 0.0), 6) AS expanded_width,
      round(greatest(r, 0.6) - least(x, 0.2), 6) AS union_width,
      round(CASE WHEN least(r, 0.6) > greatest(x, 0.2) AND least(b, 0.7) > greatest(y, 0.3) THEN (least(r, 0.6) - greatest(x, 0.2)) * (least(b, 0.7) - greatest(y, 0.3)) ELSE 0 END, 6) AS shared_area,
      round(least(r + 0.25::DOUBLE, 1.0) - least(x + 0.25::DOUBLE, 1.0), 6) AS clamped_width
    FROM b""",
    ("fx_boxes",),
)
def _(v):
    box = Box.columns()
    window = Box.edges(F.lit(0.2), F.lit(0.3), F.lit(0.6), F.lit(0.7))
    moved = Box(box.x + 0.25, box.y, box.width, box.height).clamp()
    columns = {
        "area": box.area,
        "center_x": box.center_x,
        "expanded_width": box.expand(0.5).width,
        "union_width": box.union(window).width,
        "shared_area": box.intersect(window).area,
        "clamped_width": moved.width,
    }
    return v.boxes().select("region_id", *[F.round(value, 6).alias(name) for name, value in columns.items()])
