"""Grouping, reading order, run merging, histogram and detector-output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.operators import detection, grouping, reading, statistics
from inkloom.plans.catalog import query


def _overlap(a0, a1, b0, b1):
    return f"(greatest(least({a1}, {b1}) - greatest({a0}, {b0}), 0.0) / least(({a1}) - ({a0}), ({b1}) - ({b0})))"


def _gap(a0, a1, b0, b1):
    return f"greatest(greatest({a0}, {b0}) - least({a1}, {b1}), 0.0)"


X = ("a.x", "a.x + a.width", "b.x", "b.x + b.width")
Y = ("a.y", "a.y + a.height", "b.y", "b.y + b.height")
XO, YO, XG, YG = _overlap(*X), _overlap(*Y), _gap(*X), _gap(*Y)
SAME_BLOCK = f"""CASE
  WHEN a.height >= a.width * 1.35::DOUBLE AND b.height >= b.width * 1.35::DOUBLE THEN
    ({YO} >= 0.52 AND {XG} <= greatest(a.width, b.width) * 1.75::DOUBLE) OR ({XO} >= 0.45 AND {YG} <= greatest(a.width, b.width) * 1.8::DOUBLE)
  WHEN a.width >= a.height * 1.35::DOUBLE AND b.width >= b.height * 1.35::DOUBLE THEN
    ({XO} >= 0.52 AND {YG} <= greatest(a.height, b.height) * 1.75::DOUBLE) OR ({YO} >= 0.45 AND {XG} <= greatest(a.height, b.height) * 1.8::DOUBLE)
  ELSE ({XO} >= 0.5 AND {YG} <= greatest(least(a.width, a.height), least(b.width, b.height)))
    OR ({YO} >= 0.5 AND {XG} <= greatest(least(a.width, a.height), least(b.width, b.height))) END"""
BLOCKS_SQL = f"""
links AS (SELECT a.balloon_id, a.line_id AS f, b.line_id AS t FROM fx_lines a JOIN fx_lines b ON a.balloon_id = b.balloon_id AND a.line_id <> b.line_id WHERE {SAME_BLOCK}),
reach AS (SELECT balloon_id, line_id AS f, line_id AS t FROM fx_lines UNION SELECT r.balloon_id, r.f, l.t FROM reach r JOIN links l ON l.balloon_id = r.balloon_id AND l.f = r.t),
blocks AS (SELECT balloon_id, t AS line_id, min(f) AS group_label FROM reach GROUP BY ALL)
"""


@query(
    "group_text_lines",
    f"WITH RECURSIVE {BLOCKS_SQL} SELECT balloon_id, line_id, group_label FROM blocks",
    ("fx_lines",),
)
def _(v):
    return grouping.group_text_lines(v.lines()).select("balloon_id", "line_id", "group_label")


@query(
    "line_group_summary",
    f"""WITH RECURSIVE {BLOCKS_SQL},
    boxes AS (SELECT balloon_id, group_label, min(x) AS l, min(y) AS t, max(x + width) AS r, max(y + height) AS b, avg(confidence) AS confidence,
        count(*) AS lines, min((ord, line_id)) AS first_line FROM fx_lines JOIN blocks USING (balloon_id, line_id) GROUP BY ALL),
    scored AS (SELECT *, CASE WHEN balloon_id % 5 = 0 THEN 0.0 ELSE greatest(least(r, 0.7) - greatest(l, 0.2), 0.0) * greatest(least(b, 0.8) - greatest(t, 0.3), 0.0) END AS shared FROM boxes),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY balloon_id ORDER BY shared DESC, first_line) AS rk, count(*) OVER (PARTITION BY balloon_id) AS blocks_n FROM scored),
    chosen AS (SELECT *, blocks_n = 1 OR (rk = 1 AND shared > 0) AS is_primary,
       greatest(greatest(l - (r - l) * 0.4, 0.0), 0.1) AS el, greatest(greatest(t - (b - t) * 0.4, 0.0), 0.1) AS et,
       least(least(r + (r - l) * 0.4, 1.0), 0.9) AS er, least(least(b + (b - t) * 0.4, 1.0), 0.9) AS eb FROM ranked)
    SELECT balloon_id, group_label, round(confidence, 6) AS confidence, lines, is_primary, round(r - l, 6) AS width, round(b - t, 6) AS height,
      round(CASE WHEN is_primary THEN CASE WHEN balloon_id % 5 <> 0 THEN 0.2 END WHEN er > el AND eb > et THEN el ELSE l END, 6) AS layout_x,
      round(CASE WHEN is_primary THEN CASE WHEN balloon_id % 5 <> 0 THEN 0.5 END WHEN er > el AND eb > et THEN eb - et ELSE b - t END, 6) AS layout_height
    FROM chosen""",
    ("fx_lines",),
)
def _(v):
    lit = lambda x, y, w, h: F.struct(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height")
    )
    balloons = v.pages().select(
        F.col("page_id").alias("balloon_id"), F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.8).alias("width"),
        F.lit(0.8).alias("height"), F.when(F.col("page_id") % 5 != 0, lit(0.2, 0.3, 0.5, 0.5)).alias("layout"),
    )
    out = grouping.line_group_summary(grouping.group_text_lines(v.lines()), balloons)
    rounded = {c: F.round(c, 6) for c in ("confidence", "width", "height")}
    return out.select(
        "balloon_id", "group_label", "lines", "is_primary", *[e.alias(c) for c, e in rounded.items()],
        F.round("layout.x", 6).alias("layout_x"), F.round("layout.height", 6).alias("layout_height"),
    )


GLYPHS_SQL = """
glyphs AS (SELECT page_id, component_id AS glyph_id, min_x AS x0, min_y AS y0, min_x + w AS x1, min_y + h AS y1, greatest(w, h) AS size FROM fx_components)
"""
GLYPH_LINK = """greatest(a.size, b.size)::DOUBLE / least(a.size, b.size) <= 2.6 AND b.y0 <= a.y1 + reach
  AND a.x0 - reach < b.x1 + reach // 2 AND b.x0 - reach // 2 < a.x1 + reach AND a.y0 - reach < b.y1 + reach // 2 AND b.y0 - reach // 2 < a.y1 + reach"""


def glyphs(v):
    return v.components().select(
        "page_id", F.col("component_id").alias("glyph_id"), F.lit(0).alias("ord"), F.col("min_x").alias("x0"),
        F.col("min_y").alias("y0"), (F.col("min_x") + F.col("w")).alias("x1"), (F.col("min_y") + F.col("h")).alias("y1"),
    )


@query(
    "cluster_glyphs",
    f"""WITH RECURSIVE {GLYPHS_SQL},
    oneway AS (SELECT a.page_id, a.glyph_id AS f, b.glyph_id AS t FROM (SELECT *, greatest(2, floor(size * 1.3::DOUBLE))::BIGINT AS reach FROM glyphs) a JOIN glyphs b
      ON a.page_id = b.page_id AND (a.y0, a.glyph_id) < (b.y0, b.glyph_id) WHERE {GLYPH_LINK}),
    links AS (SELECT * FROM oneway UNION ALL SELECT page_id, t, f FROM oneway),
    reach AS (SELECT page_id, glyph_id AS f, glyph_id AS t FROM glyphs UNION SELECT r.page_id, r.f, l.t FROM reach r JOIN links l ON l.page_id = r.page_id AND l.f = r.t),
    labels AS (SELECT page_id, t AS glyph_id, min(f) AS group_label FROM reach GROUP BY ALL),
    groups AS (SELECT page_id, group_label, count(*) AS glyph_count, list_sort(list(size))[count(*) // 2 + 1] AS median_size, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
      FROM glyphs JOIN labels USING (page_id, glyph_id) GROUP BY ALL HAVING count(*) >= 5),
    padded AS (SELECT g.*, greatest(2, median_size // 3) AS pad, pixel_width AS pw, pixel_height AS ph FROM groups g JOIN fx_pages USING (page_id))
    SELECT page_id, group_label, glyph_count, median_size, round(greatest(0, x0 - pad)::DOUBLE / pw, 6) AS x,
      round(least(ph, y1 + pad)::DOUBLE / ph - greatest(0, y0 - pad)::DOUBLE / ph, 6) AS height
    FROM padded QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY glyph_count DESC, group_label) <= 40""",
    ("fx_pages", "fx_components"),
)
def _(v):
    return grouping.cluster_glyphs(glyphs(v), v.pages()).select(
        "page_id", "group_label", "glyph_count", "median_size", F.round("x", 6).alias("x"), F.round("height", 6).alias("height")
    )


FIT = "(a.x - m * 0.15::DOUBLE < b.r AND b.x < a.r + m * 0.15::DOUBLE AND a.y - m * 0.15::DOUBLE < b.b AND b.y < a.b + m * 0.15::DOUBLE AND greatest(greatest(a.r, b.r) - least(a.x, b.x), greatest(a.b, b.b) - least(a.y, b.y)) <= m * 1.25::DOUBLE)"


@query(
    "vote_direction",
    f"""WITH RECURSIVE parts AS (SELECT balloon_id AS g, list({{ord: ord, id: line_id, x: x, y: y, r: x + width, b: y + height}} ORDER BY ord, line_id) AS l,
        list_sort(list(greatest(width, height)))[count(*) // 2 + 1] AS m FROM fx_lines WHERE width > 0 AND height > 0 GROUP BY balloon_id),
    steps AS (SELECT g, m, l FROM parts UNION ALL
      SELECT g, m, list_concat(l[1:i - 1], [{{ord: l[i].ord, id: l[i].id, x: least(l[i].x, l[j].x), y: least(l[i].y, l[j].y), r: greatest(l[i].r, l[j].r), b: greatest(l[i].b, l[j].b)}}], l[i + 1:j - 1], l[j + 1:]) AS l
      FROM (SELECT g, m, l, p.i AS i, p.j AS j FROM (SELECT g, any_value(m) AS m, any_value(l) AS l, arg_min({{i: i, j: j}}, i * 100000 + j) AS p
         FROM (SELECT g, m, l, i, unnest(range(i + 1, len(l) + 1)) AS j FROM (SELECT g, m, l, unnest(range(1, len(l))) AS i FROM steps))
         WHERE list_transform([{{a: l[i], b: l[j]}}], lambda e: {FIT.replace("a.", "e.a.").replace(" b.", " e.b.").replace("(b.", "(e.b.")})[1] GROUP BY g))),
    merged AS (SELECT g, unnest(arg_min(l, len(l))) AS q FROM steps GROUP BY g),
    c AS (SELECT g, q.id AS id, q.ord AS ord, q.x + (q.r - q.x) / 2 AS cx, q.y + (q.b - q.y) / 2 AS cy FROM merged),
    near AS (SELECT a.g, a.id, arg_min({{x: abs(b.cx - a.cx), y: abs(b.cy - a.cy)}}, ((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy), b.ord, b.id)) FILTER (b.id IS NOT NULL) AS d
      FROM c a LEFT JOIN c b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
    tally AS (SELECT g, count(*) AS n, count(*) FILTER (d.y > d.x) AS v, count(*) FILTER (d.x > d.y) AS h FROM near GROUP BY g)
    SELECT group_id, CASE WHEN n >= 2 AND v + h > 0 AND abs(v - h) >= (v + h) * 0.2::DOUBLE THEN CASE WHEN v > h THEN 'vertical' ELSE 'horizontal' END ELSE 'automatic' END AS direction
    FROM (SELECT DISTINCT balloon_id AS group_id FROM fx_lines) LEFT JOIN tally ON g = group_id""",
    ("fx_lines",),
)
def _(v):
    parts = v.lines().select(
        F.col("balloon_id").alias("group_id"), F.col("line_id").alias("glyph_id"), "ord", "x", "y", "width", "height"
    )
    return grouping.vote_direction(parts)


@query(
    "vote_line_direction",
    """SELECT balloon_id, CASE WHEN balloon_id % 8 = 0 THEN 'vertical' WHEN v > h THEN 'vertical' WHEN h > v THEN 'horizontal' ELSE 'automatic' END AS direction
    FROM (SELECT balloon_id, count(*) FILTER (height >= width * 1.25::DOUBLE) AS v, count(*) FILTER (height < width * 1.25::DOUBLE AND width >= height * 1.25::DOUBLE) AS h FROM fx_lines GROUP BY balloon_id)""",
    ("fx_lines",),
)
def _(v):
    known = v.lines().select("balloon_id").distinct().withColumn(
        "direction", F.when(F.col("balloon_id") % 8 == 0, "vertical").otherwise("automatic")
    )
    return grouping.vote_line_direction(v.lines(), known)


@query(
    "mean_line_confidence",
    "SELECT balloon_id, round(avg(CASE WHEN confidence >= 0.2 THEN confidence END), 6) AS confidence FROM fx_lines GROUP BY balloon_id",
    ("fx_lines",),
)
def _(v):
    lines = v.lines().withColumn("confidence", F.when(F.col("confidence") >= 0.2, F.col("confidence")))
    return grouping.mean_line_confidence(lines).withColumn("confidence", F.round("confidence", 6))


@query(
    "median_size",
    "SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1] AS median FROM part GROUP BY p_brand",
)
def _(v):
    return grouping.upper_median(v.raw("part"), ["p_brand"], "p_size")


READING_SQL = """
stats AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy, count(*) FILTER (height > width * 1.35::DOUBLE) OVER w * 2 >= count(*) OVER w AS by_column,
   avg(height) OVER w AS mean_h FROM fx_boxes WINDOW w AS (PARTITION BY page_id)),
axes AS (SELECT *, CASE WHEN by_column THEN -cx ELSE cy END AS axis, CASE WHEN by_column THEN cy ELSE -cx END AS second,
   CASE WHEN by_column THEN 0.08 ELSE greatest(0.025, mean_h * 0.65) END AS tol FROM stats),
jumps AS (SELECT *, coalesce(axis - lag(axis) OVER w > tol, false) AS jump FROM axes WINDOW w AS (PARTITION BY page_id ORDER BY axis, second, ord, region_id)),
bands AS (SELECT *, sum(jump::INTEGER) OVER (PARTITION BY page_id ORDER BY axis, second, ord, region_id) AS band FROM jumps)
"""


@query(
    "reading_order",
    f"""WITH {READING_SQL} SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY band, second, ord, region_id) AS reading_rank FROM bands""",
    ("fx_boxes",),
)
def _(v):
    return reading.reading_order(v.boxes()).select("page_id", "region_id", "reading_rank")


@query(
    "layout_order",
    """WITH axes AS (SELECT *, max(height) OVER (PARTITION BY page_id) * 0.25 AS tol FROM fx_boxes),
    jumps AS (SELECT *, coalesce(y - lag(y) OVER w > tol, false) AS jump FROM axes WINDOW w AS (PARTITION BY page_id ORDER BY y, x, ord, region_id)),
    bands AS (SELECT *, sum(jump::INTEGER) OVER (PARTITION BY page_id ORDER BY y, x, ord, region_id) AS band FROM jumps)
    SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY band, x, ord, region_id) AS layout_rank FROM bands""",
    ("fx_boxes",),
)
def _(v):
    return reading.layout_order(v.boxes()).select("page_id", "region_id", "layout_rank")


@query(
    "assemble_lines",
    """WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' ELSE 'automatic' END AS direction, region_id AS line_id, ord, source_text AS text, x, y, width, height
      FROM fx_regions WHERE source_text <> ''),
    axes AS (SELECT *, CASE WHEN direction = 'vertical' THEN -(x + width / 2) ELSE y + height / 2 END AS axis, CASE WHEN direction = 'vertical' THEN y ELSE x END AS second FROM t),
    jumps AS (SELECT *, coalesce(axis - lag(axis) OVER w > 0.001, false) AS jump FROM axes WINDOW w AS (PARTITION BY page_id ORDER BY axis, second, ord, line_id)),
    bands AS (SELECT *, sum(jump::INTEGER) OVER (PARTITION BY page_id ORDER BY axis, second, ord, line_id) AS band FROM jumps)
    SELECT page_id AS region_id, direction, count(*) AS lines,
      string_agg(text, CASE WHEN direction = 'horizontal' THEN chr(10) ELSE '' END ORDER BY band, second, ord, line_id) AS text FROM bands GROUP BY page_id, direction""".replace(
        "string_agg(text, CASE WHEN direction = 'horizontal' THEN chr(10) ELSE '' END ORDER BY band, second, ord, line_id)",
        "CASE WHEN direction = 'horizontal' THEN string_agg(text, chr(10) ORDER BY band, second, ord, line_id) ELSE string_agg(text, '' ORDER BY band, second, ord, line_id) END",
    ),
    ("fx_regions",),
)
def _(v):
    lines = v.regions().select(
        F.col("page_id").alias("region_id"), F.col("region_id").alias("line_id"), "ord", F.col("source_text").alias("text"),
        "x", "y", "width", "height",
    )
    kind = F.col("page_id") % 3
    directions = v.pages().select(
        F.col("page_id").alias("region_id"),
        F.when(kind == 0, "vertical").when(kind == 1, "horizontal").otherwise("automatic").alias("direction"),
    )
    return reading.assemble_lines(lines, directions)


@query(
    "natural_order",
    r"""SELECT project_id, page_id, row_number() OVER (PARTITION BY project_id ORDER BY ch, p, k, page_id) AS path_rank FROM (
      SELECT *, regexp_extract(rel_path, 'ch(\d+)', 1)::BIGINT AS ch, regexp_extract(rel_path, '/p(\d+)', 1)::BIGINT AS p, regexp_extract(rel_path, '-(\d+)', 1)::BIGINT AS k FROM fx_pages)""",
    ("fx_pages",),
)
def _(v):
    return reading.natural_order(v.pages(), ["project_id"], "rel_path").select("project_id", "page_id", "path_rank")


@query(
    "renumber_pages",
    "SELECT project_id, page_id, row_number() OVER (PARTITION BY project_id ORDER BY title, page_id) AS page_index FROM fx_pages",
    ("fx_pages",),
)
def _(v):
    return reading.renumber_pages(v.pages(), [F.col("title"), F.col("page_id")]).select("project_id", "page_id", "page_index")


@query(
    "move_pages",
    """WITH RECURSIVE idx AS (SELECT project_id, page_id, row_number() OVER (PARTITION BY project_id ORDER BY page_id) AS pos, count(*) OVER (PARTITION BY project_id) AS n FROM fx_pages),
    mv AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS no, page_id, shift FROM (
       SELECT i.project_id, i.page_id, e.seq, e.shift FROM (SELECT project_id, page_id, pos FROM idx) i
       JOIN (SELECT user_id % 50 AS project_id, event_id AS seq, 1 + event_id % 40 AS pos, (value * 10)::BIGINT % 21 - 10 AS shift FROM (SELECT event_id, user_id, floor(value) AS value FROM events WHERE event_type = 'error')) e USING (project_id, pos))),
    steps(project_id, no, pages) AS (
      SELECT project_id, 0::BIGINT, list(page_id ORDER BY pos) FROM idx GROUP BY project_id
      UNION ALL
      SELECT s.project_id, s.no + 1, list_concat(list_concat(r[1:t - 1], [m.page_id]), r[t:])
      FROM (SELECT s.*, m.page_id, list_filter(s.pages, lambda p: p <> m.page_id) AS r,
              least(greatest(list_position(s.pages, m.page_id) + m.shift, 1), len(s.pages)) AS t FROM steps s JOIN mv m ON m.project_id = s.project_id AND m.no = s.no + 1) s, LATERAL (SELECT s.page_id) m
    ),
    finals AS (SELECT project_id, arg_max(pages, no) AS pages FROM steps GROUP BY project_id)
    SELECT project_id, unnest(pages) AS page_id, generate_subscripts(pages, 1) AS page_index FROM finals""",
    ("fx_pages",),
)
def _(v):
    pages = reading.renumber_pages(v.pages().select("project_id", "page_id"), [F.col("page_id")])
    events = v.raw("events").where(F.col("event_type") == "error")
    moves = events.select(
        (F.col("user_id") % 50).alias("project_id"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 40).alias("page_index"),
        (F.floor("value") * 10 % 21 - 10).alias("offset"), F.lit(None).cast("long").alias("position"),
    ).join(pages, ["project_id", "page_index"]).drop("page_index")
    return reading.move_pages(pages, moves).select("project_id", "page_id", "page_index")


@query(
    "merge_runs",
    """WITH r AS (SELECT *, x - row_number() OVER (PARTITION BY group_id, y ORDER BY x) AS island FROM fx_cells),
    runs AS (SELECT group_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM r GROUP BY group_id, y, island),
    s AS (SELECT *, y - row_number() OVER (PARTITION BY group_id, x0, x1 ORDER BY y) AS island FROM runs)
    SELECT group_id, x0, x1, min(y) AS y0, max(y) + 1 AS y1 FROM s GROUP BY group_id, x0, x1, island""",
    ("fx_cells",),
)
def _(v):
    return reading.merge_runs(v.cells())


@query(
    "ctc_decode",
    """WITH m AS (SELECT *, max(score) OVER (PARTITION BY line_id, t) AS top FROM fx_scores WHERE class < 7),
    best AS (SELECT line_id, t, arg_min(class, (-score, class)) AS best, max(score) AS top, sum(score) AS total, bool_and(score BETWEEN -0.0001 AND 1.0001) AS unit, sum(exp(score - top)) AS z FROM m GROUP BY ALL),
    steps AS (SELECT line_id, t, best, least(greatest(CASE WHEN unit AND abs(total - 1) < 0.02 THEN top ELSE 1 / z END, 0), 1) AS p, lag(best) OVER (PARTITION BY line_id ORDER BY t) AS before FROM best),
    kept AS (SELECT * FROM steps WHERE best <> 0 AND best IS DISTINCT FROM before AND best <> 6)
    SELECT l.line_id, coalesce(string_agg(chr((96 + best)::INTEGER), '' ORDER BY t), '') AS text, round(avg(p), 6) AS confidence
    FROM (SELECT DISTINCT line_id FROM fx_scores) l LEFT JOIN kept k ON k.line_id = l.line_id GROUP BY l.line_id""",
    ("fx_scores",),
)
def _(v):
    letters = [(0, "blank"), *[(i, chr(96 + i)) for i in range(1, 6)], (6, "blank")]  # the model knows an eighth class
    charset = v.spark.createDataFrame(letters, "class int, letter string")
    return reading.ctc_decode(v.scores(), charset).withColumn("confidence", F.round("confidence", 6))


@query(
    "top_k_regions",
    """SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC, region_id)::INTEGER AS rank FROM fx_boxes QUALIFY rank <= 3""",
    ("fx_boxes",),
)
def _(v):
    return reading.top_k_per_group(
        v.boxes(), ["page_id"], [(F.col("width") * F.col("height")).desc(), F.col("region_id")], 3
    ).select("page_id", "region_id", "rank")


@query(
    "strongest_lines",
    """WITH kept AS (SELECT * FROM fx_lines QUALIFY row_number() OVER (PARTITION BY balloon_id ORDER BY confidence DESC, line_id) <= 4)
    SELECT balloon_id, line_id, row_number() OVER (PARTITION BY balloon_id ORDER BY y, x DESC, line_id) AS position FROM kept""",
    ("fx_lines",),
)
def _(v):
    return reading.strongest_lines(v.lines(), 4).select("balloon_id", "line_id", "position")


@query(
    "order_regions",
    "SELECT page_id, ord, region_id FROM fx_boxes ORDER BY page_id, ord, region_id",
    ("fx_boxes",),
)
def _(v):
    return reading.order_regions(v.boxes().select("page_id", "ord", "region_id"))


@query(
    "unique_names",
    """WITH n AS (SELECT 'd' || (o_custkey % 40) AS dir, o_orderkey AS arrival, 'p' || (o_orderkey % 11) || '.png' AS name FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY arrival) AS k FROM n)
    SELECT dir, arrival, name, CASE WHEN k = 1 THEN name ELSE replace(name, '.png', '-' || k || '.png') END AS final FROM k""",
)
def _(v):
    files = v.raw("orders").select(
        F.concat(F.lit("d"), F.col("o_custkey") % 40).alias("dir"), F.col("o_orderkey").alias("arrival"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 11, F.lit(".png")).alias("name"),
    )
    return reading.unique_names(files)


@query(
    "otsu_threshold",
    """WITH v AS (SELECT l_returnflag AS flag, least(255, floor(l_extendedprice / 400))::BIGINT AS bin FROM lineitem),
    h AS (SELECT flag, bin, count(*) AS c FROM v GROUP BY ALL),
    s AS (SELECT *, sum(c) OVER g AS n, sum(bin * c) OVER g AS al, sum(c) OVER u AS wb, sum(bin * c) OVER u AS sb FROM h WINDOW g AS (PARTITION BY flag), u AS (PARTITION BY flag ORDER BY bin)),
    q AS (SELECT flag, bin, (wb * (n - wb))::DOUBLE * power(sb::DOUBLE / wb - (al - sb)::DOUBLE / (n - wb), 2) AS var FROM s WHERE n > wb),
    t AS (SELECT flag, coalesce(arg_max(bin, (var, -bin)), 128)::BIGINT AS threshold FROM q GROUP BY flag)
    SELECT flag, threshold, least(greatest(threshold, 60), 200) AS glyph_threshold, least(192, greatest(48, threshold + 6)) AS ink_threshold FROM t""",
)
def _(v):
    values = v.raw("lineitem").select(
        F.col("l_returnflag").alias("flag"), F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 400)).alias("bin")
    )
    return statistics.otsu_threshold(values, ["flag"])


@query(
    "dominant_colour",
    """WITH s AS (SELECT l_suppkey AS group_id, l_partkey * 7 % 256 AS r, l_partkey * 11 % 256 AS g, l_quantity::BIGINT * 5 % 256 AS b FROM lineitem),
    bins AS (SELECT group_id, least(15, (299 * r + 587 * g + 114 * b) // 1000 * 16 // 256) AS bin, count(*) AS c, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM s GROUP BY ALL),
    best AS (SELECT * FROM bins QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY c DESC, bin DESC) = 1),
    mean AS (SELECT group_id, bin, (r // c)::BIGINT AS r, (g // c)::BIGINT AS g, (b // c)::BIGINT AS b FROM best),
    paper AS (SELECT *, bin = 15 AND (299 * r + 587 * g + 114 * b) // 1000 >= 244 AND greatest(r, g, b) - least(r, g, b) <= 12 AS p FROM mean)
    SELECT s_suppkey AS group_id, CASE WHEN p OR r IS NULL THEN 255 ELSE r END AS red, CASE WHEN p OR r IS NULL THEN 255 ELSE g END AS green,
      CASE WHEN p OR r IS NULL THEN 255 ELSE b END AS blue FROM supplier LEFT JOIN paper ON group_id = s_suppkey""",
)
def _(v):
    part = F.col("l_partkey")
    samples = v.raw("lineitem").select(
        F.col("l_suppkey").alias("group_id"), (part * 7 % 256).alias("red"), (part * 11 % 256).alias("green"),
        (F.col("l_quantity").cast("long") * 5 % 256).alias("blue"),
    )
    return statistics.dominant_colour(samples, v.raw("supplier").select(F.col("s_suppkey").alias("group_id")))


@query(
    "mask_coverage",
    """WITH c AS (SELECT page_id AS region_id, component_id, min_x AS x0, min_y AS y0, min_x + w AS x1, min_y + h AS y1, area, CASE WHEN suppkey % 3 = 0 THEN (partkey % 10)::DOUBLE / 10 END AS shape_share FROM fx_components),
    r AS (SELECT *, (((x1 - x0)::DOUBLE / 1100 >= 0.72 OR (y1 - y0)::DOUBLE / 1100 >= 0.72) AND area::DOUBLE / greatest((x1 - x0) * (y1 - y0), 1) < 0.45) AS structural,
        coalesce(shape_share >= 0.6, true) AS inside, x0 <= 2 OR y0 <= 2 OR x1 >= 1098 OR y1 >= 1098 AS touch FROM c WHERE area >= greatest(2, floor(1210000 * 0.00006::DOUBLE))),
    k AS (SELECT *, NOT structural AND inside AS content FROM r),
    kept AS (SELECT region_id, count(*) AS kept, sum(area)::BIGINT AS covered, bool_or(touch) AS touches_border FROM (SELECT * FROM k WHERE content AND NOT touch QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY area DESC, component_id) <= 256) GROUP BY region_id),
    ign AS (SELECT region_id, sum(CASE WHEN structural OR (content AND touch) THEN area ELSE 0 END)::BIGINT AS ignored FROM k GROUP BY region_id)
    SELECT region_id, kept, covered, touches_border, round(least(1.0, covered::DOUBLE / greatest(60000 - ignored, 1)), 6) AS coverage_ratio,
      least(1.0, covered::DOUBLE / greatest(60000 - ignored, 1)) >= 0.9 AND NOT touches_border AS coverage_complete FROM kept JOIN ign USING (region_id)""",
    ("fx_components",),
)
def _(v):
    components = v.components().select(
        F.col("page_id").alias("region_id"), "component_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"),
        (F.col("min_x") + F.col("w")).alias("x1"), (F.col("min_y") + F.col("h")).alias("y1"), "area",
        F.when(F.col("suppkey") % 3 == 0, (F.col("partkey") % 10).cast("double") / 10).alias("shape_share"),
    )
    zero = F.lit(0).cast("long")
    searches = v.pages().select(
        F.col("page_id").alias("region_id"), zero.alias("x0"), zero.alias("y0"), F.lit(1100).cast("long").alias("x1"),
        F.lit(1100).cast("long").alias("y1"), F.lit(60000).cast("long").alias("foreground"),
    )
    return statistics.mask_coverage(components, searches, reject_border=True).withColumn(
        "coverage_ratio", F.round("coverage_ratio", 6)
    )


@query(
    "decode_detections",
    """WITH raw AS (SELECT page_id, region_id AS det_id, (x + width / 2) * 640 AS cx, (y + height / 2) * 640 AS cy, width * 640 AS w, height * 640 AS h, confidence AS score FROM fx_boxes),
    e AS (SELECT page_id, det_id, score, ((cx - w / 2) - 16) / 0.5 / pixel_width AS l, ((cy - h / 2) - 8) / 0.5 / pixel_height AS t, ((cx + w / 2) - 16) / 0.5 / pixel_width AS r, ((cy + h / 2) - 8) / 0.5 / pixel_height AS b
       FROM raw JOIN fx_pages USING (page_id) WHERE score >= 0.25 AND w > 0 AND h > 0),
    c AS (SELECT page_id, det_id, score AS confidence, least(greatest(l, 0), 1) AS l, least(greatest(t, 0), 1) AS t, least(greatest(r, least(greatest(l, 0), 1)), 1) AS r, least(greatest(b, least(greatest(t, 0), 1)), 1) AS b FROM e)
    SELECT page_id, det_id, confidence, round(l, 6) AS x, round(t, 6) AS y, round(r - l, 6) AS width, round(b - t, 6) AS height FROM c WHERE r > l AND b > t""",
    ("fx_pages", "fx_boxes"),
)
def _(v):
    raw = v.boxes().select(
        "page_id", F.col("region_id").alias("det_id"), ((F.col("x") + F.col("width") / 2) * 640).alias("cx"),
        ((F.col("y") + F.col("height") / 2) * 640).alias("cy"), (F.col("width") * 640).alias("w"), (F.col("height") * 640).alias("h"),
        F.col("confidence").alias("score"), F.lit(16.0).alias("pad_x"), F.lit(8.0).alias("pad_y"), F.lit(0.5).alias("scale"),
    )
    out = detection.decode_detections(raw, v.pages())
    return out.select("page_id", "det_id", "confidence", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


def grounding(v):
    box = F.array(*[(F.col(c) * 1000).alias(c) for c in ("x", "y")], (F.col("x") + F.col("width")) * 1000, (F.col("y") + F.col("height")) * 1000)
    zero = F.lit(0.0)
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    return v.boxes().select(
        F.col("page_id").alias("response_id"), F.col("region_id").alias("box_no"), box.alias("box"),
        rect(F.lit(100.0), F.lit(50.0), F.lit(800.0), F.lit(1000.0)).alias("crop"),
        F.lit(1000).alias("image_width"), F.lit(1400).alias("image_height"),
        F.when(F.col("page_id") % 2 == 0, rect(zero + 0.103, zero + 0.0507, zero + 0.6013, zero + 0.5031)).alias("clip"),
    )


GROUNDED_SQL = """WITH p AS (SELECT page_id AS response_id, region_id AS box_no, page_id % 2 = 0 AS clipped, x * 1000 BETWEEN 0 AND 1000 AND (x + width) * 1000 BETWEEN 0 AND 1000 AND (y + height) * 1000 BETWEEN 0 AND 1000 AS shaped,
        round_even(x * 1000 / 1000 * 800, 0) AS l, round_even(y * 1000 / 1000 * 1000, 0) AS t, round_even((x + width) * 1000 / 1000 * 800, 0) AS r, round_even((y + height) * 1000 / 1000 * 1000, 0) AS b FROM fx_boxes),
    raw AS (SELECT *, (100 + l) / 1000 AS x, (50 + t) / 1400 AS y, (r - l) / 1000 AS w, (b - t) / 1400 AS h FROM p),
    pad AS (SELECT *, greatest(x - w * 0.08, 0.0) AS pl, greatest(y - h * 0.08, 0.0) AS pt, least(x + w * 1.08, 1.0) AS pr, least(y + h * 1.08, 1.0) AS pb,
        greatest(least(x + w, 0.7043) - greatest(x, 0.103), 0.0) * greatest(least(y + h, 0.5538) - greatest(y, 0.0507), 0.0) AS shared FROM raw),
    fin AS (SELECT *, CASE WHEN clipped THEN greatest(pl, 0.103) ELSE pl END AS fl, CASE WHEN clipped THEN greatest(pt, 0.0507) ELSE pt END AS ft,
        CASE WHEN clipped THEN least(pr, 0.7043) ELSE pr END AS fr, CASE WHEN clipped THEN least(pb, 0.5538) ELSE pb END AS fb,
        shaped AND r > l AND b > t AND (NOT clipped OR shared / (w * h) >= 0.7) AS ok FROM pad),
    good AS (SELECT * FROM fin WHERE response_id IN (SELECT response_id FROM fin GROUP BY response_id HAVING bool_and(ok) AND count(*) <= 16))"""


@query(
    "map_grounding_boxes",
    GROUNDED_SQL + " SELECT response_id, box_no, round(fl, 6) AS x, round(ft, 6) AS y, round(fr - fl, 6) AS width, round(fb - ft, 6) AS height FROM good",
    ("fx_boxes",),
)
def _(v):
    out = detection.map_grounding_boxes(grounding(v))
    return out.select("response_id", "box_no", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    "union_grounding",
    GROUNDED_SQL + " SELECT response_id, round(min(fl), 6) AS x, round(min(ft), 6) AS y, round(max(fr) - min(fl), 6) AS width, round(max(fb) - min(ft), 6) AS height FROM good GROUP BY response_id",
    ("fx_boxes",),
)
def _(v):
    out = detection.union_grounding(detection.map_grounding_boxes(grounding(v)))
    return out.select("response_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    "read_grounding_boxes",
    """SELECT page_id AS response_id, (row_number() OVER (PARTITION BY page_id ORDER BY ord, region_id) - 1)::INTEGER AS box_no,
      CASE WHEN partkey % 6 < 5 THEN round(x * 100)::BIGINT || ',' || round(y * 100)::BIGINT || ',' || round((x + width) * 100)::BIGINT || ',' || round((y + height) * 100)::BIGINT END AS box
    FROM fx_boxes""",
    ("fx_boxes",),
)
def _(v):
    # the forms that models use in turn; the sixth has too few numbers
    whole = lambda c: F.round(c * 100).cast("long").cast("string")
    four = [whole(F.col("x")), whole(F.col("y")), whole(F.col("x") + F.col("width")), whole(F.col("y") + F.col("height"))]
    numbers = F.concat(F.lit("["), F.concat_ws(",", *four), F.lit("]"))
    form = F.col("partkey") % 6
    item = F.when(form == 0, numbers)
    for n, key in enumerate(("bbox_2d", "bbox", "box", "text_box"), 1):
        item = item.when(form == n, F.concat(F.lit('{"box_2d":[1],"' + key + '":'), numbers, F.lit("}")))
    item = item.otherwise(F.lit('{"box":[1,2,3]}'))
    replies = v.boxes().groupBy(F.col("page_id").alias("response_id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "region_id", item.alias("item")))).alias("items")
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]"))
    found = detection.read_grounding_boxes(replies.select("response_id", text.alias("json")))
    listed = F.array_join(F.transform("box", lambda x: x.cast("long").cast("string")), ",")
    return found.select("response_id", "box_no", listed.alias("box"))


@query(
    "unclip_components",
    """WITH g AS (SELECT *, min_x AS x0, min_y AS y0, min_x + w - 1 AS x1, min_y + h - 1 AS y1, w * h * 1.4::DOUBLE / greatest(1, 2 * (w + h)) AS e FROM fx_components),
    s AS (SELECT component_id, (greatest(0, x0 - e) - 10) / 900 AS l, (greatest(0, y0 - e) - 20) / 950 AS t,
      (least(960, x1 + 1 + e) - 10) / 900 AS r, (least(960, y1 + 1 + e) - 20) / 950 AS b FROM g),
    boxes AS (SELECT component_id, l AS x, t AS y, r - l AS width, b - t AS height FROM s),
    held AS (SELECT component_id, least(greatest(x, 0), 1) AS x, least(greatest(y, 0), 1) AS y, least(x + width, 1) AS r, least(y + height, 1) AS b FROM boxes)
    SELECT component_id, x, y, greatest(r, x) - x AS width, greatest(b, y) - y AS height FROM held WHERE r > x AND b > y""",
    ("fx_components",),
)
def _(v):
    components = v.components().select(
        "component_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), (F.col("min_x") + F.col("w") - 1).alias("x1"),
        (F.col("min_y") + F.col("h") - 1).alias("y1"), F.lit(0.9).alias("confidence"), F.lit(960).alias("model_width"),
        F.lit(960).alias("model_height"), F.lit(10.0).alias("pad_x"), F.lit(20.0).alias("pad_y"),
        F.lit(900.0).alias("scaled_width"), F.lit(950.0).alias("scaled_height"),
    )
    return detection.unclip_components(components).select("component_id", "x", "y", "width", "height")


@query(
    "filter_enclosures",
    """SELECT component_id FROM fx_components WHERE area::DOUBLE / 960000 >= 0.002 AND (w * h)::DOUBLE / 960000 BETWEEN 0.004 AND 0.2 AND area::DOUBLE / (w * h) >= 0.45
      AND w::DOUBLE / 800 >= 0.04 AND h::DOUBLE / 1200 >= 0.02 AND NOT ((w * h)::DOUBLE / 960000 >= 0.04 AND suppkey % 4 <> 0)""",
    ("fx_components",),
)
def _(v):
    side = F.when(F.col("suppkey") % 4 != 0, F.lit(0.8)).otherwise(F.lit(0.5))
    components = v.components().select(
        "component_id", "w", "h", "area", F.lit(800).alias("page_width"), F.lit(1200).alias("page_height"),
        F.lit(0.9).alias("top"), F.lit(0.9).alias("bottom"), side.alias("left"), F.lit(0.9).alias("right"),
    )
    return detection.filter_enclosures(components).select("component_id")


@query(
    "filter_glyphs",
    """SELECT component_id FROM (SELECT *, w // 6 AS gw, h // 6 AS gh FROM fx_components)
    WHERE greatest(gw, gh) BETWEEN 4 AND 44 AND area // 36 <= 44 * 44 AND least(gw, gh) * 8 >= greatest(gw, gh)
      AND (area // 36)::DOUBLE / greatest(gw * gh, 1) >= 0.12 AND 180 + partkey % 60 >= 205""",
    ("fx_components",),
)
def _(v):
    components = v.components().select(
        "component_id", F.floor(F.col("w") / 6).alias("w"), F.floor(F.col("h") / 6).alias("h"), F.floor(F.col("area") / 36).alias("area"),
        F.lit(800).alias("page_width"), F.lit(1200).alias("page_height"), (180 + F.col("partkey") % 60).alias("surround"),
    )
    return detection.filter_glyphs(components).select("component_id")


@query(
    "scan_tiles",
    """WITH t AS (SELECT r, c, greatest(c / 3.0::DOUBLE - 0.1 / 3, 0.0) AS x, greatest(r / 3.0::DOUBLE - 0.1 / 3, 0.0) AS y,
        least(c / 3.0::DOUBLE - 0.1 / 3 + 1.2 / 3, 1.0) AS x2, least(r / 3.0::DOUBLE - 0.1 / 3 + 1.2 / 3, 1.0) AS y2 FROM (VALUES (0), (1), (2)) a(r), (VALUES (0), (1), (2)) b(c))
    SELECT page_id, (r * 3 + c)::INTEGER AS tile, round(x, 6) AS x, round(y, 6) AS y, round(x2 - x, 6) AS width, round(y2 - y, 6) AS height FROM fx_pages, t""",
    ("fx_pages",),
)
def _(v):
    out = detection.scan_tiles(v.pages())
    return out.select("page_id", "tile", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    "layout_plan",
    """WITH r AS (SELECT t.*, pixel_width AS pw, pixel_height AS ph, suppkey % 3 = 0 AS framed,
        CASE WHEN partkey % 6 = 0 THEN 'こんにちは' WHEN partkey % 6 = 1 THEN '안녕' WHEN partkey % 6 = 2 THEN '' ELSE translated_text END AS tr,
        CASE WHEN suppkey % 5 = 0 THEN 'horizontal' ELSE 'automatic' END AS det FROM fx_regions t JOIN fx_pages USING (page_id)),
    b AS (SELECT *, CASE WHEN framed THEN greatest(x - 0.01, 0) ELSE x END AS lx, CASE WHEN framed THEN least(x + width + 0.01, 1) - greatest(x - 0.01, 0) ELSE width END AS lw FROM r)
    SELECT page_id, region_id, round(lx, 6) AS layout_x, round(lx + lw / 2, 6) AS anchor_x,
      CASE WHEN tr = '안녕' THEN 'horizontal' WHEN tr ~ '.*[A-Za-z].*' THEN 'horizontal' WHEN det <> 'automatic' THEN det
           WHEN tr = 'こんにちは' AND height > width * 0.8 THEN 'vertical' ELSE 'horizontal' END AS direction,
      round(least(greatest(sqrt(greatest(1, lw * pw * height * ph) / greatest(1, length(replace(source_text, ' ', '')))) * 1.08, 9), 40), 6) AS font_size
    FROM b""",
    ("fx_pages", "fx_regions"),
)
def _(v):
    part, supp = F.col("partkey") % 6, F.col("suppkey")
    left = F.greatest(F.col("x") - 0.01, F.lit(0.0))
    bubble = F.struct(
        left.alias("x"), F.col("y"), (F.least(F.col("x") + F.col("width") + 0.01, F.lit(1.0)) - left).alias("width"), F.col("height")
    )
    regions = v.regions().withColumns(
        {
            "translated_text": F.when(part == 0, "こんにちは").when(part == 1, "안녕").when(part == 2, "").otherwise(F.col("translated_text")),
            "detected_direction": F.when(supp % 5 == 0, "horizontal").otherwise("automatic"),
            "bubble_bounds": F.when(supp % 3 == 0, bubble),
        }
    )
    out = detection.layout_plan(regions, v.pages())
    return out.select(
        "page_id", "region_id", F.round("layout.x", 6).alias("layout_x"), F.round("anchor.x", 6).alias("anchor_x"), "direction",
        F.round("font_size", 6).alias("font_size"),
    )
