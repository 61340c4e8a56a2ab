"""The paths for hot groups give the same rows as the ordinary ones, and as plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom import scale
from inkloom.operators import dedupe, edits, glossary, grouping, reading, spatial
from inkloom.scale import number_rows, ordered_index, previous_values

LOW = 3


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def boxes(spark):
    """One crowded page, one with exact copies, and small ones."""
    rng = random.Random(7)
    rows = []
    for page, n in ((1, 160), (2, 40), (3, 3), (4, 1)):
        for i in range(n):
            w, h = rng.uniform(0.03, 0.25), rng.uniform(0.03, 0.25)
            x, y = rng.uniform(0, 0.8), rng.uniform(0, 0.8)
            if page == 2:
                x, y, w, h = 0.1 + 0.3 * (i % 3), 0.2, 0.2, 0.2
            rows.append((page, f"r{page}-{i:03d}", i % 50, x, y, w, h, round(rng.random(), 3), f"text {rng.randint(0, 20)}"))
    schema = "page_id long, region_id string, ord int, x double, y double, width double, height double, confidence double, source_text string"
    return spark.createDataFrame(rows, schema).cache()


def overlap(a, b):
    w = min(a.x + a.width, b.x + b.width, 1) - max(a.x, b.x, 0)
    h = min(a.y + a.height, b.y + b.height, 1) - max(a.y, b.y, 0)
    return max(w, 0) * max(h, 0)


def coverage(a, b):
    return overlap(a, b) / min(a.width * a.height, b.width * b.height)


def iou(a, b):
    s = overlap(a, b)
    return s / (a.width * a.height + b.width * b.height - s)


def by_page(df):
    pages = {}
    for r in df.collect():
        pages.setdefault(r.page_id, []).append(r)
    return pages


@pytest.mark.parametrize("limit", [LOW, 512])
def test_suppression_equals_loop(boxes, limit):
    expected = []
    for page, rows in by_page(boxes).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.confidence, r.region_id)):
            if all(iou(r, k) < 0.5 for k in kept):
                kept.append(r)
        expected += [(page, r.region_id) for r in kept[:36]]
    items = boxes.withColumnRenamed("region_id", "det_id")
    assert rows_of(spatial.suppress_boxes(items, limit=limit), "page_id", "det_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [LOW, 512])
def test_snapping_equals_loop(boxes, limit):
    detections = boxes.where("ord % 2 = 0").select(
        "page_id", F.concat(F.lit("d"), "region_id").alias("det_id"), "ord", (F.col("x") + 0.02).alias("x"), "y", "width", "height"
    )
    found = by_page(detections)
    expected = []
    for page, rows in by_page(boxes).items():
        pairs = [
            (-coverage(r, d), r.ord, r.region_id, d.ord, d.det_id)
            for r in rows for d in found.get(page, []) if coverage(r, d) >= 0.5
        ]
        left, right, chosen = set(), set(), {}
        for _, _, r, _, d in sorted(pairs):
            if r not in left and d not in right:
                left.add(r), right.add(d)
                chosen[r] = d
        expected += [(page, r.region_id, chosen.get(r.region_id)) for r in rows]
    out = spatial.snap_regions(boxes, detections, limit=limit)
    assert rows_of(out, "page_id", "region_id", "det_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [LOW, 512])
def test_pairs_are_found_once(boxes, limit):
    out = spatial.near_pairs(boxes, boxes, ["page_id"], limit=limit, extra=spatial.ordered_before)
    expected = []
    for page, rows in by_page(boxes).items():
        for a in rows:
            for b in rows:
                meets = a.x < b.x + b.width and b.x < a.x + a.width and a.y < b.y + b.height and b.y < a.y + a.height
                if (a.ord, a.region_id) < (b.ord, b.region_id) and meets:
                    expected.append((page, a.region_id, b.region_id))
    assert rows_of(out, "page_id", "a_region_id", "b_region_id") == sorted(expected, key=repr)


def test_reidentify_and_reject_agree(boxes):
    detected = boxes.where("ord % 3 <> 0").select("page_id", F.concat(F.lit("n"), "region_id").alias("region_id"), "ord", (F.col("x") + 0.01).alias("x"), "y", "width", "height")
    one = spatial.reidentify_regions(boxes, detected, limit=LOW)
    two = spatial.reidentify_regions(boxes, detected, limit=512)
    columns = ("page_id", "region_id", "detected_id", "source_text")
    assert rows_of(one, *columns) == rows_of(two, *columns)
    proposals = boxes.select("page_id", F.concat(F.lit("c"), F.col("ord") % 5).alias("call_id"), F.col("region_id").alias("proposal_id"), "ord", "x", "y", "width", "height", "source_text")
    existing = boxes.where("ord % 7 = 0").select("page_id", "x", "y", "width", "height")
    a = spatial.reject_duplicate_boxes(proposals, existing, limit=LOW)
    b = spatial.reject_duplicate_boxes(proposals, existing, limit=512)
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_truth_matching_agrees(boxes):
    truth = boxes.select("page_id", F.col("region_id").alias("truth_id"), "ord", F.col("x").alias("cx"), F.col("y").alias("cy"))
    seen = boxes.select("page_id", F.concat(F.lit("o"), "region_id").alias("obs_id"), "ord", (F.col("x") + 0.015).alias("cx"), F.col("y").alias("cy"), F.lit("t").alias("text"))
    a, b = spatial.match_truth(truth, seen, limit=LOW), spatial.match_truth(truth, seen, limit=512)
    assert rows_of(a, "truth_id", "obs_id") == rows_of(b, "truth_id", "obs_id")


@pytest.mark.parametrize("limit", [LOW, 512])
def test_nearest_neighbour_equals_loop(boxes, limit):
    glyphs = boxes.select(F.col("page_id").alias("group_id"), F.col("region_id").alias("glyph_id"), "ord", "x", "y", "width", "height")
    expected = []
    for page, rows in by_page(boxes).items():
        for a in rows:
            best = None
            for b in rows:
                if a.region_id == b.region_id:
                    continue
                dx = (b.x + b.width / 2) - (a.x + a.width / 2)
                dy = (b.y + b.height / 2) - (a.y + a.height / 2)
                best = min(best or (9.0,), (dx * dx + dy * dy, b.ord, b.region_id))
            expected.append((page, a.region_id, best[2] if best else None))
    out = spatial.nearest_neighbour(glyphs, limit=limit)
    assert rows_of(out, "group_id", "glyph_id", "neighbour") == sorted(expected, key=repr)


def test_text_blocks_agree(boxes):
    lines = boxes.select(F.col("page_id").alias("balloon_id"), F.col("region_id").alias("line_id"), "ord", "x", "y", (F.col("width") / 4).alias("width"), "height", "confidence")
    a, b = grouping.group_text_lines(lines, limit=LOW), grouping.group_text_lines(lines, limit=512)
    assert rows_of(a, "line_id", "group_label") == rows_of(b, "line_id", "group_label")


def test_glyph_clusters_agree(spark, boxes):
    px = lambda c: (F.col(c) * 400).cast("long")
    glyphs = boxes.select("page_id", F.col("region_id").alias("glyph_id"), "ord", px("x").alias("x0"), px("y").alias("y0"), (px("x") + px("width") / 4 + 1).cast("long").alias("x1"), (px("y") + px("height") / 4 + 1).cast("long").alias("y1"))
    pages = spark.createDataFrame([(p, 400, 400) for p in range(1, 5)], "page_id long, pixel_width int, pixel_height int")
    a, b = grouping.cluster_glyphs(glyphs, pages, limit=LOW), grouping.cluster_glyphs(glyphs, pages, limit=512)
    assert a.count() > 0
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_direction_votes_agree(boxes):
    glyphs = boxes.select(F.col("page_id").alias("group_id"), F.col("region_id").alias("glyph_id"), "ord", "x", "y", (F.col("width") / 8).alias("width"), (F.col("height") / 8).alias("height"))
    a, b = grouping.vote_direction(glyphs, limit=LOW), grouping.vote_direction(glyphs, limit=512)
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)
    merged = lambda n: grouping.merge_glyph_fragments(glyphs, limit=n).select("group_id", *[F.round(c, 9) for c in ("x", "y", "width", "height")])
    assert sorted(map(tuple, merged(LOW).collect())) == sorted(map(tuple, merged(512).collect()))


@pytest.mark.parametrize("direction", ["rightToLeft", "leftToRight", "topToBottom"])
def test_reading_order_agrees(boxes, direction):
    a = reading.reading_order(boxes, direction, limit=LOW)
    b = reading.reading_order(boxes, direction)
    assert rows_of(a, "page_id", "region_id", "reading_rank") == rows_of(b, "page_id", "region_id", "reading_rank")


def test_layout_order_agrees(boxes):
    a, b = reading.layout_order(boxes, limit=LOW), reading.layout_order(boxes)
    assert rows_of(a, "region_id", "layout_rank") == rows_of(b, "region_id", "layout_rank")


def test_region_merging_agrees(boxes):
    rows = boxes.withColumns({"framed": F.col("ord") % 2 == 0, "direction": F.lit("automatic")})
    rows = rows.withColumn("source_text", F.concat(F.lit("abcdefgh"), F.chr(F.lit(97) + F.col("ord") % 26), F.sha2("region_id", 256)))
    a, b = dedupe.dedupe_regions(rows, limit=LOW), dedupe.dedupe_regions(rows, limit=512)
    assert rows_of(a, "page_id", "region_id", "confidence") == rows_of(b, "page_id", "region_id", "confidence")


def test_numbering_agrees(boxes):
    order = [F.col("confidence"), F.col("region_id")]
    a = number_rows(boxes, ["page_id"], order, "n", limit=LOW)
    b = number_rows(boxes, ["page_id"], order, "n")
    assert rows_of(a, "region_id", "n") == rows_of(b, "region_id", "n")
    c = ordered_index(boxes, [], order, "n")
    assert sorted(r.n for r in c.collect()) == list(range(1, boxes.count() + 1))
    d = previous_values(boxes, ["page_id"], order, {"before": "region_id"}, limit=LOW)
    e = previous_values(boxes, ["page_id"], order, {"before": "region_id"})
    assert rows_of(d, "region_id", "before") == rows_of(e, "region_id", "before")


def test_history_in_parts_agrees(spark):
    rng = random.Random(3)
    rows = [(p, s, rng.choice(["edit", "edit", "undo", "redo"]), f"s{rng.randint(0, 5)}") for p in (1, 2) for s in range(200 if p == 1 else 5)]
    log = spark.createDataFrame(rows, "page_id long, seq long, action string, state string")
    a, b = edits.replay_edits(log, limit=16), edits.replay_edits(log, limit=10_000)
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_moves_in_batches_agree(spark):
    pages = spark.createDataFrame([(1, p, p) for p in range(1, 31)], "project_id long, page_id long, page_index long")
    rng = random.Random(5)
    rows = [(1, s, rng.randint(1, 30), rng.randint(-9, 9), rng.choice([None, 4, 99])) for s in range(40)]
    moves = spark.createDataFrame(rows, "project_id long, seq long, page_id long, offset long, position long")
    order = list(range(1, 31))
    for _, _, page, offset, position in rows:
        at = order.index(page)
        to = min(max(at + offset, 0), 29) if position is None else (position - 1 if position <= 30 else at)
        order.insert(to, order.pop(at))
    for limit in (6, 512):
        out = reading.move_pages(pages, moves, limit=limit).orderBy("page_index").collect()
        assert [r.page_id for r in out] == order


def test_glossary_without_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(1, p, f"r{p}", f"The Élan vital of p{p} and ab") for p in range(30)], "project_id long, page_id long, region_id string, source_text string")
    terms = spark.createDataFrame([(1, 1, "elan VITAL", "en", "x"), (1, 2, "ab", "en", "y"), (1, 3, "zzz", "en", "z")], "project_id long, entry_id long, source_term string, lang string, translation string")
    small = rows_of(glossary.resolve_glossary(texts, terms, "en-GB"), "page_id", "entry_id")
    monkeypatch.setattr(glossary, "DIRECT_TERMS", 0)
    assert rows_of(glossary.resolve_glossary(texts, terms, "en-GB"), "page_id", "entry_id") == small
    monkeypatch.setattr(glossary, "small_table", lambda df: None)
    assert rows_of(glossary.resolve_glossary(texts, terms, "en-GB"), "page_id", "entry_id") == small
    assert len(small) == 60


def test_results_do_not_depend_on_partitioning(boxes):
    shuffled = boxes.orderBy(F.sha2("region_id", 256)).repartition(13)
    for op in (
        lambda d: spatial.suppress_boxes(d.withColumnRenamed("region_id", "det_id")),
        lambda d: spatial.overlap_pairs(d),
        lambda d: reading.reading_order(d).select("region_id", "reading_rank"),
    ):
        a, b = op(boxes), op(shuffled)
        assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_large_top_k_equals_small_one(boxes, monkeypatch):
    from inkloom import scale

    order = [F.col("confidence").desc(), F.col("region_id")]
    plain = rows_of(scale.top_rows(boxes, ["page_id"], order, 30), "region_id", "_rank")
    monkeypatch.setattr(scale, "WINDOW_LIMIT_K", 1)
    assert rows_of(scale.top_rows(boxes, ["page_id"], order, 30), "region_id", "_rank") == plain


@pytest.mark.parametrize("case", ["page-size box", "points", "one spot"])
def test_grids_do_not_explode(spark, case):
    rng = random.Random(11)
    if case == "page-size box":
        rows = [(0, 0.0, 0.0, 0.9, 0.9)] + [(i, rng.random(), rng.random(), 0.004, 0.003) for i in range(1, 5000)]
    elif case == "points":
        rows = [(i, rng.random(), rng.random(), 0.0, 0.0) for i in range(5000)]
    else:
        rows = [(i, 0.4, 0.4, 0.01, 0.01) for i in range(2000)]
    boxes = spark.createDataFrame([(1, *r) for r in rows], "page_id long, region_id int, x double, y double, width double, height double")
    pad = F.lit(0.06 if case == "points" else 0.0)
    graded = spatial._graded(boxes, pad)
    grades = graded.select("page_id", "_grade").distinct().groupBy("page_id").agg(F.collect_set("_grade").alias("_grades"))
    cells = spatial._filed(graded).count() + spatial._looked_up(graded, grades, ["page_id"], True).count()
    assert cells < 20 * len(rows)
    if case == "page-size box":
        pairs = spatial.near_pairs(boxes, boxes, ["page_id"], limit=LOW, extra=lambda p: F.col("a_region_id") < F.col("b_region_id"))
        meets = lambda a, b: a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
        assert pairs.where("a_region_id = 0").count() == sum(meets(rows[0], r) and min(1, r[1] + r[3]) > r[1] and r[1] < 0.9 and r[2] < 0.9 for r in rows[1:])


def test_broadcasts_are_bounded_in_bytes(spark):
    """Few rows are no small table when one is long: it joins by shuffle, with the same rows."""
    short = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None), (3, "", [])], "id long, term string, places array<int>")
    assert sorted(map(str, scale.small_table(short).collect())) == sorted(map(str, short.collect()))
    assert scale.small_table(short, limit=2) is None
    assert scale.small_table(short.where("id > 9")).count() == 0
    wide = short.withColumn("term", F.when(F.col("id") == 2, F.repeat(F.lit("é"), F.lit(1025))).otherwise(F.col("term")))
    assert scale.small_table(wide) is None
    joined = short.join(scale.broadcast_if_small(wide.select("id", F.col("term").alias("long"))), "id")
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    assert joined.where("length(long) = 1025").count() == 1
    nested = short.withColumn("places", F.when(F.col("id") == 1, F.sequence(F.lit(1), F.lit(1000))))
    assert scale.small_table(nested) is None
    keys = spark.range(300).select(F.when(F.col("id") < 200, F.repeat(F.lit("k"), F.lit(5000))).otherwise(F.lit("b")).alias("key"), "id")
    hot = scale.hot_groups(keys, ["key"], 150)
    cold, rest = scale.split_hot(keys, ["key"], hot)
    assert (cold.count(), rest.count()) == (100, 200)
    assert scale.hot_groups(keys, ["key"], 250) is None
