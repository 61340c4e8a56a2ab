"""Steps that are read several times are written once, and rows travel narrow."""

import re
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

import __spark_entry__  # noqa: F401  (registers the queries)
from inkloom.operators import detection, edits, glossary, grouping, identity, spatial, termscan
from inkloom.plans.catalog import QUERIES
from inkloom.plans.views import Views
from inkloom.session import written
from inkloom.sources import files

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_of_a_scan_starts_from_written_rows(spark):
    scan = spark.createDataFrame([(1, 1, "/s/a.png", "a.png", 8, 9), (1, 2, "/n/b.png", "b.png", 8, 9), (1, 3, "/n/P.png", "q.png", 8, 9)], "project_id long, scan_index long, path string, rel_path string, pixel_width int, pixel_height int")
    old = spark.createDataFrame([(1, 11, 3, "/s/a.png", "a.png", "a", 8, 9), (1, 12, 2, "/s/b.png", "b.png", "b", 8, 9), (1, 13, 1, "/s/P.png", "P.png", "P", 8, 9)], "project_id long, page_id long, prev_index long, path string, rel_path string, title string, pixel_width int, pixel_height int")
    out = identity.relink_scan(scan, old)
    assert out.columns == [*scan.columns, "page_id", "linked_by", "page_index"]
    assert {(r.scan_index, r.page_id, r.linked_by, r.page_index) for r in out.collect()} == {(1, 11, "path", 3), (2, 12, "relative", 2), (3, 13, "fingerprint", 1)}
    narrow = identity.relink_scan(scan, old, keep=[])
    assert narrow.columns == ["project_id", "scan_index", "page_id", "linked_by", "page_index"]
    assert "Join" not in plan(narrow)


def test_regions_join_their_part_as_stored(spark):
    below = plan(Views(spark, DATA).regions()).split("Join", 1)[1]
    assert not re.search(r"concat_ws|region_id", below)


def test_verdicts_of_odd_answers_and_written_rows_are_not_written_again(spark):
    cases = {  # page: (texts of its regions, answers)
        1: ({"a": ("s", "t")}, [("a", "s", None)]),  # same source keeps the translation
        2: ({"a": ("s", "t")}, [("a", "new", None)]),  # a new source clears it
        3: ({"a": ("s", "t")}, [("a", None, "x"), ("a", None, "y")]),
        4: ({"a": ("s", "t"), "b": ("s", "t")}, [("a", None, "x")]),
        5: ({"a": ("s", "t")}, [("a", None, "x"), ("c", None, "x")]),
        6: ({"a": (None, "t")}, [("a", None, "x")]),
        7: ({"a": ("s", None)}, [("a", " ", "x")]),
        8: ({"a": (None, "t")}, [("a", "n", None)]),
    }
    pages = spark.createDataFrame([(p, "r", True, True) for p in cases], "page_id long, revision string, has_mask boolean, has_background boolean")
    regions = spark.createDataFrame([(p, f"{p}{r}", s, t) for p, (own, _) in cases.items() for r, (s, t) in own.items()], "page_id long, region_id string, source_text string, translated_text string")
    results = spark.createDataFrame([(p, "r", f"{p}{r}", s, t, "", "", "", 0.5, []) for p, (_, sent) in cases.items() for r, s, t in sent], "page_id long, expected_revision string, region_id string, source_text string, translated_text string, literal_text string, speaker string, tone string, confidence double, flags array<string>")
    verdicts = {r.page_id: r.verdict for r in edits.submit_agent_results(pages, regions, results)[0].collect()}
    assert verdicts == {1: "accepted", 2: "blank text", 3: "id set differs", 4: "id set differs", 5: "id set differs", 6: "blank text", 7: "blank text", 8: "accepted"}
    rows = written(results)
    assert written(rows) is rows


AGENT_RESULTS = "page_id long, expected_revision string, region_id string, source_text string, translated_text string, literal_text string, speaker string, tone string, confidence double, flags array<string>"


def test_verdicts_write_nothing(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "r", True, True), (1, "q", True, True), (2, "r", True, False), (None, "r", True, True)], "page_id long, revision string, has_mask boolean, has_background boolean")
    regions = spark.createDataFrame([(1, "a", "s", "t"), (2, "b", "s", "t"), (4, None, "s", "t"), (None, "c", "s", "t")], "page_id long, region_id string, source_text string, translated_text string")
    results = spark.createDataFrame([(p, "r", r, None, "x", "", "", "", 0.5, []) for p, r in ((1, "a"), (2, "b"), (3, "a"), (3, "c"), (4, None), (None, "c"), (None, "d"))], AGENT_RESULTS)

    def none(*_, **__):
        raise AssertionError("written")

    monkeypatch.setattr(edits, "materialize", none)
    monkeypatch.setattr(edits, "written", none)
    found = sorted((r.page_id or 0, r.verdict) for r in edits.submit_agent_results(pages, regions, results)[0].collect())
    assert found == [(0, "unknown page"), (1, "accepted"), (1, "conflict"), (2, "mask data required"), (3, "unknown page"), (4, "unknown page")]


def test_results_meet_regions_in_one_shuffle(spark):
    pages = spark.createDataFrame([(p, "r", True, True) for p in (1, 2, 3)], "page_id long, revision string, has_mask boolean, has_background boolean")
    own = [(1, "a", "s", "t"), (1, "a", "s", "t"), (1, "b", "s", "t"), (1, "d", None, "t"), (2, "c", "s", "t"), (None, "a", "s", "t"), (3, "a", "s", "t")]
    regions = spark.createDataFrame(
        [(i, *r, None, False, 0.1, ["f"], "") for i, r in enumerate(own)],
        "x long, page_id long, region_id string, source_text string, translated_text string, raw_source_text string, text_confirmed boolean, translation_confidence double, qa_flags array<string>, extracted_source_text string",
    )
    sent = [(1, "a", "n", "u"), (1, "b", "s", None), (1, "d", "n", None), (2, "c", "n", None), (3, "a", None, "v"), (3, "z", None, "v")]
    results = spark.createDataFrame([(p, "r", r, s, t, " l ", "", "", 2.0, None) for p, r, s, t in sent], AGENT_RESULTS)
    verdicts, after = edits.submit_agent_results(pages, regions, results)
    assert {r.page_id: r.verdict for r in verdicts.collect()} == {1: "accepted", 2: "blank text", 3: "id set differs"}
    assert after.columns == regions.columns
    kept = lambda i: tuple(regions.where(f"x = {i}").first())[3:]
    want = {i: kept(i) for i in (4, 5, 6)}
    want |= {0: ("n", "u", "s", True, 1.0, [], "l"), 1: ("n", "u", "s", True, 1.0, [], "l"), 2: ("s", "t", "s", True, 1.0, [], "l"), 3: ("n", "t", None, True, 1.0, [], "l")}
    assert {r.x: tuple(r)[3:] for r in after.collect()} == want
    given = results.repartition(8, "page_id")  # dealt by page already, as after a join by page
    listed = pages.repartition(8, "page_id")
    text = edits.submit_agent_results(listed, regions, given)[1]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 4


def test_sides_of_a_component_are_computed_once(spark):
    text = plan(QUERIES["unclip_components"](spark, DATA))
    assert text.count("l_quantity") <= 6
    cases = [("a", 100, 100, 199, 149), ("b", 0, 0, 9, 9), ("c", 5, 950, 959, 959), ("d", 10, 10, 9, 40)]
    frame = spark.createDataFrame([(*c, 0.5, 960, 960, 10.0, 20.0, 900.0, 950.0) for c in cases], "component_id string, x0 int, y0 int, x1 int, y1 int, confidence double, model_width int, model_height int, pad_x double, pad_y double, scaled_width double, scaled_height double")
    found = {r.component_id: (r.x, r.y, r.width, r.height) for r in detection.unclip_components(frame).collect()}
    want = {}
    for key, x0, y0, x1, y1 in cases:
        w, h = x1 - x0 + 1.0, y1 - y0 + 1.0
        grow = w * h * 1.4 / max(1.0, 2 * (w + h))
        x, y = (max(0.0, x0 - grow) - 10) / 900, (max(0.0, y0 - grow) - 20) / 950
        r, b = (min(960.0, x1 + 1 + grow) - 10) / 900, (min(960.0, y1 + 1 + grow) - 20) / 950
        r, b, x, y = x + (r - x), y + (b - y), min(max(x, 0.0), 1.0), min(max(y, 0.0), 1.0)
        r, b = min(max(r, x), 1.0), min(max(b, y), 1.0)
        if r > x and b > y:
            want[key] = (x, y, r - x, b - y)
    assert found == want


def test_glyphs_are_gathered_once(spark):
    assert plan(QUERIES["cluster_glyphs"](spark, DATA)).count("collect_list") == 1


def test_versioned_sidecars_are_written_compressed(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "a.png", 8, 9)], "page_id long, project_id long, rel_path string, pixel_width int, pixel_height int")
    regions = spark.createDataFrame([(1, "r", 1, 0.1, 0.1, 0.2, 0.2, "s")], "page_id long, region_id string, ord int, x double, y double, width double, height double, source_text string")
    files.write_sidecars(files.sidecar_documents(pages, regions, "en"), str(tmp_path), 1)
    assert [p.suffixes[-2:] for p in tmp_path.rglob("part-*")] == [[".json", ".gz"]]
    [row] = files.sidecar_regions(files.read_sidecar_versions(spark, str(tmp_path))[0]).collect()
    assert (row.rel_path, row.region_id, row.source_text) == ("a.png", "r", "s")


def test_directions_are_voted_inside_the_gathered_groups(spark):
    text = plan(QUERIES["vote_direction"](spark, DATA))
    assert text.count("collect_list") == 1 and "Join" not in text
    glyphs = spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 0.0, 1.0), (2, "a", 1, 0.0, 0.0, 1.0, 1.0), (3, "a", 1, 0.0, 0.0, 1.0, 1.0), (3, "b", 2, 0.0, 3.0, 1.0, 1.0)], "group_id long, glyph_id string, ord int, x double, y double, width double, height double")
    told = {r.group_id: r.direction for r in grouping.vote_direction(glyphs).collect()}
    assert told == {1: "automatic", 2: "automatic", 3: "vertical"} == {r.group_id: r.direction for r in grouping.vote_direction(glyphs, limit=0).collect()}


def test_clusters_meet_enclosures_once_and_are_numbered_as_written(spark):
    assert len(re.findall("Join [A-Z]", plan(QUERIES["uncovered_clusters"](spark, DATA)))) == 1
    assert not re.search("Join [A-Z]", plan(QUERIES["union_candidates"](spark, DATA)))
    clusters = spark.createDataFrame([(1, "in", 1, 0.1, 0.1, 0.2, 0.2, 5), (1, "out", 2, 0.6, 0.6, 0.2, 0.2, 5), (None, "lost", 1, 0.1, 0.1, 0.2, 0.2, 5)], "page_id long, cluster_id string, ord int, x double, y double, width double, height double, glyph_count long")
    shapes = spark.createDataFrame([(1, "e", 1, 0.0, 0.0, 0.5, 0.5), (1, "f", 2, 0.0, 0.0, 0.4, 0.4)], "page_id long, enclosure_id string, ord int, x double, y double, width double, height double")
    for limit in (0, 512):
        assert {r.cluster_id for r in spatial.uncovered_clusters(clusters, shapes, limit=limit).collect()} == {"out", "lost"}


def test_only_lives_that_follow_another_are_chained(spark, monkeypatch):
    rows, kept = [], glossary.materialize
    for seq in range(300):
        rows.append((1, 7 if seq % 100 == 50 else seq % 5, "T", "zh", f"t{seq}", None, seq, "put"))
    rows += [(1, owner, None, None, None, None, seq, "remove") for owner, seq in ((0, 60), (1, 120), (2, 180))]
    changes = spark.createDataFrame([(*r[:6], r[6] * 2 + (r[7] == "remove"), r[7]) for r in rows], "project_id long, entry_id long, source_term string, lang string, translation string, note string, seq long, op string")
    chained = []

    def counted(df, **named):
        out = kept(df, **named)
        if "more" in out.columns:
            chained.append(out.count())
        return out

    monkeypatch.setattr(glossary, "materialize", counted)
    [row] = glossary.upsert_glossary(changes.drop("seq", "op").limit(0), changes).collect()
    assert chained and max(chained) <= 4
    assert row.translation == "t299"


def odd_sides(spark):
    """Rows without a page, ids that occur twice, pages of one side only, empty boxes and boxes without numbers."""
    box = "x double, y double, width double, height double"
    nan = float("nan")
    left = [
        (1, "a", 1, 0.1, 0.1, 0.2, 0.2, "one"), (1, "a", 2, 0.5, 0.5, 0.2, 0.2, "two"), (1, "c", 3, 0.1, 0.1, 0.2, 0.2, "three"),
        (1, "n", 4, nan, 0.1, 0.2, 0.2, None), (1, "e", 5, 0.1, 0.1, 0.0, 0.2, " "), (None, "a", 1, 0.1, 0.1, 0.2, 0.2, "lost"),
        (None, "a", 2, 0.1, 0.1, 0.2, 0.2, "lost"), (None, "z", 2, 0.1, 0.1, 0.2, 0.2, "lost"), (2, "b", 1, 0.1, 0.1, 0.2, 0.2, "alone"),
        *[(4, f"m{i}", i % 3, 0.1 + i / 50, 0.1, 0.2, 0.2, f"t{i}") for i in range(9)],
    ]
    right = [
        (1, "d", 1, 0.11, 0.1, 0.2, 0.2), (1, "d", 2, 0.12, 0.1, 0.2, 0.2), (1, "f", 3, 0.5, 0.5, 0.2, 0.2),
        (None, "d", 1, 0.1, 0.1, 0.2, 0.2), (3, "g", 1, 0.1, 0.1, 0.2, 0.2), *[(4, f"k{i}", i % 2, 0.12 + i / 40, 0.1, 0.2, 0.2) for i in range(7)],
    ]
    return (
        spark.createDataFrame(left, f"page_id long, region_id string, ord int, {box}, source_text string"),
        spark.createDataFrame(right, f"page_id long, det_id string, ord int, {box}"),
    )


def test_each_row_of_a_match_is_shuffled_once(spark):
    snapped = plan(QUERIES["snap_regions"](spark, DATA))
    assert "Join" not in snapped and "confidence" not in snapped.split("collect_list", 1)[1]
    assert "Join" not in plan(QUERIES["match_truth"](spark, DATA))
    left, right = odd_sides(spark)
    for limit in (1, 3, 512):
        out = spatial.snap_regions(left, right, limit=limit)
        assert out.columns == ["page_id", "region_id", "ord", "x", "y", "width", "height", "source_text", "det_id"]
        rows = out.collect()
        assert sorted([(r.region_id, r.ord, r.det_id, r.x) for r in rows if r.page_id == 1 and r.region_id == "a"]) == [
            ("a", 1, "f", 0.5), ("a", 2, "f", 0.5)
        ]
        assert {r.det_id for r in rows if r.page_id in (None, 2) or r.region_id in ("e", "n")} == {None}
        assert len(rows) == 19 and sum(r.page_id is None for r in rows) == 3


def test_edits_are_recalled_for_claimed_regions_only(spark):
    assert plan(QUERIES["reidentify_regions"](spark, DATA)).count("Join") == 1  # with the parts, after the match
    left, right = odd_sides(spark)
    detected = right.withColumnRenamed("det_id", "region_id")
    texts = left.select("page_id", "region_id", "ord", "source_text")
    whole = spatial.reidentify_regions(left, detected)
    recalled = spatial.reidentify_regions(left.drop("source_text"), detected, recall=lambda rows: rows.join(texts, ["page_id", "region_id", "ord"], "left"))
    assert recalled.columns == whole.columns
    found = sorted(map(str, recalled.collect()))
    assert found == sorted(map(str, whole.collect())) and len(found) == 14


def test_a_scan_for_terms_holds_one_block_of_texts(spark):
    schema = ["project_id", "region_id", "folded"]
    texts = [f"{i} " + "some words of a page " * 120 for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 1500), pa.array(range(1500)), pa.array([*texts[:-1], None])], schema)
    shared = SimpleNamespace(value=pa.table({"project_id": [1, 1], "folded_term": ["words of", "7 some"], "entry_id": [1, 2]}))
    tracemalloc.start()
    hits = [r for out in termscan.scan(shared, ["region_id"])(iter([batch])) for r in zip(*map(pa.Array.to_pylist, out.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(hits) == sorted([(i, 1) for i in range(1499)] + [(i, 2) for i in range(1499) if i % 10 == 7])
    assert peak < 30 << 20, peak
