"""Literal cases of the individual rules."""

import math

import pytest
from pyspark.sql import functions as F

from inkloom.functions.languages import normalize_tag, resolve_target
from inkloom.functions.text import fold, strip
from inkloom.operators import detection, edits, glossary, grouping, quality, reading, responses, spatial, statistics

BOX = "page_id long, region_id string, ord int, x double, y double, width double, height double, source_text string"


def values(spark, expression, *items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def regions(spark, *boxes):
    return spark.createDataFrame([(1, f"r{i}", i, *map(float, b), "said") for i, b in enumerate(boxes)], BOX)


def detections(spark, *boxes):
    rows = [(1, f"d{i}", i, *map(float, b)) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "page_id long, det_id string, ord int, x double, y double, width double, height double")


@pytest.mark.parametrize(
    "loose, tight",
    [
        ((0.12, 0.20, 0.60, 0.30), (0.22, 0.31, 0.35, 0.08)),  # the detection lies inside a loose box
        ((0.33, 0.71, 0.10, 0.06), (0.25, 0.66, 0.40, 0.19)),  # the box lies inside the detection
    ],
)
def test_loose_and_undersized_boxes_snap(spark, loose, tight):
    row = spatial.snap_regions(regions(spark, loose), detections(spark, tight)).first()
    assert row.det_id == "d0" and row.source_text == "said"
    assert (row.x, row.y, row.width, row.height) == tight


@pytest.mark.parametrize(
    "own, other", [((0.61, 0.08, 0.15, 0.11), (0.10, 0.52, 0.25, 0.30)), ((0.50, 0.10, 0.20, 0.20), (0.68, 0.27, 0.22, 0.25))]
)
def test_far_and_sliver_boxes_stay(spark, own, other):
    row = spatial.snap_regions(regions(spark, own), detections(spark, other)).first()
    assert row.det_id is None and (row.x, row.width) == (own[0], own[2])


def test_a_detection_is_claimed_once(spark):
    out = spatial.snap_regions(
        regions(spark, (0.20, 0.40, 0.30, 0.20), (0.35, 0.42, 0.30, 0.20)), detections(spark, (0.37, 0.45, 0.08, 0.09))
    )
    assert [r.det_id for r in out.orderBy("region_id").collect()].count("d0") == 1


@pytest.mark.parametrize(
    "a, b, groups",
    [
        ((0.62, 0.30, 0.03, 0.08), (0.565, 0.365, 0.03, 0.11), 2),  # one column begins near the other's foot
        ((0.55, 0.40, 0.03, 0.16), (0.515, 0.41, 0.03, 0.14), 1),  # two columns side by side
    ],
)
def test_touching_balloons_and_columns(spark, a, b, groups):
    rows = [(1, f"l{i}", i, *box, 0.9) for i, box in enumerate((a, b))]
    lines = spark.createDataFrame(
        rows, "balloon_id long, line_id string, ord int, x double, y double, width double, height double, confidence double"
    )
    assert grouping.group_text_lines(lines).select("group_label").distinct().count() == groups


def lattice(across, down, gap_x, gap_y):
    """Glyphs of 12 units in ``across`` columns and ``down`` rows with gaps between them."""
    return [(column * (12.0 + gap_x), row * (12.0 + gap_y), 12.0, 12.0) for column in range(across) for row in range(down)]


@pytest.mark.parametrize(
    "grid, direction",
    [
        (lattice(1, 6, 0, 3), "vertical"),
        (lattice(7, 1, 2, 0), "horizontal"),
        (lattice(3, 5, 14, 3), "vertical"),
        (lattice(6, 2, 3, 15), "horizontal"),
        (lattice(1, 1, 0, 0), "automatic"),
        # a column whose glyphs come in an upper and a lower piece and one whole glyph that sets the size
        ([(0.0, y * 18.0 + part * 7.0, 12.0, 6.0) for y in range(4) for part in (0, 1)] + [(0.0, 72.0, 12.0, 12.0)], "vertical"),
    ],
)
def test_direction_by_neighbours(spark, grid, direction):
    rows = [("g", f"k{i:02d}", i, *map(float, b)) for i, b in enumerate(grid)]
    glyphs = spark.createDataFrame(rows, "group_id string, glyph_id string, ord int, x double, y double, width double, height double")
    assert grouping.vote_direction(glyphs).first().direction == direction


def edited(spark, **patch):
    point = "struct<x:double,y:double>"
    rect = "struct<x:double,y:double,width:double,height:double>"
    base = spark.createDataFrame(
        [("r", "raw?", "old", 0.4, ["modelUncertain"], 0.1, 0.1, 0.2, 0.2, 12.0, {"x": 0.1, "y": 0.1, "width": 0.3, "height": 0.3}, [[{"x": 0.1, "y": 0.1}] * 3], True, True, 0.95, "#111111")],
        f"region_id string, source_text string, translated_text string, translation_confidence double, qa_flags array<string>, x double, y double, width double, height double, font_size double, bubble_bounds {rect}, mask_polygons array<array<{point}>>, mask_refined boolean, mask_complete boolean, mask_coverage double, text_color string",
    ).withColumns({"raw_source_text": F.lit(None).cast("string"), "text_confirmed": F.lit(False)})
    tri = lambda inner: f"struct<present:boolean,value:{inner}>"
    kinds = {"source_text": "string", "translated_text": "string", "bounds": rect, "bubble_bounds": tri(rect), "font_size": tri("double"), "keep_mask": "boolean", "text_color": "string"}
    columns = ", ".join(f"{k} {v}" for k, v in kinds.items())
    edit = spark.createDataFrame([("r", 1, *[patch.get(k) for k in kinds])], f"region_id string, seq long, {columns}")
    return edits.apply_region_edits(base, edit).first()


def test_source_edit_keeps_raw_text_and_voids_the_mask(spark):
    row = edited(spark, source_text="new")
    assert (row.raw_source_text, row.source_text, row.text_confirmed, row.translated_text) == ("raw?", "new", True, "")
    assert row.geometry_changed and row.mask_polygons == [] and row.mask_coverage is None and not row.mask_complete


def test_text_only_edit_may_keep_the_mask(spark):
    row = edited(spark, source_text="new", translated_text="neu", keep_mask=True)
    assert not row.geometry_changed and len(row.mask_polygons) == 1 and row.translated_text == "neu"
    assert row.translation_confidence is None and row.qa_flags == []


def test_clearing_a_bubble_voids_and_style_does_not(spark):
    row = edited(spark, bubble_bounds=(True, None))
    assert row.bubble_bounds is None and row.geometry_changed
    row = edited(spark, font_size=(True, 9000.0), text_color="#f0a")
    assert row.font_size == 512.0 and row.text_color == "#FF00AA" and not row.geometry_changed
    assert edited(spark, font_size=(True, None)).font_size is None


def test_box_edit_clamps(spark):
    row = edited(spark, bounds=(-0.5, 0.2, 2.0, 0.1))
    assert (row.x, row.width) == (0.0, 1.0) and row.geometry_changed


def test_language_tags(spark):
    assert values(spark, normalize_tag, "zh_hant", "EN-us", "ja", "x--y", "sr-latn-rs") == ["zh-Hant", "en-US", "ja", None, "sr-Latn-RS"]
    auto = lambda v: resolve_target(F.lit("auto"), v)
    cases = ("zh", "zh-TW", "zh-Hant-HK", "zh-CN", "zh-Hans", "ja", "pt-PT", "xx")
    assert values(spark, auto, *cases) == ["zh-Hant", "zh-Hant", "zh-Hant", "zh-Hans", "zh-Hans", "ja-JP", "pt-BR", "en-US"]


def test_trim_and_fold(spark):
    assert values(spark, strip, "　 a b \n") == ["a b"]
    assert values(spark, fold, "Élan", "ÀÇÑ", "カガ", "Ко́т") == ["elan", "acn", "カガ", "кот"]


def test_exact_language_wins_over_base(spark):
    rows = [
        (1, 1, "Sun", "zh-Hant", "日"), (1, 1, "Sun", "zh", "日b"), (1, 2, "Moon", "zh", "月"), (1, 3, "Star", "zh-Hans", "星"),
        (1, 4, "Sky", "zh-Hant", ""), (1, 4, "Sky", "zh", "天"),
    ]
    terms = glossary.terms_for_language(
        spark.createDataFrame(rows, "project_id long, entry_id long, source_term string, lang string, translation string"), "zh_Hant"
    )
    assert {r.entry_id: r.preferred_translation for r in terms.collect()} == {1: "日", 2: "月", 4: "天"}


@pytest.mark.parametrize(
    "reply, ids",
    [
        ('{"id":"a","translatedText":"x"}', ["a"]),
        ('<think>plan [1]</think>[{"id":"a","translatedText":"x"},{"id":"b","translatedText":"y"}]', ["a", "b"]),
        ('plan</think>```json\n[{"id":"b","translatedText":"]"}]\n```', ["b"]),
        ('<think>[{"id":"a","translatedText":"x"}]', []),
        ('[{"id":"a","translatedText":"x"},{"id":"b","tr', ["a"]),
        ('[{"id":"z","translatedText":"x"}] {"id":"a","translatedText":"q"}', ["a"]),
        ("no json at all", []),
    ],
)
def test_reply_salvage(spark, reply, ids):
    replies = spark.createDataFrame([(1, reply)], "request_id long, text string")
    expected = spark.createDataFrame([(1, "a"), (1, "b")], "request_id long, region_id string")
    out = responses.parse_responses(replies, expected, usable=responses.USABLE)
    assert sorted(r.region_id for r in out.collect()) == ids


def test_last_row_of_an_id_wins(spark):
    replies = spark.createDataFrame([(1, '[{"id":"a","translatedText":"x"},{"id":"a","translatedText":"y"}]')], "request_id long, text string")
    expected = spark.createDataFrame([(1, "a")], "request_id long, region_id string")
    assert responses.parse_responses(replies, expected).first().translatedText == "y"


def test_reply_health(spark):
    loop = "x" * 10 + "abc" * 120
    cut = '[{"id":"a"},{"id"'
    rows = [(1, '<think>a</think>[{"id":1}]'), (2, "<think>open"), (3, cut), (4, loop)]
    out = {r.request_id: r for r in responses.response_health(spark.createDataFrame(rows, "request_id long, text string")).collect()}
    assert [out[i].complete for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert out[1].reasoning == "a" and out[3].repaired == '[{"id":"a"}]' and out[4].looping and not out[1].looping


def test_partial_page_reply_causes_one_recovery(spark, tmp_path):
    calls = tmp_path / "calls"

    def model():
        import json

        def answer(prompt):
            with open(calls, "a") as log:
                log.write("x")
            asked = json.loads(prompt.split("\nRegions:\n", 1)[1])
            return json.dumps([{"id": asked[0]["id"], "displayTranslation": "t" + asked[0]["id"]}])

        return answer

    rows = [(1, 1, f"r{i}", i, "text", "") for i in range(3)]
    page = spark.createDataFrame(rows, "project_id long, page_id long, region_id string, ord int, source_text string, translated_text string")
    none = F.lit(None).cast("string")
    page = page.withColumns({"literal_text": none, "speaker": none, "tone": none, "translation_confidence": F.lit(None).cast("double"), "qa_flags": F.array().cast("array<string>")})
    out = {r.region_id: r for r in responses.translate_pages(page, None, model, "en").collect()}
    assert calls.read_text() == "xx"
    assert (out["r0"].translated_text, out["r1"].translated_text, out["r2"].translated_text) == ("tr0", "tr1", "")
    assert out["r2"].qa_flags == ["missingTranslation"]


def test_review_marks_changes(spark):
    def model():
        import json

        def answer(prompt):
            asked = json.loads(prompt.split("\nRegions:\n", 1)[1])
            suffix = "!" if prompt.startswith("Review") else ""
            return json.dumps([{"id": r["id"], "displayTranslation": "t" + (suffix if r["index"] == 1 else "")} for r in asked])

        return answer

    rows = [(1, 1, f"r{i}", i, "text", "") for i in range(2)]
    page = spark.createDataFrame(rows, "project_id long, page_id long, region_id string, ord int, source_text string, translated_text string")
    none = F.lit(None).cast("string")
    page = page.withColumns({"literal_text": none, "speaker": none, "tone": none, "translation_confidence": F.lit(None).cast("double"), "qa_flags": F.array().cast("array<string>")})
    out = {r.region_id: r for r in responses.translate_pages(page, None, model, "en", review=True).collect()}
    assert out["r0"].translated_text == "t!" and out["r0"].qa_flags == ["reviewAdjusted"] and out["r1"].qa_flags == []


def test_grounding_boxes(spark):
    rect = "struct<x:double,y:double,width:double,height:double>"
    rows = [
        (1, 0, [100.0, 200.0, 500.0, 400.0], (0.0, 0.0, 1000.0, 1000.0), 1000, 1000, None),
        (2, 0, [100.0, 200.0, 500.0, 400.0], (0.0, 0.0, 1000.0, 1000.0), 1000, 1000, (0.6, 0.6, 0.2, 0.2)),
        (3, 0, [1.0, 2.0, float("nan"), 4.0], (0.0, 0.0, 1000.0, 1000.0), 1000, 1000, None),
        (3, 1, [100.0, 200.0, 500.0, 400.0], (0.0, 0.0, 1000.0, 1000.0), 1000, 1000, None),
        (4, 0, [100.0, 200.0, 500.0], (0.0, 0.0, 1000.0, 1000.0), 1000, 1000, None),
    ]
    boxes = spark.createDataFrame(rows, f"response_id long, box_no int, box array<double>, crop {rect}, image_width int, image_height int, clip {rect}")
    out = detection.map_grounding_boxes(boxes).collect()
    assert [r.response_id for r in out] == [1]
    assert math.isclose(out[0].x, 0.1 - 0.4 * 0.08) and math.isclose(out[0].width, 0.4 * 1.16)


def test_columns_read_right_to_left(spark):
    rows = [("r", "a", 0, "左", 0.12, 0.1, 0.1, 0.5), ("r", "b", 1, "右", 0.4, 0.1, 0.1, 0.5), ("r", "c", 2, " ", 0.3, 0.1, 0.1, 0.5)]
    lines = spark.createDataFrame(rows, "region_id string, line_id string, ord int, text string, x double, y double, width double, height double")
    directions = spark.createDataFrame([("r", "vertical")], "region_id string, direction string")
    assert reading.assemble_lines(lines, directions).first().text == "右左"


def test_threshold_of_constant_values(spark):
    rows = [("a", 7)] * 4 + [("b", 10)] * 5 + [("b", 200)] * 5
    out = statistics.otsu_threshold(spark.createDataFrame(rows, "g string, bin int"), ["g"])
    assert {r.g: r.threshold for r in out.collect()} == {"a": 128, "b": 10}


def test_erase_colours(spark):
    assert values(spark, edits.erase_colour, "auto", "#fff", " #FFFFFF", "white") == ["AUTO", "#FFFFFF", "#FFFFFF", "AUTO"]


def test_accuracy_of_japanese_lines(spark):
    rows = [("p", "あれは…！", "あれは…!"), ("p", "行くぞ！", "行くぞ！")]
    out = quality.accuracy_report(spark.createDataFrame(rows, "page string, expected string, observed string"))
    total = out.where("overall = 1").first()
    assert (total.lines, total.exact_lines, total.edits, total.characters) == (2, 1, 1, 9)


def test_name_suffixes_skip_taken_names(spark):
    names = ["a.png", "a.png", "a-2.png", "a.png", "b"]
    files = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "dir string, name string, arrival long")
    out = [r.final for r in reading.unique_names(files).orderBy("arrival").collect()]
    assert out == ["a.png", "a-2.png", "a-2-2.png", "a-3.png", "b"]


def test_natural_path_order(spark):
    paths = ["p10.png", "P2.png", "p1.png", "a/p3.png", "p02.png"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    out = [r.path for r in reading.natural_order(files, [], "path").orderBy("path_rank").collect()]
    assert out == ["a/p3.png", "p1.png", "P2.png", "p02.png", "p10.png"]


def test_names_pass_long_runs_at_once(spark):
    rows = [("d", f"a-{n}.png", n) for n in range(2, 400)] + [("d", "a.png", 500 + i) for i in range(4)] + [("d", "a-401.png", 499), ("e", "a.png", 1)]
    out = reading.unique_names(spark.createDataFrame(rows, "dir string, name string, arrival long"))
    got = {(r.dir, r.arrival): r.final for r in out.collect()}
    assert [got[("d", 500 + i)] for i in range(4)] == ["a.png", "a-400.png", "a-402.png", "a-403.png"]
    assert got[("d", 7)] == "a-7.png" and got[("e", 1)] == "a.png"
