"""Replies with faults, prompts of large pages, and options of page translation."""

import json

from pyspark.sql import functions as F

from inkloom.functions.text import cluster_length, visible_length
from inkloom.operators import edits, quality, responses

EXPECTED = "request_id string, region_id string"


def parsed(spark, *replies):
    rows = [(f"q{i}", text) for i, text in enumerate(replies)]
    wanted = spark.createDataFrame([(f"q{i}", r) for i in range(len(replies)) for r in ("a", "b")], EXPECTED)
    found = responses.parse_responses(spark.createDataFrame(rows, "request_id string, text string"), wanted, usable=responses.USABLE)
    out = {}
    for r in found.collect():
        out.setdefault(r.request_id, {})[r.region_id] = r.displayTranslation
    return [out.get(f"q{i}", {}) for i in range(len(replies))]


def item(key, text, **more):
    return {"id": key, "displayTranslation": text, **more}


def test_a_badly_typed_field_voids_its_candidate(spark):
    good = json.dumps([item("a", "fine", confidence=0.5, qaFlags=[])])
    bad = [
        [item("a", "x", confidence="high"), item("b", "y")],
        [item("a", "x", qaFlags="none")],
        [item("a", "x", speakerID=7)],
        [item("a", 3)],
        [{"displayTranslation": "no id"}, item("b", "y")],
        ["text", item("b", "y")],
    ]
    replies = [f"first {json.dumps(b)} then {good}" for b in bad] + [json.dumps(bad[0]), f"{json.dumps(item('b', 'alone'))} is all"]
    assert parsed(spark, *replies) == [{"a": "fine"}] * len(bad) + [{"b": "y"}, {"b": "alone"}]


def test_integers_and_nulls_are_fine(spark):
    assert parsed(spark, json.dumps([item("a", "x", confidence=1, tone=None, qaFlags=None, other={"k": 1})])) == [{"a": "x"}]


def test_brackets_inside_strings_are_no_brackets(spark):
    texts = ['say [ok] {"id": 1', "a \\ b", 'quote " ] end', "]]][[["]
    replies = [f"note [1] {json.dumps([item('a', t)])} tail ]" for t in texts] + ['[{"id":"a","displayTranslation":"cut [', '"open quote [' + json.dumps([item("a", "x")])]
    assert parsed(spark, *replies) == [{"a": t} for t in texts] + [{}, {}]
    frame = spark.createDataFrame([("q", '[1] x {"k": [2]} [1] {"k": [2]} ] }')], "request_id string, answer string")
    found = [r.json for r in responses.json_candidates(frame).orderBy("candidate").collect()]
    assert found == ['[1] x {"k": [2]} [1] {"k": [2]} ] }', "[1]", "[2]", '{"k": [2]}']


def page(spark, n):
    rows = [(1, 1, f"r{i:03d}", i, f"text {i}", "", None, None, None, None, []) for i in range(n)]
    return spark.createDataFrame(rows, "project_id long, page_id long, region_id string, ord int, source_text string, translated_text string, literal_text string, speaker string, tone string, translation_confidence double, qa_flags array<string>")


def test_a_large_page_is_one_prompt(spark):
    regions = page(spark, 150)
    whole = responses.build_prompts(regions, None, "zh-Hans").collect()
    assert len(whole) == 1 and whole[0].regions == 150 and "only Simplified" in whole[0].prompt
    split = responses.build_prompts(regions, None, "en", size=64, style="be brief").orderBy("batch").collect()
    assert [r.regions for r in split] == [64, 64, 22] and all("be brief" in r.prompt for r in split)
    numbers = [i["index"] for r in split for i in json.loads(r.prompt.split("\nRegions:\n", 1)[1])]
    assert numbers == list(range(1, 151))
    single = responses.build_prompts(regions, None, "en", single=True).collect()
    assert sorted(json.loads(r.prompt.split("\nRegions:\n", 1)[1])[0]["index"] for r in single) == list(range(1, 151))


def echo():
    def answer(prompt):
        asked = json.loads(prompt.split("\nRegions:\n", 1)[1])
        order = prompt.split("Reading order: ", 1)[1].split(".", 1)[0]
        return json.dumps([{"id": r["id"], "displayTranslation": f"ab {order}", "literalTranslation": "lab", "tone": "b"} for r in asked])

    return answer


def test_translation_options(spark):
    mapping = spark.createDataFrame([("zh-hant", "a", "A"), ("zh-hant", "a", "B"), ("zh-hant", "b", "bb"), ("zh-hans", "b", "C")], "script string, from_char string, to_char string")
    row = responses.translate_pages(page(spark, 3), None, echo, "zh_Hant-TW", mapping=mapping, check=False).first()
    assert (row.translated_text, row.literal_text, row.tone) == ("Ab rightToLeft", "lAb", "b")
    row = responses.translate_pages(page(spark, 2), None, echo, "ja", mapping=mapping, page_context=False, preserve_literal=False, check=False).first()
    assert (row.translated_text, row.literal_text) == ("ab topToBottom", None)


def test_script_folding_has_no_row_limit(spark):
    letters = spark.range(0x4E00, 0x9000).select(F.lit("zh-hant").alias("script"), F.call_function("char", F.lit(97)).alias("to_char"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("from_char"))
    rows = spark.createDataFrame([("一龍", "zh-Hant"), ("一", "en"), (None, "zh-Hant")], "translated_text string, lang string")
    assert [r[0] for r in quality.normalize_script(rows, letters).collect()] == ["a龍", "一", None]


def test_lengths_count_what_a_reader_sees(spark):
    cases = [
        ("plain text", 10, 9), ("", 0, 0), (None, None, None), ("e\u0301a", 2, 2), ("a\r\nb", 3, 2), ("한\u1112\u1161\u11ab", 2, 2),
        ("\U0001f1eb\U0001f1f7!", 2, 2), ("\U0001f44d\U0001f3fd ok", 4, 3), ("龍の e\u0308", 4, 3), ("x" * 1_000_000 + "é", 1_000_001, 1_000_001),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", cluster_length(F.col("t")), visible_length(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (n, v) for i, (_, n, v) in enumerate(cases)}


def test_marks_do_not_make_a_translation_too_long(spark):
    marked = "e\u0301\u0323" * 5  # five letters, fifteen code points
    rows = [("p", "g", "r1", "abcde", marked, 0.9), ("p", "g", "r2", marked, "x" * 10, 0.9), ("p", "g", "r3", "abcde", "x" * 9, 0.9)]
    regions = spark.createDataFrame(rows, "project_id string, page_id string, region_id string, source_text string, translated_text string, translation_confidence double")
    flags = {r.region_id: r.qa_flags for r in quality.qa_check(regions, None, "en").collect()}
    assert flags == {"r1": [], "r2": ["excessiveLength"], "r3": []}
    assert spark.range(1).select(responses.character_budget(F.lit(marked * 4), "balanced")).first()[0] == 31


def test_log_lengths_are_parameters(spark):
    rows = spark.createDataFrame([("a", 1, 1, " " + "m" * 9000, "c" * 90), ("a", 2, 2, "short", " ")], "app string, ts int, entry_id int, message string, category string")
    cut = lambda **how: {r.entry_id: (len(r.message), len(r.category)) for r in edits.tail_log(rows, **how).collect()}
    assert cut() == {1: (8000, 80), 2: (5, 3)}
    assert cut(message_length=3, category_length=2) == {1: (3, 2), 2: (3, 3)}
