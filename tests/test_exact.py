"""Ties and tolerances are decided by the given numbers, not by the last digit of a detour or by the order of rows."""

import json

from pyspark.sql import functions as F

from inkloom.operators import grouping, reading, responses, spatial


def test_a_term_of_several_entries_is_listed_once(spark):
    regions = spark.createDataFrame([(1, "a", 1, "of. it", "")], "page_id long, region_id string, ord int, source_text string, translated_text string")
    terms = spark.createDataFrame([(1, 7, "of.", "to of."), (1, 8, "of.", "to of."), (1, 9, "it", "to it")], "page_id long, entry_id long, source_term string, preferred_translation string")
    drafts = regions.select("region_id", F.lit("D").alias("draft"))
    for how in ({}, {"single": True}, {"drafts": drafts}):
        prompt = responses.build_prompts(regions, terms, "zh-Hant", **how).first().prompt
        listed = json.loads(prompt.split("\nTerms:\n", 1)[1].split("\nRegions:\n", 1)[0])
        assert [t["sourceTerm"] for t in listed] == ["it", "of."]


def test_equal_distances_go_to_the_first_observation(spark):
    truth = spark.createDataFrame([(1, "t", 1, 0.1, 0.1)], "page_id long, truth_id string, ord int, cx double, cy double")
    seen = spark.createDataFrame(
        [(1, "a", 1, 0.13, 0.095, "A"), (1, "b", 2, 0.07, 0.105, "B")], "page_id long, obs_id string, ord int, cx double, cy double, text string"
    )
    assert spatial.match_truth(truth, seen).first().obs_id == "a"


def test_reading_order_does_not_depend_on_the_order_of_rows(spark):
    # mean height 0.2: rows up to 0.13 apart are one band
    boxes = [("a", 0.45, 0.23), ("b", 0.28, 0.12), ("c", 0.11, 0.3), ("d", 0.48, 0.08), ("e", 0.25, 0.28), ("f", 0.58, 0.19)]
    found = set()
    for turn in range(len(boxes)):
        for dealt in (boxes[turn:] + boxes[:turn], boxes[turn::-1] + boxes[:turn:-1]):
            rows = [(1, i, 0, 0.1 * (ord(i) - 96), y, 0.3, h) for i, y, h in dealt]
            page = spark.createDataFrame(rows, "page_id long, region_id string, ord int, x double, y double, width double, height double").coalesce(1)
            ranked = reading.reading_order(page).orderBy("reading_rank").collect()
            found.add("".join(r.region_id for r in ranked))
    assert len(found) == 1


def test_the_shared_area_is_that_of_the_edges(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    balloons = spark.createDataFrame([(1, 0.1, 0.1, 0.8, 0.8, (0.2, 0.3, 0.5, 0.5))], f"balloon_id long, x double, y double, width double, height double, layout {box}")
    rows = []
    for label, line, part, supp, quantity in (("a", 1, 17474, 833, 4), ("a", 2, 9454, 268, 13), ("b", 3, 18156, 3, 36)):
        rows.append((1, label, f"l{line}", line, part * 37 % 70 / 100, supp * 53 % 70 / 100, (10 + quantity % 21) / 100 / 4, (8 + part % 23) / 100, 0.5))
    shared = {}
    for label in ("a", "b"):
        own = [r for r in rows if r[1] == label]
        width = min(max(r[4] + r[6] for r in own), 0.7) - max(min(r[4] for r in own), 0.2)
        height = min(max(r[5] + r[7] for r in own), 0.8) - max(min(r[5] for r in own), 0.3)
        shared[label] = max(width, 0.0) * max(height, 0.0)
    assert 0 < shared["b"] - shared["a"] < 1e-12
    grouped = spark.createDataFrame(rows, "balloon_id long, group_label string, line_id string, ord int, x double, y double, width double, height double, confidence double")
    assert [r.group_label for r in grouping.line_group_summary(grouped, balloons).where("is_primary").collect()] == ["b"]
