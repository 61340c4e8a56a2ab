"""File layouts."""

import json

from pyspark.sql import functions as F

from inkloom.sources import files


def entry(i, **more):
    base = {
        "id": f"ID-{i}", "order": i, "bounds": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}, "sourceText": f"s{i}",
        "translatedText": "", "confidence": 0.5, "style": {},
    }
    return {**base, **more}


def document(*entries, version=1):
    return {
        "schemaVersion": version, "sourceRelativePath": "p.jpg", "pixelWidth": 100, "pixelHeight": 100,
        "targetLanguageCode": "zh-Hant", "updatedAt": "2026-01-01T00:00:00Z", "entries": list(entries),
    }


def test_scan_lists_images_in_natural_order(spark, tmp_path):
    for name in ("b/p10.PNG", "b/p2.png", "a.txt", "b/.hidden.png", ".dir/x.png", "lib.app/y.png", "z.webp"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = files.scan_pages(spark, str(tmp_path)).orderBy("scan_index").collect()
    assert [r.rel_path for r in found] == ["b/p2.png", "b/p10.PNG", "z.webp"]
    sizes = spark.createDataFrame([("z.webp", 10, 20)], "rel_path string, pixel_width int, pixel_height int")
    assert [r.rel_path for r in files.scan_pages(spark, str(tmp_path), sizes).collect()] == ["z.webp"]


def test_sidecars_fall_back_to_their_backup(spark, tmp_path):
    (tmp_path / "good.str").write_text(json.dumps(document(entry(0), entry(1)), indent=2))
    (tmp_path / "broken.str").write_text('{"schemaVersion": 1, "entr')
    (tmp_path / "broken.str.bak").write_text(json.dumps(document(entry(2))))
    (tmp_path / "newer.str").write_text(json.dumps(document(entry(3), version=2)))
    documents, rejected = files.read_sidecars(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[1], r.read_from) for r in documents.collect()) == [("broken.str", "backup"), ("good.str", "main")]
    assert [(r.file.rsplit("/", 1)[1], r.fault) for r in rejected.collect()] == [("newer.str", "unsupported version")]
    rows = {r.region_id: r for r in files.sidecar_regions(documents).collect()}
    assert set(rows) == {"id-0", "id-1", "id-2"}
    assert rows["id-0"].detected_direction == "automatic" and rows["id-0"].automatic_mask and rows["id-0"].qa_flags == []


def test_models_stay_separate_and_shapes_survive(spark, tmp_path):
    ocr = {m: {"modelID": m, "text": m, "lines": [], "writingDirection": "vertical"} for m in ("one", "two")}
    square = [{"x": 0.1, "y": 0.1}, {"x": 0.2, "y": 0.1}, {"x": 0.2, "y": 0.2}]
    rich = entry(0, ocrResults=ocr, bubbleMaskPolygons=[square], translationConfidence=1.7, mcpExtractedSourceText="agent")
    (tmp_path / "p.str").write_text(json.dumps(document(rich)))
    row = files.sidecar_regions(files.read_sidecars(spark, str(tmp_path))[0]).first()
    assert sorted(row.ocr_results) == ["one", "two"] and len(row.bubble_polygons[0]) == 3
    assert row.translation_confidence == 1.0 and row.extracted_source_text == "agent"


def test_newest_valid_version_is_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, 7, "p.png", 10, 10)], "page_id long, project_id long, rel_path string, pixel_width int, pixel_height int")
    regions = spark.createDataFrame([(1, f"r{i}", i, 0.1, 0.1, 0.1, 0.1, f"s{i}", "") for i in (2, 0, 1)], "page_id long, region_id string, ord int, x double, y double, width double, height double, source_text string, translated_text string")
    root = str(tmp_path / "out")
    files.write_sidecars(files.sidecar_documents(pages, regions, "en"), root, 1)
    later = regions.withColumn("source_text", F.concat("source_text", F.lit("+")))
    files.write_sidecars(files.sidecar_documents(pages, later, "en"), root, 2)
    rows = files.sidecar_regions(files.read_sidecar_versions(spark, root)[0]).orderBy("ord").collect()
    assert [r.source_text for r in rows] == ["s0+", "s1+", "s2+"]
    (tmp_path / "out" / "version=3" / "project_id=7").mkdir(parents=True)
    (tmp_path / "out" / "version=3" / "project_id=7" / "part-0.json").write_text('{"page_id": 1, "schemaVersion": 9, "entries": []}\n')
    rows = files.sidecar_regions(files.read_sidecar_versions(spark, root)[0]).collect()
    assert len(rows) == 3


def test_a_page_falls_back_as_a_whole(spark, tmp_path):
    pages = spark.createDataFrame([(1, 7, "p.png", 10, 10)], "page_id long, project_id long, rel_path string, pixel_width int, pixel_height int")
    regions = spark.createDataFrame([(1, f"r{i}", i, 0.1, 0.1, 0.1, 0.1, f"s{i}", "") for i in range(5)], "page_id long, region_id string, ord int, x double, y double, width double, height double, source_text string, translated_text string")
    root = str(tmp_path / "out")
    files.write_sidecars(files.sidecar_documents(pages, regions, "en"), root, 1)
    later = files.sidecar_documents(pages, regions.withColumn("source_text", F.lit("new")), "en", max_entries=2)
    files.write_sidecars(later, root, 2)
    assert {r.source_text for r in files.sidecar_regions(files.read_sidecar_versions(spark, root)[0]).collect()} == {"new"}
    for part in (tmp_path / "out" / "version=2").rglob("part-*.json"):
        lines = part.read_text().splitlines()
        kept = [x if '"part":1' not in x else x[: len(x) // 2] for x in lines]
        part.write_text("\n".join(kept) + "\n")
        for crc in part.parent.glob(f".{part.name}.crc"):
            crc.unlink()
    documents, rejected = files.read_sidecar_versions(spark, root)
    assert sorted(r.source_text for r in files.sidecar_regions(documents).collect()) == [f"s{i}" for i in range(5)]
    assert {r.fault for r in rejected.collect()} == {"corrupt", "incomplete"}


def test_snapshots_of_all_versions(spark, tmp_path):
    old = {"savedAt": "2026-01-02T00:00:00Z", "selectedPageID": "x", "sourceDirectoryURL": "file:///in/book/", "pages": [{"id": "x", "index": 1}]}
    bare = {"savedAt": "2026-01-02T00:00:00Z", "pages": []}
    (tmp_path / "a.json").write_text(json.dumps(old) + "\n" + json.dumps(bare) + "\n")
    rows = sorted(files.read_snapshots(spark, str(tmp_path)).collect(), key=lambda r: r.name)
    assert [r.name for r in rows] == ["book", "未命名專案"]
    assert rows[0].selection == ["x"] and rows[0].schema_version == 1 and rows[0].created_at == rows[0].saved_at
    assert files.snapshot_pages(files.read_snapshots(spark, str(tmp_path))).count() == 1


def test_truth_lines_and_report(spark, tmp_path):
    truth = {"a.jpeg": {"width": 100, "height": 200, "lines": [{"text": "窓の外", "box": [10, 20, 30, 40]}, {"text": "雪だ", "box": [0, 0, 2, 2]}]}}
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=1))
    rows = files.read_truth_lines(spark, str(tmp_path / "truth.json")).orderBy("line_no").collect()
    assert [(r.text, r.cx, r.cy) for r in rows] == [("窓の外", 0.2, 0.15), ("雪だ", 0.01, 0.005)]
    files.write_report(files.read_truth_lines(spark, str(tmp_path / "truth.json")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
