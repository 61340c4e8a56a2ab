"""File layouts: image scans, page sidecars, project snapshots, truth lines and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.boxes import Box
from inkloom.operators.edits import clamp
from inkloom.operators.reading import natural_order

# Extensions scanned, and folders that are one file to the user.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "heic", "heif", "tif", "tiff", "webp")
PACKAGE_EXTENSIONS = ("app", "bundle", "framework", "pages", "key", "numbers", "photoslibrary")
SIDECAR_VERSION = 1
UNNAMED_PROJECT = "未命名專案"

RECT = "struct<x:double,y:double,width:double,height:double>"
POINT = "struct<x:double,y:double>"
OCR = f"struct<modelID:string,text:string,confidence:double,lines:array<struct<text:string,confidence:double,bounds:{RECT}>>,writingDirection:string>"
ENTRY = (
    f"struct<id:string,order:int,bounds:{RECT},bubbleBounds:{RECT},bubbleMaskPolygons:array<array<{POINT}>>,"
    f"bubbleLayoutBounds:{RECT},detectedWritingDirection:string,rawSourceText:string,sourceText:string,"
    f"ocrResults:map<string,{OCR}>,ocrTextRefined:boolean,literalTranslatedText:string,mcpExtractedSourceText:string,"
    f"translatedText:string,speakerID:string,tone:string,translationConfidence:double,translationQAFlags:array<string>,"
    f"translationAnchor:{POINT},translationBounds:{RECT},confidence:double,style:map<string,string>,"
    f"automaticMaskEnabled:boolean,maskPolygons:array<array<{POINT}>>,maskRefinementApplied:boolean,"
    f"maskCoverageRatio:double,maskCoverageComplete:boolean>"
)
SIDECAR = (
    "schemaVersion int, sourceRelativePath string, pixelWidth int, pixelHeight int, "
    f"targetLanguageCode string, updatedAt string, entries array<{ENTRY}>"
)


def scan_pages(spark: SparkSession, root: str, sizes: DataFrame | None = None) -> DataFrame:
    """Image files below ``root`` in natural path order, without hidden files and package contents.

    Only names and times are read; empty files hold no image and are not listed.  ``sizes(rel_path, pixel_width, pixel_height)``, when
    given, adds the dimensions and drops files that have none.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    )
    base = root.rstrip("/").removeprefix("file:")
    plain = F.regexp_replace("path", r"^file:/*(?=/)", "")
    relative = F.when(
        F.startswith(plain, F.lit(base + "/")), F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    ).otherwise(F.element_at(F.split(plain, "/"), -1))
    parts = F.split(F.col("rel_path"), "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    packaged = F.exists(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.lower(F.substring_index(p, ".", -1)).isin(*PACKAGE_EXTENSIONS) & F.contains(p, F.lit("."))
    )
    extension = F.lower(F.substring_index("rel_path", ".", -1))
    found = listed.select(
        plain.alias("path"), relative.alias("rel_path"), "length", F.col("modificationTime").alias("modified_at")
    ).where(extension.isin(*IMAGE_EXTENSIONS) & ~hidden & ~packaged)
    if sizes is not None:
        found = found.join(sizes, "rel_path")
    return natural_order(found, [], "rel_path", "scan_index")


def _clamped(value: Column) -> Column:
    return F.when(value.isNotNull(), Box.struct(value).clamp().as_struct())


def sidecar_regions(documents: DataFrame) -> DataFrame:
    """Region rows of valid sidecar documents, missing fields at their defaults."""
    e = F.col("e")
    flat = documents.select("sourceRelativePath", "targetLanguageCode", F.explode("entries").alias("e"))
    none = F.array().cast(f"array<array<{POINT}>>")
    return flat.select(
        F.col("sourceRelativePath").alias("rel_path"),
        F.col("targetLanguageCode").alias("target_language"),
        F.lower(e["id"]).alias("region_id"),
        e["order"].alias("ord"),
        *[e["bounds"][c].alias(c) for c in ("x", "y", "width", "height")],
        _clamped(e["bubbleBounds"]).alias("bubble_bounds"),
        F.coalesce(e["bubbleMaskPolygons"], none).alias("bubble_polygons"),
        _clamped(e["bubbleLayoutBounds"]).alias("bubble_layout"),
        F.coalesce(e["detectedWritingDirection"], F.lit("automatic")).alias("detected_direction"),
        e["rawSourceText"].alias("raw_source_text"),
        e["sourceText"].alias("source_text"),
        F.coalesce(e["ocrResults"], F.create_map().cast(f"map<string,{OCR}>")).alias("ocr_results"),
        F.coalesce(e["ocrTextRefined"], F.lit(False)).alias("text_confirmed"),
        e["literalTranslatedText"].alias("literal_text"),
        e["mcpExtractedSourceText"].alias("extracted_source_text"),
        e["translatedText"].alias("translated_text"),
        e["speakerID"].alias("speaker"),
        e["tone"].alias("tone"),
        clamp(e["translationConfidence"], 0.0, 1.0).alias("translation_confidence"),
        F.array_sort(F.array_distinct(F.coalesce(e["translationQAFlags"], F.array().cast("array<string>")))).alias("qa_flags"),
        e["translationAnchor"].alias("translation_anchor"),
        _clamped(e["translationBounds"]).alias("translation_bounds"),
        e["confidence"].alias("confidence"),
        e["style"].alias("style"),
        F.coalesce(e["automaticMaskEnabled"], F.lit(True)).alias("automatic_mask"),
        F.filter(F.coalesce(e["maskPolygons"], none), lambda p: F.size(p) >= 3).alias("mask_polygons"),
        F.coalesce(e["maskRefinementApplied"], F.lit(False)).alias("mask_refined"),
        clamp(e["maskCoverageRatio"], 0.0, 1.0).alias("mask_coverage"),
        F.coalesce(e["maskCoverageComplete"], F.lit(False)).alias("mask_complete"),
    )


def _judged(documents: DataFrame) -> DataFrame:
    required = F.forall(
        "entries", lambda e: e["id"].isNotNull() & e["order"].isNotNull() & e["bounds"].isNotNull() & e["sourceText"].isNotNull()
    )
    fault = (
        F.when(F.col("_corrupt").isNotNull() | F.col("entries").isNull() | F.col("schemaVersion").isNull(), "corrupt")
        .when(F.col("schemaVersion") != SIDECAR_VERSION, "unsupported version")
        .when(~required, "corrupt")
    )
    return documents.withColumn("fault", fault)


def read_sidecars(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) from ``*.str`` files; a bad file falls back to its ``*.str.bak``."""
    schema = SIDECAR + ", _corrupt string"

    def load(pattern: str) -> DataFrame:
        reader = (
            spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        )
        rows = reader.json(root).withColumn("file", F.col("_metadata.file_path"))
        return _judged(rows)

    main = load("*.str")
    backup = load("*.str.bak").where("fault is null").withColumn("file", F.regexp_replace("file", r"\.bak$", ""))
    fields = [c for c in main.columns if c not in ("file", "_corrupt", "fault")]
    saved = backup.select("file", F.lit(True).alias("_saved"), F.struct(*fields).alias("_b"))
    joined = main.join(saved, "file", "left").withColumn("_use", F.col("fault").isNotNull() & F.col("_saved").isNotNull())
    chosen = joined.where(F.col("fault").isNull() | F.col("_use")).select(
        "file", F.when(F.col("_use"), "backup").otherwise("main").alias("read_from"),
        *[F.when(F.col("_use"), F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c) for c in fields],
    )
    rejected = joined.where(F.col("fault").isNotNull() & ~F.col("_use")).select("file", "fault")
    return chosen, rejected


ENTRY_COLUMNS = {
    "region_id": "id", "detected_direction": "detectedWritingDirection", "raw_source_text": "rawSourceText",
    "source_text": "sourceText", "text_confirmed": "ocrTextRefined", "literal_text": "literalTranslatedText",
    "extracted_source_text": "mcpExtractedSourceText", "translated_text": "translatedText", "speaker": "speakerID", "tone": "tone",
    "translation_confidence": "translationConfidence", "qa_flags": "translationQAFlags", "bubble_bounds": "bubbleBounds",
    "bubble_layout": "bubbleLayoutBounds", "bubble_polygons": "bubbleMaskPolygons", "translation_bounds": "translationBounds",
    "translation_anchor": "translationAnchor", "ocr_results": "ocrResults", "confidence": "confidence", "style": "style",
    "automatic_mask": "automaticMaskEnabled", "mask_polygons": "maskPolygons", "mask_refined": "maskRefinementApplied",
    "mask_coverage": "maskCoverageRatio", "mask_complete": "maskCoverageComplete",
}


def sidecar_documents(pages: DataFrame, regions: DataFrame, language: str, max_entries: int | None = None) -> DataFrame:
    """One document per page; ``order`` is the 0-based list position.

    ``max_entries`` splits larger pages into that many entries per document; every document
    says of how many ``parts`` its page is.
    """
    from inkloom.scale import number_rows

    placed = number_rows(regions, ["page_id"], [F.col("ord"), F.col("region_id")], "_n")
    order = (F.col("_n") - 1).cast("int")
    fields = [order.alias("order"), F.struct("x", "y", "width", "height").alias("bounds")]
    fields += [F.col(c).alias(name) for c, name in ENTRY_COLUMNS.items() if c in regions.columns]
    part = F.lit(0) if max_entries is None else F.floor((F.col("_n") - 1) / max_entries).cast("int")
    entries = placed.groupBy("page_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entries"))
    parts = F.lit(1)
    if max_entries is not None:
        sizes = regions.groupBy("page_id").agg(F.ceil(F.count(F.lit(1)) / max_entries).cast("int").alias("_parts"))
        entries, parts = entries.join(sizes, "page_id"), F.col("_parts")
    head = pages.select(
        "page_id", "project_id", F.col("rel_path").alias("sourceRelativePath"), F.col("pixel_width").alias("pixelWidth"),
        F.col("pixel_height").alias("pixelHeight"),
    )
    return head.join(entries, "page_id").select(
        "project_id", "page_id", "part", parts.alias("parts"), F.lit(SIDECAR_VERSION).alias("schemaVersion"), "sourceRelativePath", "pixelWidth",
        "pixelHeight", F.lit(language).alias("targetLanguageCode"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"), "entries",
    )


def write_sidecars(documents: DataFrame, root: str, version: int) -> None:
    """Compressed JSON documents in a new version folder, by project; earlier versions stay as backups."""
    documents.write.mode("errorifexists").option("compression", "gzip").partitionBy("project_id").json(f"{root.rstrip('/')}/version={version}")


def read_sidecar_versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): per page the newest version of which every part is valid.

    A page falls back as a whole, so it never mixes versions or loses a part.  Rejected are
    the bad documents with their fault, and newer versions that were passed over as incomplete.
    """
    schema = f"page_id bigint, part int, parts int, {SIDECAR}, _corrupt string, version int, project_id bigint"
    rows = (
        spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("basePath", root).json(f"{root.rstrip('/')}/version=*")
    )
    judged = _judged(rows).withColumn("file", F.col("_metadata.file_path"))
    good = judged.where("fault is null and page_id is not null")
    versions = good.groupBy("page_id", "version").agg(
        F.countDistinct("part").alias("_have"), F.max(F.coalesce("parts", F.lit(1))).alias("_want")
    )
    newest = versions.where("_have >= _want").groupBy("page_id").agg(F.max("version").alias("version"))
    chosen = good.join(newest, ["page_id", "version"]).drop("_corrupt", "fault", "file")
    bad = judged.where("fault is not null").select("file", "version", "page_id", "fault")
    torn = versions.where("_have < _want").select(
        F.lit(None).cast("string").alias("file"), "version", "page_id", F.lit("incomplete").alias("fault")
    )
    return chosen, bad.unionByName(torn)


def migrate_sidecars(pages: DataFrame, regions: DataFrame, legacy: DataFrame) -> DataFrame:
    """Regions to write for pages whose sidecar is absent or elsewhere.

    ``pages(page_id, sidecar_path, target_path, sidecar_exists)``; ``legacy`` holds the
    regions read from former places (with ``page_id``).  A page found there keeps that
    content, any other is rebuilt from its current regions.  ``origin`` says which.
    """
    settled = F.coalesce((F.col("sidecar_path") == F.col("target_path")) & F.col("sidecar_exists"), F.lit(False))
    having = pages.where(~settled).join(regions.select("page_id").distinct(), "page_id", "left_semi")
    elsewhere = having.where(F.col("sidecar_path").isNotNull() & (F.col("sidecar_path") != F.col("target_path")))
    old = legacy.join(elsewhere.select("page_id"), "page_id", "left_semi")
    rebuilt = regions.join(having.select("page_id"), "page_id", "left_semi").join(
        old.select("page_id").distinct(), "page_id", "left_anti"
    )
    columns = [c for c in regions.columns if c in legacy.columns]
    return old.select(*columns, F.lit("legacy").alias("origin")).unionByName(
        rebuilt.select(*columns, F.lit("rebuilt").alias("origin"))
    )


SNAPSHOT = (
    "schemaVersion int, projectID string, name string, createdAt timestamp, savedAt timestamp, "
    "pages array<struct<id:string,index:int,title:string,relativeSourcePath:string,pixelWidth:int,pixelHeight:int,stage:string,progress:double>>, "
    "selectedPageID string, selectedPageIDs array<string>, sourceDirectoryURL string, outputDirectoryURL string, "
    "excludedSourceRelativePaths array<string>"
)


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Project snapshots of every version with the fields newer versions added filled in."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", str(multi_line).lower()).json(path)
    empty = F.array().cast("array<string>")
    folder = F.nullif(F.element_at(F.split(F.regexp_replace("sourceDirectoryURL", "/+$", ""), "/"), -1), F.lit(""))
    saved = F.coalesce("savedAt", F.current_timestamp())
    return raw.select(
        F.coalesce("schemaVersion", F.lit(1)).alias("schema_version"),
        F.col("projectID").alias("project_id"),
        F.coalesce("name", folder, F.lit(UNNAMED_PROJECT)).alias("name"),
        F.coalesce("createdAt", saved).alias("created_at"),
        saved.alias("saved_at"),
        F.col("selectedPageID").alias("selected_page"),
        F.coalesce("selectedPageIDs", F.when(F.col("selectedPageID").isNotNull(), F.array("selectedPageID")), empty).alias("selection"),
        F.col("sourceDirectoryURL").alias("source_dir"),
        F.coalesce("excludedSourceRelativePaths", empty).alias("excluded_paths"),
        "pages",
    )


def snapshot_pages(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("project_id", F.explode("pages").alias("p")).select(
        "project_id", F.col("p.id").alias("page_id"), F.col("p.index").alias("page_index"), F.col("p.title").alias("title"),
        F.col("p.relativeSourcePath").alias("rel_path"), F.col("p.pixelWidth").alias("pixel_width"),
        F.col("p.pixelHeight").alias("pixel_height"), F.col("p.stage").alias("stage"),
    )


TRUTH = "map<string,struct<width:int,height:int,lines:array<struct<text:string,box:array<int>>>>>"


def read_truth_lines(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Ground-truth lines, one row per line, with normalised centres.

    Documents are whole files, or one per text line with ``whole_files=False``.
    """
    documents = spark.read.text(path, wholetext=whole_files)
    files = documents.select(F.explode(F.from_json("value", TRUTH)).alias("file", "page"))
    lines = files.select("file", "page.width", "page.height", F.posexplode("page.lines").alias("line_no", "l"))
    box = F.col("l.box")
    return lines.select(
        "file", "width", "height", "line_no", F.col("l.text").alias("text"), box.alias("box"),
        ((box[0] + box[2]) / 2 / F.col("width")).alias("cx"), ((box[1] + box[3]) / 2 / F.col("height")).alias("cy"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON rows."""
    report.write.mode("errorifexists").json(path)
