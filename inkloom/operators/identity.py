"""Page identity across scans, content tokens, safe names and output plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import fold, strip
from inkloom.scale import number_rows
from inkloom.session import materialize


def fingerprint(title: Column, width: Column, height: Column) -> Column:
    return F.concat(fold(title), F.lit("|"), width.cast("string"), F.lit("x"), height.cast("string"))


def file_title(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def fingerprint_pages(pages: DataFrame) -> DataFrame:
    """Fingerprint of every page and how many pages of the project share it."""
    keyed = pages.withColumn("fingerprint", fingerprint(F.col("title"), F.col("pixel_width"), F.col("pixel_height")))
    shared = keyed.groupBy("project_id", "fingerprint").agg(F.count(F.lit(1)).alias("sharing"))
    return keyed.join(shared, ["project_id", "fingerprint"])


def exclude_removed(scan: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scanned files whose relative path was not removed from the project."""
    return scan.join(excluded.select("project_id", "rel_path"), ["project_id", "rel_path"], "left_anti")


def relink_scan(
    scan: DataFrame, previous: DataFrame, use_relative: bool = True, keep: Sequence[str] | None = None
) -> DataFrame:
    """Give scanned files the identity of earlier pages.

    ``scan(project_id, scan_index, path, rel_path, pixel_width, pixel_height)``,
    ``previous(project_id, page_id, prev_index, path, rel_path, title, pixel_width,
    pixel_height)``.  A file is the page of its path, else of its relative path, else
    the one page with its fingerprint, if that page is unique and no file scanned
    before claimed it; otherwise it is new (``page_id`` null).  Pages keep their
    former order, new ones follow in scan order (``page_index``).  ``keep`` names the
    columns of ``scan`` to return, all by default; the others end with the joins by path.
    """
    by = ["project_id"]
    kept = [c for c in scan.columns if keep is None or c in {*by, "scan_index", *keep}]
    page = F.struct("page_id", "prev_index") if use_relative else F.struct("page_id")
    old = previous.withColumn("_fp", fingerprint(F.col("title"), F.col("pixel_width"), F.col("pixel_height")))
    by_path = old.select(*by, "path", page.alias("_p1"))
    linked = scan.join(by_path, [*by, "path"], "left")
    if use_relative:
        by_relative = old.select(*by, "rel_path", page.alias("_p2"))
        linked = linked.join(by_relative, [*by, "rel_path"], "left")
        exact = F.coalesce("_p1", "_p2")
        rule = F.when(F.col("_p1").isNotNull(), "path").when(F.col("_p2").isNotNull(), "relative")
    else:
        exact, rule = F.col("_p1"), F.when(F.col("_p1").isNotNull(), "path")
    linked = linked.select(*scan.columns, exact.alias("_exact"), rule.alias("_rule")).withColumn(
        "_fp", fingerprint(file_title(F.col("path")), F.col("pixel_width"), F.col("pixel_height"))
    )
    unique = old.groupBy(*by, "_fp").agg(F.count(F.lit(1)).alias("_n"), F.min(page).alias("_moved")).where("_n = 1")
    # written once, narrow: the claims, the verdicts and the numbering all start from here
    linked = materialize(linked.join(unique.drop("_n"), [*by, "_fp"], "left").select(*kept, "_exact", "_rule", "_moved"))
    # who claims a page first: exact links at their scan position, else the earliest file with its fingerprint
    claims = linked.groupBy(*by, F.coalesce("_exact", "_moved")["page_id"].alias("_page")).agg(
        F.min(F.when(F.col("_exact").isNotNull(), F.col("scan_index"))).alias("_exact_at"),
        F.min(F.when(F.col("_exact").isNull(), F.col("scan_index"))).alias("_moved_at"),
    ).where(F.col("_page").isNotNull())
    judged = linked.withColumn("_page", F.coalesce("_exact", "_moved")["page_id"]).join(claims, [*by, "_page"], "left")
    first = (F.col("scan_index") == F.col("_moved_at")) & (
        F.col("_exact_at").isNull() | (F.col("_moved_at") < F.col("_exact_at"))
    )
    moved = F.col("_exact").isNull() & F.coalesce(first, F.lit(False))
    settled = judged.select(
        *kept,
        F.when(F.col("_exact").isNotNull() | moved, F.col("_page")).alias("page_id"),
        F.when(F.col("_exact").isNotNull(), F.col("_rule")).when(moved, "fingerprint").otherwise("new").alias("linked_by"),
        *([F.when(F.col("_exact").isNotNull() | moved, F.coalesce("_exact", "_moved")["prev_index"]).alias("_prev")] if use_relative else []),
    )
    settled = materialize(settled)  # numbering reads its rows several times
    if not use_relative:
        return number_rows(settled, by, [F.col("scan_index")], "page_index")
    return number_rows(settled, by, [F.col("_prev").asc_nulls_last(), F.col("scan_index")], "page_index").drop("_prev")


def page_revision(pages: DataFrame, regions: DataFrame, page_fields: Sequence[str], region_fields: Sequence[str]) -> DataFrame:
    """Content token per page over the canonical JSON of its fields and its regions.

    Regions are hashed one by one and combined by exclusive or, so a page of any size
    is summed up on the map side; ids and order are part of what is hashed.
    """
    text = F.to_json(F.struct(*sorted(region_fields)), {"ignoreNullFields": "false"})
    piece = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")
    folded = regions.select("page_id", piece.alias("_h")).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor("_h").alias("_x")
    )
    own = F.to_json(F.struct(*sorted(page_fields)), {"ignoreNullFields": "false"})
    token = F.sha2(
        F.concat_ws("|", own, F.coalesce("_n", F.lit(0)).cast("string"), F.coalesce("_x", F.lit(0)).cast("string")), 256
    )
    return pages.join(folded, "page_id", "left").select("page_id", token.alias("revision"))


def _bad_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return (
        F.when(F.size(parts) == 0, "empty")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(F.exists(parts, lambda p: p.isin(".", "..")), "dot segment")
    )


def plan_outputs(pages: DataFrame, source_root: str, output_root: str) -> DataFrame:
    """Sidecar and output path of every page, with the reason when it is rejected.

    ``collisions`` counts the pages that would write the same output.
    """
    source, output = source_root.rstrip("/"), output_root.rstrip("/")
    nested = output == source or output.startswith(source + "/")
    parts = F.filter(F.split("rel_path", "/"), lambda p: p != "")
    stem = F.regexp_replace(F.array_join(parts, "/"), r"(?<=[^/])\.[^./]*$", "")
    reason = F.when(F.lit(nested), "output inside source").otherwise(_bad_path(F.col("rel_path")))
    planned = pages.withColumn("rejected", reason).withColumns(
        {
            "sidecar_path": F.when(F.col("rejected").isNull(), F.concat(F.lit(source + "/"), stem, F.lit(".str"))),
            "output_path": F.when(F.col("rejected").isNull(), F.concat(F.lit(output + "/"), stem, F.lit(".png"))),
        }
    )
    counts = (
        planned.where(F.col("output_path").isNotNull())
        .groupBy("project_id", "output_path")
        .agg(F.count(F.lit(1)).alias("collisions"))
    )
    return planned.join(counts, ["project_id", "output_path"], "left")


def safe_component(name: Column) -> Column:
    """One path component from a display name, or null."""
    trimmed = strip(name)
    joined = strip(F.array_join(F.filter(F.split(trimmed, r"[/\\:]"), lambda p: p != ""), "_"))
    bad = lambda c: c.isin("", ".", "..")
    return F.when(~bad(trimmed) & ~bad(joined), joined)


def safe_project_dirs(projects: DataFrame, output_root: str) -> DataFrame:
    """Default output folder of every project, null when it would lie in the source; with the number sharing it."""
    root = output_root.rstrip("/")
    source = F.regexp_replace("source_dir", r"/+$", "")
    name = safe_component(F.coalesce("name", F.element_at(F.split(source, "/"), -1)))
    target = F.when(name.isNull(), F.lit(root)).otherwise(F.concat(F.lit(root + "/"), name))

    def inside(path: Column) -> Column:
        return (path == source) | F.startswith(path, F.concat(source, F.lit("/")))

    planned = projects.withColumn("output_dir", F.when(~inside(F.lit(root)) & ~inside(target), target))
    shared = planned.where(F.col("output_dir").isNotNull()).groupBy("output_dir").agg(F.count(F.lit(1)).alias("sharing"))
    return planned.join(shared, "output_dir", "left")
