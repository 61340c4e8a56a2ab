"""Set operations over pages, candidates and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.scale import number_rows
from inkloom.session import written


def intersect_selection(selection: DataFrame, pages: DataFrame, order: str) -> DataFrame:
    """Selected pages that still exist; a project left without any selects its first page."""
    valid = selection.select("project_id", "page_id").distinct().join(
        pages.select("project_id", "page_id"), ["project_id", "page_id"], "left_semi"
    )
    first = pages.groupBy("project_id").agg(F.min_by("page_id", order).alias("page_id"))
    empty = first.join(valid.select("project_id").distinct(), "project_id", "left_anti")
    return valid.unionByName(empty)


def union_candidates(enclosures: DataFrame, clusters: DataFrame) -> DataFrame:
    """Enclosure candidates, then supplemental clusters, with one 1-based index per page."""
    # the numbering reads its rows twice, and clusters cost a spatial join
    both = enclosures.withColumn("_source", F.lit(0)).unionByName(written(clusters).withColumn("_source", F.lit(1)))
    order = [F.col("_source"), F.col("ord"), F.col("candidate_id")]
    return number_rows(both, ["page_id"], order, "candidate_index").drop("_source")


def missing_ids(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected ids that were not returned."""
    keys = expected.columns
    return expected.distinct().join(returned.select(*keys), keys, "left_anti")
