"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (trimmed of spaces, not empty) is boilerplate of a host when more than
``ratio`` of the host's pages contain it, and at least ``least_pages`` of them.
Pages of a host with the same whole text count once: copies of a page are the
near-dedup operator's work and must not turn each other's lines into boilerplate.

Lines are grouped by (host, 64-bit digest), so a host with any share of the rows is
spread over all tasks and only digests are shuffled.  A host has at most (distinct
lines per page) / ratio boilerplate lines; they form one array per host that is
looked up inside each page, so texts are never shuffled unless the arrays of all
hosts together are too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.session import checkpointed

#: Share of a host's pages above which a line is boilerplate, and pages it must be on.
RATIO = 0.05
LEAST_PAGES = 4
#: Hosts, and boilerplate lines of all hosts, that may be broadcast (at most about 10 MB).
BROADCAST_HOSTS = 20_000
BROADCAST_LINES = 500_000
NEW = ["n_lines", "n_dropped", "kept_text"]


def _digest(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): digests of the boilerplate lines of every host that has some."""
    split = F.filter(F.split(F.col(text), "\n"), _filled)
    rows = pages.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"),
        F.xxhash64(text).alias("page"),
        F.xxhash64(F.lit(1), F.col(text)).alias("page2"),
        F.array_distinct(F.transform(split, _digest)).alias("lines"),
    )
    once = rows.groupBy("host", "page", "page2").agg(F.first("lines").alias("lines"))  # copies have equal lines
    totals = rows.select("host", "page", "page2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.where(F.col("n") >= least_pages).alias("c").join(
        totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))
    )
    return (
        frequent.where(F.col("n") > F.col("pages") * ratio)
        .groupBy(F.col("c.host").alias("host"))
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str,
    text: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``pages`` with ``n_lines``, ``n_dropped`` and ``kept_text`` (the other lines, in order).

    A null text has no lines and stays null; a null host is a host of its own; empty
    lines are never boilerplate; rows that repeat stay.  Input columns with the names
    of the new ones are replaced.
    """
    found = checkpointed(boilerplate(pages, host, text, ratio, least_pages))
    size = found.agg(F.count(F.lit(1)), F.sum(F.size("lines"))).first()
    if size[0] <= BROADCAST_HOSTS and (size[1] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    found = found.select(F.col("host").alias("_bp_host"), F.col("lines").alias("_bp_lines"))
    kept = [c for c in pages.columns if c not in NEW]
    lines = F.split(F.col(text), "\n")
    good = F.when(F.col("_bp_lines").isNull(), lines).otherwise(
        F.filter(lines, lambda line: ~(_filled(line) & F.array_contains("_bp_lines", _digest(line))))
    )
    return (
        pages.join(found, F.col(host).eqNullSafe(F.col("_bp_host")), "left")
        .select(*kept, lines.alias("_lines"), good.alias("_good"))
        .select(
            *kept,
            F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("_lines") - F.size("_good"), F.lit(0)).cast("long").alias("n_dropped"),
            F.array_join("_good", "\n").alias("kept_text"),
        )
    )
