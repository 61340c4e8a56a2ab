"""Shared building blocks that keep operators whole and fast on skewed keys.

Most groups (a page, a balloon, a region) are small, so operators run them
with one shuffle on the group key.  A group may still be huge; the helpers
here find such groups with a map-side combined count and give them a path
that spreads one group over many tasks, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from inkloom.session import materialize

#: Rows of one group that a single task may sort in a window.
WINDOW_GROUP_LIMIT = 1_000_000
#: Rows of one group that may sit in one array or meet in one nested loop.
ARRAY_GROUP_LIMIT = 512
#: Rows that may be brought to the driver as a key list or broadcast table.
SMALL_TABLE_ROWS = 20_000
#: Bytes of the texts and nested values of one such row; a table with a longer row is not small.
SMALL_ROW_BYTES = 2_048


def _bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows of ``df``, or None when there are more than ``limit`` or one is longer than ``SMALL_ROW_BYTES``.

    Rows are measured where they are and long ones do not travel, so at most ``limit`` times that many bytes reach the driver.
    """
    lengths = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            lengths.append(F.octet_length(value))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            lengths.append(F.octet_length(F.to_json(F.struct(value.alias("v")))))
    if not lengths:
        rows = df.limit(limit + 1).collect()
        return rows if len(rows) <= limit else None
    total = reduce(add, [F.coalesce(n, F.lit(0)).cast("long") for n in lengths])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = df.select(F.when(total <= SMALL_ROW_BYTES, row).alias("row")).limit(limit + 1).collect()
    if len(found) > limit or any(r.row is None for r in found):
        return None
    return [r.row for r in found]


def small_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame | None:
    """``df`` as a broadcastable local relation, or None when it has more rows than ``limit`` or a row above ``SMALL_ROW_BYTES``."""
    rows = _bounded_rows(df, limit)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_if_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Broadcast only after rows and their bytes are checked; otherwise leave the join to the shuffle."""
    local = small_table(df, limit)
    return df if local is None else F.broadcast(local)


def hot_groups(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of ``by`` with more than ``limit`` rows, or None when there are none."""
    return group_keys(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n"))


def group_keys(big: DataFrame) -> DataFrame | None:
    """The keys of groups as a broadcast table, written when they are many, or None when there are none."""
    rows = _bounded_rows(big, SMALL_TABLE_ROWS)
    if rows is None:
        return materialize(big)
    return F.broadcast(big.sparkSession.createDataFrame(rows, big.schema)) if rows else None


def split_hot(df: DataFrame, by: Sequence[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups)."""
    if hot is None:
        return df, None
    return df.join(hot, list(by), "left_anti"), df.join(hot, list(by), "left_semi")


def ordered_index(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position inside each group, with one group spread over many tasks.

    Rows are range-partitioned by (group, order); each partition numbers its own
    rows and adds the count of the partitions before it.  The partitioned rows
    are written once, so both uses see the same boundaries.
    """
    keys = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    local = Window.partitionBy("_part", *by).orderBy(*order)
    counts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per (group, partition it touches): groups + partitions rows in all
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *by, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    on = F.lit(True)
    for c in ["_part", *by]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    joined = numbered.alias("l").join(offsets.alias("o"), on)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("o._before")).cast("long").alias(name),
    )


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    limit: int = WINDOW_GROUP_LIMIT,
) -> DataFrame:
    """1-based position in a total order per group; ordinary groups use a window, hot ones ``ordered_index``."""
    if not by:
        return ordered_index(df, by, order, name)
    cold, hot = split_hot(df, by, hot_groups(df, by, limit))
    out = cold.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    if hot is None:
        return out
    return out.unionByName(ordered_index(hot, by, order, name))


def previous_values(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    values: dict[str, str],
    limit: int = WINDOW_GROUP_LIMIT,
) -> DataFrame:
    """Add ``values[new] = column`` of the previous row of the group (null on the first)."""
    cold, hot = split_hot(df, by, hot_groups(df, by, limit))
    window = Window.partitionBy(*by).orderBy(*order)
    out = cold.select("*", *[F.lag(src).over(window).alias(new) for new, src in values.items()])
    if hot is None:
        return out
    numbered = materialize(ordered_index(hot, by, order, "_pos"))
    shifted = numbered.select(
        *by, (F.col("_pos") + 1).alias("_pos"), *[F.col(src).alias(new) for new, src in values.items()]
    )
    return out.unionByName(numbered.join(shifted, [*by, "_pos"], "left").drop("_pos"))


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, limit: int = WINDOW_GROUP_LIMIT, ahead: bool = False) -> DataFrame:
    """Add ``name``: the last non-null ``value`` of the rows before this one in its group (``ahead``: the first after it).

    ``order`` must be a total order.  A group above ``limit`` is range-partitioned; each
    partition carries its own values and takes over what the partitions before it end with.
    """
    cold, hot = split_hot(df, by, hot_groups(df, by, limit))
    sort = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    so_far = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    out = cold.withColumn(name, F.last(value, ignorenulls=True).over(so_far))
    if hot is None:
        return out
    ranged = hot.repartitionByRange(*[F.col(c) for c in by], *sort).withColumns({"_part": F.spark_partition_id(), "_value": value})
    ranged = materialize(ranged)
    local = Window.partitionBy("_part", *by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = ranged.groupBy("_part", *by).agg((F.min_by if ahead else F.max_by)("_value", place).alias("_end"))
    # one row per (group, partition it touches)
    parts = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", *by, F.last("_end", ignorenulls=True).over(parts).alias("_before"))
    on = F.lit(True)
    for c in ["_part", *by]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    told = ranged.withColumn(name, F.last("_value", ignorenulls=True).over(local)).alias("l").join(before.alias("o"), on)
    return out.unionByName(
        told.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(F.col(f"l.{name}"), F.col("o._before")).alias(name))
    )


#: Ranges that one round of ``ranked_values`` cuts the open values of a large group into.
RANGES = 64


def ranked_values(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], limit: int = WINDOW_GROUP_LIMIT) -> DataFrame:
    """Per group the values at the given 0-based ``ranks`` (expressions over ``_n``, its rows with a value).

    Equal values are counted before anything is sorted.  A group with more than ``limit``
    distinct values is narrowed down: quantile sketches, merged on the map side, cut its
    open values into ranges, exact counts tell the range that holds the rank, and only
    that one stays open, until it fits into one sort.  No value is shuffled for that.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    large = hot_groups(counts, by, limit)
    cold, hot = split_hot(counts, by, large)
    window = Window.partitionBy(*by)
    running = cold.withColumns({"_upto": F.sum("_c").over(window.orderBy(value)), "_n": F.sum("_c").over(window)})
    at = [F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    out = running.groupBy(*by).agg(*at)
    if hot is None:
        return out
    hot = materialize(hot)
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("long").alias("_rank")) for n, r in ranks.items()])).alias("_a")
    key = [*by, "_name"]
    none = F.lit(None).cast(dict(hot.dtypes)[value])
    bounds = hot.groupBy(*by).agg(F.sum("_c").alias("_n")).select(*by, asked).select(
        *by, "_a.*", F.lit(0).cast("long").alias("_before"), none.alias("_lo"), none.alias("_hi")
    )
    while True:
        bounds = materialize(bounds)
        inside = (F.col("_lo").isNull() | (F.col(value) > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(value) <= F.col("_hi")))
        open_values = hot.join(broadcast_if_small(bounds), list(by)).where(inside)
        cuts = F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(RANGES * 16)).alias("_cuts")
        sizes = materialize(open_values.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), cuts))
        if sizes.agg(F.max("_size")).first()[0] <= limit:
            break
        placed = open_values.join(broadcast_if_small(sizes), key)
        place = F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_place")  # a cut belongs to the range it ends
        held = placed.groupBy(*key, "_rank", "_before", place).agg(
            F.sum("_c").alias("_held"), F.min(value).alias("_least"), F.max(value).alias("_hi")
        )
        # at most RANGES rows per group and name
        order = Window.partitionBy(*key).orderBy("_place")
        upto = held.withColumns({"_upto": F.col("_before") + F.sum("_held").over(order), "_lower": F.lag("_hi").over(order)})
        chosen = upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_held") <= F.col("_rank")))
        former = bounds.select(*key, F.col("_lo").alias("_former"))
        bounds = chosen.join(former, key).select(
            *key, "_rank", (F.col("_upto") - F.col("_held")).alias("_before"), F.coalesce("_lower", "_former").alias("_lo"), "_hi"
        )
    running = open_values.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*key).orderBy(value)))
    found = running.where(F.col("_upto") > F.col("_rank")).groupBy(*key).agg(F.min(value).alias("_v"))
    told = found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in ranks])
    return out.unionByName(told)


#: Largest k for which Spark's window group limit trims map tasks by itself.
WINDOW_LIMIT_K = 1000


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "_rank") -> DataFrame:
    """First ``k`` rows per group; ``order`` must be a total order.

    Spark's window group limit trims each map task to ``k`` rows before the shuffle.
    Above its threshold the rows are first ranked in random slices of the group, of
    which each keeps its ``k`` best, so no task sorts a whole hot group.
    """
    rows = df
    if k > WINDOW_LIMIT_K:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
        part = Window.partitionBy("_slice", *by).orderBy(*order)
        rows = salted.withColumn("_first", F.row_number().over(part)).where(F.col("_first") <= k).drop("_slice", "_first")
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows evenly by hash before a step that costs much more per row than a shuffle."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)
