"""Job and page events as streams: live state, sessions, submissions, roll-ups, log tail, history."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from inkloom.operators.edits import HISTORY_LIMIT, tail_log
from inkloom.session import scratch_path
from inkloom.streaming.keyed import fold_ordered, fold_stream, fold_table

#: A reasoning session without an end is closed after this time.
SESSION_TTL_MS = 15 * 60 * 1000
REASONING_LIMIT = 32_000


# --- running a stream to its end ----------------------------------------------


#: Bytes of files one micro-batch takes; bounds what a single key can bring to one task.
BATCH_BYTES = 256 * 1024 * 1024


def stream_of(spark: SparkSession, directory: str, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A file stream over one table, be it a file or a folder of part files, in micro-batches of bounded size."""
    path = f"{directory}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(batch_bytes))
    first = table.select("_metadata.file_path").first()
    places = [first[0]] if first else table.inputFiles()  # a table without rows has few files
    if places and places[0].endswith(f"/{name}.parquet"):  # a stream takes folders only: pick the file in its folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return reader.parquet(path)


def replay_of(spark: SparkSession, directory: str, name: str, order: Column | str, batch_bytes: int | None = None) -> DataFrame:
    """A stream over a whole stored table whose micro-batches ascend by ``order``, whatever file a row is in.

    A table of more than one batch is range-partitioned into the shared folder, equal values in
    one range, and its ranges are written one after another: a file stream takes files by
    age, and those of the same age by name.
    """
    most = batch_bytes or BATCH_BYTES
    table = spark.read.parquet(f"{directory}/{name}.parquet")
    files = table.select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size")).first()[0] or 0
    if size <= most:  # one batch, which is applied in order
        return stream_of(spark, directory, name, most)
    order = F.col(order) if isinstance(order, str) else order
    dealt, root = scratch_path(spark, f"{name}-ranges"), scratch_path(spark, f"{name}-ordered")
    table.repartitionByRange(-(-size // most), order).write.parquet(dealt)
    ranges = spark.read.parquet(dealt)
    lowest = ranges.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(order).alias("low"))
    for k, r in enumerate(lowest.orderBy(F.col("low").asc_nulls_first()).collect()):  # one row per batch of files
        spark.read.schema(table.schema).parquet(r["file"]).coalesce(1).write.parquet(f"{root}/{k:08d}")
    return spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(most)).parquet(f"{root}/*")


def none_late(written: DataFrame) -> DataFrame:
    """``written`` without ``late``; fails if an event came too late to be applied."""
    fault = F.raise_error(F.lit("events were left out because they came after later ones of their key"))
    return written.where(F.when(F.col("late") > 0, fault.cast("boolean")).otherwise(True)).drop("late")


def run_to_end(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Process everything available and return what was written, with its ``batch_id``; no rows for a stream without data."""
    spark = stream.sparkSession
    target, progress = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    written: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folder, so a retry leaves no duplicates
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        written.append(batch_id)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", IntegerType())])
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/*")


def latest(written: DataFrame, *keys: str) -> DataFrame:
    """The last written row per key."""
    fields = [c for c in written.columns if c not in (*keys, "batch_id")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch_id").alias("s"))
    return newest.select(*keys, "s.*")


def _folded(
    events: DataFrame, key: str, schema: str, step, initial: tuple, time: str | None, delay: str, ttl_ms: int | None = None, expire=None
) -> DataFrame:
    """The fold that fits: of a stored table, of a stream in any order within ``delay`` of ``time``, or of one in order."""
    if not events.isStreaming:
        return fold_table(events, key, "seq", schema, step, initial)
    if time is not None:
        return fold_ordered(events, key, "seq", time, schema, step, initial, delay)
    return fold_stream(events, key, "seq", schema, step, initial, ttl_ms, expire)


# --- live page state ----------------------------------------------------------

PAGE_STATE = "running boolean, stage string, fraction double, activity string, current int, total int"
PAGE_START = (False, None, None, None, None, None)


def page_step(state: tuple, event: dict) -> tuple:
    """Only pages of a running job change; region progress restarts when the activity changes."""
    running, stage, fraction, activity, current, total = state
    kind = event["kind"]
    if kind == "started":
        return True, stage, fraction, "preparingPage", None, None
    if not running:
        return state
    if kind in ("completed", "failed"):
        return False, kind, fraction, None, None, None
    if kind == "stage":
        share = None if pd.isna(event["fraction"]) else min(max(event["fraction"], 0.0), 1.0)
        return running, event["stage"], share, activity, current, total
    if kind == "activity":
        kept = (current, total) if activity == event["activity"] else (None, None)
        return running, stage, fraction, event["activity"], *kept
    if kind == "region":
        done, whole = (None if pd.isna(event[c]) else max(0, int(event[c])) for c in ("current", "total"))
        return running, stage, fraction, activity, done, whole
    return state


def live_page_state(events: DataFrame, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Latest state per page from (page_id, seq, kind, stage, fraction, activity, current, total), a stream or a table.

    With ``time``, a column of event times that ``seq`` rises with, events of a stream may
    come in any order within ``delay``.
    """
    return _folded(events, "page_id", PAGE_STATE, page_step, PAGE_START, time, delay)


def latest_stage(events: DataFrame) -> DataFrame:
    """Newest stage per page by one streaming aggregate, where the reset rule is not needed."""
    return events.groupBy("page_id").agg(F.max_by(F.struct("stage", "fraction"), "seq").alias("s")).select("page_id", "s.*")


# --- reasoning sessions -------------------------------------------------------

SESSION_STATE = "session string, text string, active boolean"


def session_step(state: tuple, event: dict) -> tuple:
    session, text, active = state
    if event["kind"] == "started":
        return event["session"], "", True
    if event["session"] != session:
        return state
    if event["kind"] == "updated":
        return session, event["text"][:REASONING_LIMIT], active
    return session, text, False


def reasoning_sessions(
    events: DataFrame, ttl_ms: int | None = SESSION_TTL_MS, time: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Current reasoning session per application; events of former sessions are ignored.

    ``time`` and ``delay`` as in ``live_page_state``; sessions of a table, or of a stream with ``time``, do not expire.
    """
    return _folded(
        events, "app", SESSION_STATE, session_step, (None, "", False), time, delay, ttl_ms, lambda s: (s[0], s[1], False)
    )


# --- submissions --------------------------------------------------------------


def submission_key(project: Column, operation: Column, pages: Column) -> Column:
    """Equal for submissions of the same operation on the same set of pages."""
    return F.sha2(F.concat_ws("|", project, operation, F.to_json(F.array_sort(F.array_distinct(pages)))), 256)


SUBMISSION_STATE = "open_job bigint, accepted array<bigint>, reused bigint"


def submission_step(state: tuple, event: dict) -> tuple:
    """A submission equal to one that is still open returns the open job.

    A finish names its job, or none for whichever job of the key is open.
    """
    open_job, accepted, reused = state
    job = None if pd.isna(event["job_id"]) else int(event["job_id"])
    if event["kind"] == "submit":
        return (job, [job], reused) if open_job is None else (open_job, accepted, reused + 1)
    if job is None or job == open_job:
        return None, accepted, reused
    return state


def dedupe_submissions(events: DataFrame, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Per submission key: the open job, the last accepted job and how many submissions were reused.

    ``events(key, seq, kind, job_id)`` with kinds 'submit' and 'finish', a stream or a
    table; ``time`` and ``delay`` as in ``live_page_state``.
    """
    return _folded(events, "key", SUBMISSION_STATE, submission_step, (None, [], 0), time, delay)


# --- roll-ups -----------------------------------------------------------------


def job_rollup(events: DataFrame) -> DataFrame:
    """Event counts and last event per job; works on a stream and on a table alike."""
    kind = F.col("kind")
    return events.groupBy("job_id").agg(
        F.count_if(kind == "started").alias("starts"),
        F.count_if(kind == "completed").alias("done"),
        F.count_if(kind == "failed").alias("failed"),
        F.max_by("kind", "seq").alias("last_kind"),
        F.max("seq").alias("last_seq"),
    )


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per kind in tumbling windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "kind", "events"
    )


def cancel_open(jobs: DataFrame) -> DataFrame:
    """Cancel every queued or running job."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status")))


def retry_failed(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """One new queued job per job with failed pages, holding exactly those pages."""
    pages = failures.groupBy("job_id").agg(F.array_sort(F.collect_set("page_id")).alias("page_ids"))
    return jobs.select("job_id", "operation").join(pages, "job_id").select(
        F.concat(F.col("job_id").cast("string"), F.lit("-retry")).alias("new_job"), "operation", "page_ids", F.lit("queued").alias("status")
    )


def clear_finished(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running"))


# --- log tail and history -----------------------------------------------------


def log_tail_stream(entries: DataFrame, keep: int = 500) -> DataFrame:
    """Run a log stream to its end and return the last ``keep`` entries per application.

    Each micro-batch merges the former tail with its own entries into a new version,
    so at most ``keep`` rows per application are carried along.
    """
    spark = entries.sparkSession
    root = scratch_path(spark, "log-tail")
    columns = entries.columns

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if seen:
            former = spark.read.schema(batch.schema).parquet(f"{root}/v{seen[-1]}")
            rows = former.unionByName(batch)
        tail_log(rows, keep).select(*columns).write.mode("overwrite").parquet(f"{root}/v{batch_id}")

    seen: list[int] = []

    def step(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        seen.append(batch_id)

    query = (
        entries.writeStream.option("checkpointLocation", scratch_path(spark, "log-progress")).trigger(availableNow=True).foreachBatch(step).start()
    )
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], entries.schema)
    return spark.read.schema(entries.schema).parquet(f"{root}/v{seen[-1]}")


HISTORY_STATE = "undo array<string>, redo array<string>, current string"


def history_step(state: tuple, event: dict) -> tuple:
    undo, redo, current = [list(state[0]), list(state[1]), state[2]]
    if event["action"] == "edit":
        if not undo or undo[-1] != current:
            undo.append(current)
        return undo[-HISTORY_LIMIT:], [], event["state"]
    if event["action"] == "undo" and undo:
        return undo[:-1], [*redo, current], undo[-1]
    if event["action"] == "redo" and redo:
        return [*undo, current], redo[:-1], redo[-1]
    return state


def replay_edit_stream(log: DataFrame) -> DataFrame:
    """Undo and redo stacks per page as a stream of (page_id, seq, action, state)."""
    return fold_stream(log, "page_id", "seq", HISTORY_STATE, history_step, ([], [], ""))


# --- region estimate ----------------------------------------------------------


def estimated_region(progress: Column, total: Column) -> Column:
    """Region being written at a given inference progress: none before 55 %, then by share of the rest."""
    value = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    share = (value - 0.55) / (1 - 0.55)
    index = F.least(total, F.greatest(F.lit(1), F.ceil(share * total)))
    return F.when((total <= 0) | (value <= 0.55), F.lit(0)).otherwise(index).cast("int")


def estimate_region(events: DataFrame) -> DataFrame:
    return events.withColumn("region_index", estimated_region(F.col("progress"), F.col("total")))


