"""Streams over several micro-batches keep their state."""

import pytest
from pyspark.sql import functions as F

from inkloom.operators import edits
from inkloom.streaming import jobs


def chunks(spark, tmp_path, rows, schema, size):
    """A file stream that delivers ``size`` rows per micro-batch."""
    root = tmp_path / "in"
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(root))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root))


def test_region_progress_restarts_with_the_activity(spark, tmp_path):
    schema = "page_id long, seq long, kind string, stage string, fraction double, activity string, current int, total int"
    e = lambda seq, kind, **k: (1, seq, kind, k.get("stage"), k.get("fraction"), k.get("activity"), k.get("current"), k.get("total"))
    rows = [
        e(0, "stage", stage="ignored", fraction=0.5), e(1, "started"), e(2, "activity", activity="a"), e(3, "region", current=2, total=5),
        e(4, "activity", activity="a"), e(5, "stage", stage="translating", fraction=7.0), e(6, "activity", activity="b"),
    ]
    stream = chunks(spark, tmp_path, rows, schema, 3)
    written = jobs.run_to_end(jobs.live_page_state(stream), "t1")
    assert written.select("batch_id").distinct().count() == 3
    row = jobs.latest(written, "page_id").first()
    assert (row.stage, row.fraction, row.activity, row.current) == ("translating", 1.0, "b", None)


def test_stale_sessions_are_ignored(spark, tmp_path):
    schema = "app long, seq long, kind string, session string, text string"
    rows = [(1, 0, "started", "a", ""), (1, 1, "updated", "a", "one"), (1, 2, "started", "b", ""), (1, 3, "updated", "a", "late"), (1, 4, "updated", "b", "x" * 40_000), (1, 5, "finished", "a", "")]
    out = jobs.latest(jobs.run_to_end(jobs.reasoning_sessions(chunks(spark, tmp_path, rows, schema, 2), None), "t2"), "app").first()
    assert (out.session, len(out.text), out.active) == ("b", 32_000, True)


def test_open_submission_is_reused(spark, tmp_path):
    schema = "key string, seq long, kind string, job_id long"
    rows = [("k", 0, "submit", 1), ("k", 1, "submit", 2), ("k", 2, "finish", 1), ("k", 3, "submit", 4), ("k", 4, "finish", 9)]
    out = jobs.latest(jobs.run_to_end(jobs.dedupe_submissions(chunks(spark, tmp_path, rows, schema, 2)), "t3"), "key").first()
    assert (out.open_job, out.accepted, out.reused) == (4, [4], 1)


def test_log_tail_over_batches(spark, tmp_path):
    schema = "app long, entry_id long, ts timestamp, category string, message string"
    import datetime as dt

    rows = [(1, i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i), "", f"m{i}") for i in range(30)]
    out = jobs.log_tail_stream(chunks(spark, tmp_path, rows, schema, 7), keep=5)
    assert sorted(r.entry_id for r in out.collect()) == [25, 26, 27, 28, 29]


def test_history_stream_equals_batch(spark, tmp_path):
    schema = "page_id long, seq long, action string, state string"
    actions = ["edit", "edit", "undo", "redo", "edit", "undo", "undo", "edit", "redo"]
    rows = [(p, i, a, f"s{i % 3}") for p in (1, 2) for i, a in enumerate(actions)]
    batch = edits.replay_edits(spark.createDataFrame(rows, schema))
    ordered = sorted(rows, key=lambda r: r[1])
    stream = jobs.latest(jobs.run_to_end(jobs.replay_edit_stream(chunks(spark, tmp_path, ordered, schema, 4)), "w7"), "page_id")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.select(*batch.columns).collect()))


def test_job_lists(spark):
    listed = spark.createDataFrame([(1, "compose", "running"), (2, "compose", "completed")], "job_id long, operation string, status string")
    assert [r.status for r in jobs.cancel_open(listed).orderBy("job_id").collect()] == ["cancelled", "completed"]
    assert [r.job_id for r in jobs.clear_finished(listed).collect()] == [1]
    failures = spark.createDataFrame([(2, 9), (2, 4), (2, 9)], "job_id long, page_id long")
    assert jobs.retry_failed(listed, failures).first().page_ids == [4, 9]


def test_folder_tables_in_any_file_order(spark, tmp_path):
    import random

    schema = "page_id long, seq long, action string, state string"
    rng = random.Random(3)
    rows = [(p, i, rng.choice(["edit", "undo", "redo"]), f"s{i % 4}") for p in range(3) for i in range(40)]
    want = edits.replay_edits(spark.createDataFrame(rows, schema))
    mixed = rows[:]
    rng.shuffle(mixed)
    for i in range(0, len(mixed), 17):
        spark.createDataFrame(mixed[i : i + 17], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    stream = jobs.stream_of(spark, str(tmp_path), "log")
    got = jobs.latest(jobs.run_to_end(jobs.replay_edit_stream(stream), "folder"), "page_id")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select(*want.columns).collect()))
    assert {r.late for r in got.collect()} == {0}


def test_streams_without_data(spark, tmp_path):
    schema = "page_id long, seq long, action string, state string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "log.parquet"))
    stream = jobs.stream_of(spark, str(tmp_path), "log")
    assert jobs.run_to_end(jobs.replay_edit_stream(stream), "none").count() == 0
    (tmp_path / "bare").mkdir()
    bare = spark.readStream.schema("app long, entry_id long, ts timestamp, category string, message string").parquet(str(tmp_path / "bare"))
    assert jobs.log_tail_stream(bare).count() == 0
    assert jobs.run_to_end(bare, "bare", "append").count() == 0


def test_events_of_an_earlier_place_are_counted(spark, tmp_path):
    schema = "key string, seq long, kind string, job_id long"
    rows = [("k", 5, "submit", 1), ("k", 7, "finish", 1), ("k", 6, "submit", 2), ("k", 8, "submit", 4)]
    out = jobs.latest(jobs.run_to_end(jobs.dedupe_submissions(chunks(spark, tmp_path, rows, schema, 2)), "late"), "key").first()
    assert (out.open_job, out.accepted, out.late) == (4, [4], 1)


def test_replay_of_shuffled_files_in_several_batches(spark, tmp_path, monkeypatch):
    """Queries over a stored table do not depend on its size, on its files or on their order."""
    import __spark_entry__ as entry

    source = "/root/testdata/sf0.001"
    names = ["live_page_state", "reasoning_sessions", "dedupe_submissions", "replay_edit_stream", "event_rates"]
    want = {n: sorted(map(str, entry.queries()[n](spark, source).collect())) for n in names}
    table = spark.read.parquet(f"{source}/events.parquet")
    for i in range(6):
        part = table.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == i)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(jobs, "BATCH_BYTES", 16_000)
    batches = jobs.run_to_end(jobs.replay_of(spark, str(tmp_path), "events", "event_id"), "batches", "append")
    ends = batches.groupBy("batch_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).orderBy("batch_id").collect()
    assert len(ends) > 2 and all(x.b < y.a for x, y in zip(ends, ends[1:])) and batches.count() == table.count()
    for n in names:
        assert sorted(map(str, entry.queries()[n](spark, str(tmp_path)).collect())) == want[n]


def test_late_events_fail_a_replay(spark):
    written = spark.createDataFrame([("a", 0), ("b", 1)], "key string, late long")
    assert jobs.none_late(written.where("late = 0")).columns == ["key"]
    with pytest.raises(Exception, match="left out"):
        jobs.none_late(written).collect()


def test_events_in_any_order_within_the_delay(spark, tmp_path):
    """Shuffled micro-batches give the state of the sorted table."""
    import datetime as dt
    import random

    rng = random.Random(17)
    schema = "page_id long, seq long, kind string, stage string, fraction double, activity string, current int, total int, ts timestamp"
    kinds = ["started", "stage", "activity", "region", "completed", "failed"]
    rows = [
        (rng.randrange(4), i, rng.choices(kinds, [3, 3, 3, 3, 1, 1])[0], f"s{i % 3}", i / 100, f"a{i % 2}", i % 7, 9, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i))
        for i in range(120)
    ]
    want = jobs.live_page_state(spark.createDataFrame(rows, schema))
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(25))  # up to 25 seconds out of order
    stream = chunks(spark, tmp_path, mixed, schema, 20)
    written = jobs.run_to_end(jobs.live_page_state(stream, "ts", "1 minute"), "any-order")
    got = jobs.latest(written, "page_id")
    assert written.select("batch_id").distinct().count() >= 6
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.late for r in got.collect()} == {0}


def test_tables_fold_in_one_job(spark):
    """As many jobs for a table in 40 files as for one in two, and the result of the stream rule."""
    schema = "key string, seq long, kind string, job_id long"
    rows = [(f"k{i % 5}", i, "finish" if i % 4 == 3 else "submit", None if i % 8 == 3 else i) for i in range(400)]
    want = {}
    for key, _, kind, job in rows:
        want[key] = jobs.submission_step(want.get(key, (None, [], 0)), {"kind": kind, "job_id": job})
    for parts in (2, 40):
        out = jobs.dedupe_submissions(spark.createDataFrame(rows, schema).repartition(parts)).collect()
        assert {r.key: (r.open_job, r.accepted, r.reused) for r in out} == want
