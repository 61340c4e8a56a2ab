"""Keyed folds: one small state per key, events of a key applied in order.

* ``fold_stream``: a stream whose events come in order from batch to batch;
* ``fold_ordered``: a stream whose events come in any order within a delay;
* ``fold_table``: a stored table, whatever its size and the order of its files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, TimestampType

Step = Callable[[tuple, dict], tuple]


def fold_stream(
    events: DataFrame,
    key: str,
    order: str,
    state_schema: str,
    step: Step,
    initial: tuple,
    ttl_ms: int | None = None,
    expire: Callable[[tuple], tuple] | None = None,
) -> DataFrame:
    """The state of every key touched by a micro-batch, after its events in ``order``.

    ``step(state, event)`` is a pure function.  Events of one micro-batch are sorted by ``order``
    (a whole number), whatever file they come from.  An event that is not after the last one
    applied in an earlier batch comes too late to be applied in its place: it is
    left out and counted in ``late``.  With ``ttl_ms`` a key without events for that long
    passes through ``expire`` once and is forgotten.
    """
    names = _names(state_schema)
    kind = dict(events.dtypes)[key]
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *current, last, late = tuple(state.get) if state.exists else (*initial, None, 0)
        current = tuple(current)
        if state.hasTimedOut:
            state.remove()
            current = expire(current) if expire else current
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            fresh = rows if last is None else rows[rows[order] > last]
            late += len(rows) - len(fresh)
            for event in fresh.to_dict("records"):
                current = step(current, event)
            last = int(fresh[order].iloc[-1]) if len(fresh) else last
            state.update((*current, last, late))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(group[0], *current, late)], columns=[key, *names, "late"])

    kept = f"{state_schema}, last_applied bigint, late bigint"
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {state_schema}, late bigint", kept, "update", timeout)


def _names(schema: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in schema.split(",")]


def _records(rows: pd.DataFrame) -> list[dict]:
    """Rows with None for missing values, whatever type pandas gave their column."""
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


def fold_table(events: DataFrame, key: str, order: str, state_schema: str, step: Step, initial: tuple) -> DataFrame:
    """``(key, state…)`` of every key after all events of a stored table, in ``order``.

    One job: Spark sorts the events of a key behind each other, and they stream past one
    state at a time, so neither the number of jobs nor the memory grows with the table.
    """
    columns = [key, *_names(state_schema)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, current, done = None, False, initial, []
        for rows in batches:
            for event in _records(rows):
                if not begun or event[key] != now:
                    if begun:
                        done.append((now, *current))
                    now, begun, current = event[key], True, initial
                current = step(current, event)
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=columns, dtype=object)
                done = []
        if begun:
            yield pd.DataFrame([*done, (now, *current)], columns=columns, dtype=object)

    ordered = events.repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"{key} {dict(events.dtypes)[key]}, {state_schema}")


class _InOrder(StatefulProcessor):
    """Keeps the events that the watermark has not passed yet, sorted when they are applied."""

    def __init__(self, key: str, order: str, time: str, state_schema: str, event_schema: StructType, step: Step, initial: tuple):
        self.key, self.order, self.time, self.step, self.initial = key, order, time, step, initial
        self.state_schema, self.event_schema = f"{state_schema}, upto bigint, late bigint", event_schema
        self.columns = [key, *_names(state_schema), "late"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.state_schema)
        self.waiting = handle.getListState("waiting", self.event_schema)

    def _millis(self, event: dict) -> int:
        return int(pd.Timestamp(event[self.time]).value // 1_000_000)

    def _stored(self) -> tuple[tuple, int, int, list[dict]]:
        *state, upto, late = self.settled.get() if self.settled.exists() else (*self.initial, -1, 0)
        held = [dict(zip(self.event_schema.names, e)) for e in self.waiting.get()] if self.waiting.exists() else []
        return tuple(state), upto, late, held

    def _settle(self, state: tuple, upto: int, late: int, events: list[dict], watermark: int) -> tuple[tuple, list[dict]]:
        """Apply what the watermark has passed for good; the rest stays in the buffer."""
        events.sort(key=lambda e: e[self.order])
        passed = 0
        while passed < len(events) and self._millis(events[passed]) < watermark:
            state = self.step(state, events[passed])
            passed += 1
        rest = events[passed:]
        self.settled.update((*state, max(upto, watermark), late))
        if rest:
            self.waiting.put([tuple(e[c] for c in self.event_schema.names) for e in rest])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(min(self._millis(e) for e in rest) + 1)
        else:
            self.waiting.clear()
        return state, rest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, upto, late, events = self._stored()
        new = [e for batch in rows for e in _records(batch)]
        fresh = [e for e in new if self._millis(e) >= upto]
        late += len(new) - len(fresh)
        state, rest = self._settle(state, upto, late, events + fresh, timerValues.getCurrentWatermarkInMs())
        for event in rest:  # as things stand; an event in between may still come
            state = self.step(state, event)
        yield pd.DataFrame([(key[0], *state, late)], columns=self.columns, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, upto, late, events = self._stored()
        self._settle(state, upto, late, events, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_ordered(
    events: DataFrame, key: str, order: str, time: str, state_schema: str, step: Step, initial: tuple, delay: str = "10 minutes"
) -> DataFrame:
    """``(key, state…, late)`` of every key touched by a micro-batch, with all events so far in ``order``.

    An event that comes after later ones of its key, but not more than ``delay`` of event
    ``time`` behind the stream, is applied in its place: events wait in the state store
    until the watermark passes them, and what is told is the settled state with those that
    still wait.  ``order`` must rise with ``time``.  Events behind the watermark are dropped by
    Spark, or counted in ``late``.  The buffer of a key holds its events of one ``delay``.
    The query needs the RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    schema = StructType([StructField(f.name, TimestampType() if f.name == time else f.dataType, True) for f in timed.schema])
    processor = _InOrder(key, order, time, state_schema, schema, step, initial)
    out = f"{key} {dict(events.dtypes)[key]}, {state_schema}, late bigint"
    return timed.groupBy(key).transformWithStateInPandas(processor, out, "Update", "EventTime")
