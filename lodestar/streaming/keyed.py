"""Rejected rows and pending items as keyed streaming state.

Both run as arbitrary stateful operators: state is kept by key in the state
store, moves with the query's checkpoint, and is read back as a table, while the
query runs or after it. So a restart goes on with the state it had, and keys are
spread over tasks; one key's state is bounded by its budget.

`buffer_rejects` keeps, for each key, the last `most` rejected rows, and a
timer drops a row once its decayed weight exp(-rate * age) is under
`drop_below`. `pending_items` keeps, for each key, up to `budget` hot items and
the archive of those that had to go (blocked ones first, then the oldest), which
ask for a refresh; items that a batch repeats change nothing, resolved ones go,
and a timer archives items that have waited for `wait` seconds.
Both can start from a table of former state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decay_age(rate: float, drop_below: float) -> float | None:
    """Seconds after which a weight of 1 has decayed under `drop_below`."""
    return math.log(1 / drop_below) / rate if rate > 0 and 0 < drop_below < 1 else None


def _millis(value) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


class Buffered(StatefulProcessor):
    """One key's rejected rows: (seq, at, body), at in milliseconds."""

    def __init__(self, most: int, age: int | None):
        self.most, self.age = most, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq long, at long, body string")
        self.seen = handle.getValueState("seen", "n long")

    def _keep(self, rows: list[tuple], now: int) -> list[tuple]:
        """The last `most` rows that are not too old; a timer for the next to go."""
        kept = sorted(r for r in rows if self.age is None or r[1] + self.age > now)[-self.most :]
        if kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept and self.age is not None:
            self.handle.registerTimer(min(r[1] for r in kept) + self.age)
        return kept

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(s), _millis(t), b) for part in rows for s, t, b in zip(part["seq"], part["at"], part["body"], strict=True)]
        known = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        have = {r[0] for r in known}
        new = [r for r in new if r[0] not in have]
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        self.seen.update((n,))
        now = max(0, timerValues.getCurrentWatermarkInMs())
        kept = self._keep(known + new, now)
        yield pd.DataFrame({"key": [key[0]], "held": [len(kept)], "seen": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        kept = self._keep(known, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        yield pd.DataFrame({"key": [key[0]], "held": [len(kept)], "seen": [self.seen.get()[0] if self.seen.exists() else 0]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        rows = known + [(int(s), _millis(t), b) for s, t, b in zip(initialState["seq"], initialState["at"], initialState["body"], strict=True)]
        self.seen.update((len(rows),))
        self._keep(rows, 0)

    def close(self) -> None:
        """Nothing is held outside the state store."""


class Pending(StatefulProcessor):
    """One key's items: hot ones in a map of bounded size, archived ones in
    another that is only looked up."""

    RECORD = "label string, rows long, status string, created_at long"

    def __init__(self, budget: int, wait: int | None):
        self.budget, self.wait = budget, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hot = handle.getMapState("hot", "item_id string", self.RECORD)
        self.archived = handle.getMapState("archived", "item_id string", self.RECORD)

    def _archive(self, item: tuple, why: str, out: list) -> None:
        record = tuple(self.hot.getValue(item))
        self.hot.removeKey(item)
        self.archived.updateValue(item, record)
        out.append((item[0], why))

    def _settle(self, out: list) -> None:
        """Down to the budget, and a timer for the item that waits longest."""
        items = sorted((0 if r[2] == "blocked" else 1, r[3], k[0]) for k, r in self.hot.iterator())
        for _, _, item in items[: max(0, len(items) - self.budget)]:
            self._archive((item,), "over_budget", out)
        left = items[max(0, len(items) - self.budget) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left and self.wait is not None:
            self.handle.registerTimer(min(at for _, at, _ in left) + self.wait)

    def _told(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"key": key[0], "item_id": [i for i, _ in out], "refresh_requested": [w for _, w in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str]] = []
        events = sorted((int(s), e, i, label, int(n), _millis(t)) for part in rows for s, e, i, label, n, t in zip(part["seq"], part["event"], part["item_id"], part["label"], part["rows"], part["at"], strict=True))
        for _, event, item, label, n, at in events:
            k = (item,)
            hot, archived = self.hot.containsKey(k), self.archived.containsKey(k)
            if event == "resolved":
                for held, there in ((self.hot, hot), (self.archived, archived)):
                    if there:
                        held.removeKey(k)
            elif event == "blocked" and (hot or archived):
                held = self.hot if hot else self.archived
                record = tuple(held.getValue(k))
                held.updateValue(k, (record[0], record[1], "blocked", record[3]))
            elif event in ("cached", "blocked") and not hot and not archived:
                self.hot.updateValue(k, (label, n, "pending" if event == "cached" else "blocked", at))
        self._settle(out)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str]] = []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for item in sorted(k[0] for k, r in self.hot.iterator() if r[3] + self.wait <= now):
            self._archive((item,), "waited", out)
        self._settle(out)
        yield from self._told(key, out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            held = self.hot if r.location == "hot" else self.archived
            held.updateValue((r.item_id,), (r.label, int(r.rows), r.status, _millis(r.at)))
        self._settle([])

    def close(self) -> None:
        """Nothing is held outside the state store."""


@contextmanager
def _store(spark: SparkSession):
    """Queries that start inside use the store that keeps lists, maps and timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, former)


def _started(found: DataFrame, checkpoint: str, sink: str, trigger: dict) -> StreamingQuery:
    with _store(found.sparkSession):
        return found.writeStream.format(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def buffer_rejects(stream: DataFrame, checkpoint: str, most: int, rate: float = 0.0, drop_below: float = 0.0, late: str = "0 seconds", initial: DataFrame | None = None, sink: str = "noop", **trigger) -> StreamingQuery:
    """Keep rejected rows (key, seq long, at timestamp, body string, accepted).
    Rows that repeat a seq of the key's buffer change nothing."""
    age = decay_age(rate, drop_below)
    rows = stream.where(~F.col("accepted")).select("key", "seq", "at", "body").withWatermark("at", late)
    first = None if initial is None else initial.select("key", "seq", "at", "body").groupBy("key")
    found = rows.groupBy("key").transformWithStateInPandas(Buffered(most, None if age is None else int(age * 1000)), "key string, held long, seen long", "Update", "EventTime", initialState=first)
    return _started(found, checkpoint, sink, trigger)


def pending_items(stream: DataFrame, checkpoint: str, budget: int, wait: float | None = None, late: str = "0 seconds", initial: DataFrame | None = None, sink: str = "noop", **trigger) -> StreamingQuery:
    """Follow items by their events (key, seq, event, item_id, label, rows, at):
    `cached`, `blocked` or `resolved`. What is archived is told to the sink."""
    rows = stream.withWatermark("at", late).select("key", "seq", "event", "item_id", "label", "rows", "at")
    first = None if initial is None else initial.select("key", "item_id", "label", "rows", "status", "location", "at").groupBy("key")
    found = rows.groupBy("key").transformWithStateInPandas(Pending(budget, None if wait is None else int(wait * 1000)), "key string, item_id string, refresh_requested string", "Update", "EventTime", initialState=first)
    return _started(found, checkpoint, sink, trigger)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def buffered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, seq, at, body of a buffer's last committed state."""
    rows = _state(spark, checkpoint, "rows")
    return rows.select(F.col("key.key").alias("key"), "list_element.*").withColumn("at", F.timestamp_millis("at"))


def items(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, item_id, label, rows, status, created_at, location of all pending items."""
    out = None
    for location in ("hot", "archived"):
        rows = _state(spark, checkpoint, location).select(F.col("key.key").alias("key"), F.col("user_map_key.item_id").alias("item_id"), "user_map_value.*").withColumn("location", F.lit(location))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("created_at", F.timestamp_millis("created_at"))
