"""The event operators as Structured Streaming: state by key, bounded by limits, watermarks and timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadlens.operators.stateful import MOST_SENT, OLDEST_SENT, admit, already_sent, outdated
from roadlens.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store on disk; a session that has chosen another store for itself is told so."""
    ship(spark)
    now = spark.conf.get(_PROVIDER)
    if not now.endswith("HDFSBackedStateStoreProvider") and now != _ROCKS:
        raise ValueError(f"{_PROVIDER} is {now}; these operators need {_ROCKS}")
    spark.conf.set(_PROVIDER, _ROCKS)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A micro-batch's rows of one key by t, then id; nulls first, as in tables."""
    place = lambda v: (v is not None, v)
    return sorted(rows, key=lambda r: (*place(r["t"]), *place(r["id"])))


class _Timed(StatefulProcessor):
    """A processor with at most one timer a key."""

    def set_timer(self, at_seconds: float | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_seconds is not None:
            self.handle.registerTimer(int(at_seconds * 1000) + 1)

    def close(self) -> None:
        pass


class _RateLimit(_Timed):
    def __init__(self, seconds: float, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        log = deque(self.log.get()[0]) if self.log.exists() else deque()
        for r in _in_order(rows):
            yield Row(key=key[0], id=r["id"], accepted=admit(log, r["t"], self.seconds, self.limit))
        if log:
            self.log.update((list(log),))
            self.set_timer(log[-1] + self.seconds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.log.clear()
        yield from ()


def rate_limit_stream(events: DataFrame, seconds: float, limit: int, late: str = "10 seconds") -> DataFrame:
    """Stream of (key, id, ts) to (key, id, accepted).

    A key's state is its last accepted times, ``limit`` at most: rejected events leave no trace.  Events of a
    micro-batch are taken in order of ts.  When the watermark, ``late`` behind the latest event, has passed the
    window of a key's last accepted event, its state goes, so the state holds the keys of one window.  An event
    without a time is not accepted; one behind the watermark is dropped by Spark.
    """
    with_state_store(events.sparkSession)
    rows = events.select("key", "id", "ts", (F.unix_micros("ts") / 1e6).alias("t")).withWatermark("ts", late)
    kind = dict(events.dtypes)
    return rows.groupBy("key").transformWithState(_RateLimit(seconds, limit), f"key {kind['key']}, id {kind['id']}, accepted boolean", "append", "EventTime")


class _Deliveries(StatefulProcessor):
    def __init__(self, kind: str, most: int, oldest: int):
        self.kind, self.most, self.oldest = kind, most, oldest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", f"key {self.kind}", "place bigint")
        self.next = handle.getValueState("next", "place bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = {k[0]: v[0] for k, v in self.sent.iterator()}
        sent = dict.fromkeys(sorted(stored, key=stored.get))
        again = set()
        for r in _in_order(rows):
            duplicate = already_sent(sent, r["key"], r["ok"], self.most, self.oldest)
            if not duplicate:
                again.add(r["key"])
            yield Row(sender=key[0], key=r["key"], id=r["id"], duplicate=duplicate)
        place = self.next.get()[0] if self.next.exists() else 0
        for name in stored:
            if name not in sent:
                self.sent.removeKey((name,))
        for name in sent:
            if name in again or name not in stored:
                self.sent.updateValue((name,), (place,))
                place += 1
        self.next.update((place,))

    def close(self) -> None:
        pass


def bounded_deliveries_stream(sends: DataFrame, most: int = MOST_SENT, oldest: int = OLDEST_SENT) -> DataFrame:
    """Stream of (sender, key, id, ts, ok) to (sender, key, id, duplicate), as bounded_deliveries over tables.

    State is a map of at most ``most`` keys a sender with the place of each in the order of sending.  Sends of a
    micro-batch are taken in order of ts, micro-batches as they come.
    """
    with_state_store(sends.sparkSession)
    rows = sends.select("sender", "key", "id", "ok", (F.unix_micros("ts") / 1e6).alias("t"))
    kind = dict(sends.dtypes)
    schema = f"sender {kind['sender']}, key {kind['key']}, id {kind['id']}, duplicate boolean"
    return rows.groupBy("sender").transformWithState(_Deliveries(kind["key"], most, oldest), schema, "append", "None")


def first_deliveries_stream(sends: DataFrame, keep: str = "1 hour") -> DataFrame:
    """Stream of (key, ts, ...): the first of each key within the watermark."""
    return sends.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["key"])


def latest_position_stream(fixes: DataFrame) -> DataFrame:
    """Stream of (key, ts, ...) to the latest values of each key (update or complete mode)."""
    values = [c for c in fixes.columns if c not in ("key", "ts")]
    return fixes.groupBy("key").agg(F.max(F.struct("ts", *values)).alias("m")).select("key", "m.*")


class _Retention(_Timed):
    def __init__(self, kind: str, seconds: float, newest: int, states: tuple[str, ...]):
        self.kind, self.seconds, self.newest, self.states = kind, seconds, newest, states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", f"id {self.kind}", "created double, state string, queued boolean")

    def _dropped(self, scope, jobs: dict, now: float) -> Iterator[Row]:
        for name, reason in outdated(jobs, now, self.seconds, self.newest, self.states):
            del jobs[name]
            self.jobs.removeKey((name,))
            yield Row(scope=scope, id=name, reason=reason)
        ends = [created + self.seconds for created, _, queued in jobs.values() if not queued]
        self.set_timer(min(ends) if ends else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        for r in _in_order(rows):
            jobs[r["id"]] = (r["created"], r["state"], r["queued"])
            self.jobs.updateValue((r["id"],), jobs[r["id"]])
        yield from self._dropped(key[0], jobs, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._dropped(key[0], {k[0]: tuple(v) for k, v in self.jobs.iterator()}, timerValues.getCurrentWatermarkInMs() / 1000)


def retention_stream(jobs: DataFrame, seconds: float, newest: int, states: tuple[str, ...], late: str = "10 seconds") -> DataFrame:
    """Stream of job updates (scope, id, ts, created in seconds, state, queued) to the jobs to delete: (scope, id, reason).

    A job goes when the watermark, ``late`` behind the latest update, is more than ``seconds`` past its creation
    and it is not queued (reason age, by a timer, so without another update); of a scope's jobs in an end state
    only the ``newest`` stay (reason number).  State is a scope's jobs: at most ``newest`` ended ones and the
    open ones of that time.
    """
    with_state_store(jobs.sparkSession)
    rows = jobs.select("scope", "id", "ts", (F.unix_micros("ts") / 1e6).alias("t"), F.col("created").cast("double").alias("created"), "state", "queued")
    kind = dict(jobs.dtypes)
    schema = f"scope {kind['scope']}, id {kind['id']}, reason string"
    return rows.withWatermark("ts", late).groupBy("scope").transformWithState(_Retention(kind["id"], seconds, newest, states), schema, "append", "EventTime")


def recent_stream(jobs: DataFrame, keep: str = "24 hours") -> DataFrame:
    """Jobs by hour of creation within the retention time; older state goes with the watermark."""
    return jobs.withWatermark("created", keep).groupBy(F.window("created", "1 hour"), "state").count()
