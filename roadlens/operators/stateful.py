"""Event operators over tables: sliding-log limit, idempotent delivery, retention, latest rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.session import ship

# How many sent ids a sender remembers, and how many it forgets at once.
MOST_SENT, OLDEST_SENT = 5_000, 1_000


def admit(log: deque, t: float | None, seconds: float, limit: int) -> bool:
    """Whether an event at t is within the limit; then it is logged.  One without a time is not."""
    if t is None:
        return False
    while log and t - log[0] > seconds:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(t)
    return True


def already_sent(sent: dict, name: object, ok: bool | None, most: int, oldest: int) -> bool:
    """Whether ``name`` is remembered in ``sent``, whose order is that of sending.  If not, it is sent now: above ``most``
    the ``oldest`` are forgotten, and a failed send is forgotten at once.  An unknown outcome counts as a failure."""
    if name in sent:
        return True
    sent[name] = None
    if len(sent) > most:
        for old in list(islice(sent, oldest)):
            del sent[old]
    if not ok:
        sent.pop(name, None)
    return False


def _same(a: tuple, b: tuple) -> bool:
    """Equal keys as Spark groups them: nulls are equal, and so are NaNs."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def walked(rows: DataFrame, keys: list[str], order: list[str], kept: list[str], read: list[str], fresh: Callable, step: Callable, result: str) -> DataFrame:
    """Rows in order within each key, each with ``step(state, *read columns)``, the state made by ``fresh()`` for every key.

    Rows are sorted within partitions and streamed through tasks in Arrow batches, which hold one key's state and
    nothing else.  A key is one task's work, linear in its rows.  Values stay Arrow's: no null turns whole numbers
    into floats.  Returns the columns ``kept`` and ``result`` (boolean).
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            of = lambda names: zip(*[batch.column(c).to_pylist() for c in names], strict=True)
            for key, values in zip(of(keys), of(read), strict=True):
                if current is None or not _same(key, current):
                    current, state = key, fresh()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.bool_())], [*kept, result])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {result} boolean"
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def rate_limited(events: DataFrame, keys: list[str], seconds: float, limit: int) -> DataFrame:
    """Events (keys, id, t in seconds) with ``accepted``; only accepted events count against the limit.

    Events of null keys are those of one key.  An event without a time is not accepted.  Ties in t go by id.
    """
    rows = events.select(*keys, "id", F.col("t").cast("double").alias("t"))
    return walked(rows, keys, ["t", "id"], [*keys, "id"], ["t"], deque, lambda log, t: admit(log, t, seconds, limit), "accepted")


def first_deliveries(sends: DataFrame) -> DataFrame:
    """Sends (key, id, t, ok): the first is delivered, later ones are duplicates, until a failed send frees the key.

    The table remembers every key; see bounded_deliveries for a sender that forgets."""
    order = Window.partitionBy("key").orderBy("t", "id")
    failures = F.coalesce(F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sends.withColumn("epoch", failures)
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("key", "epoch").orderBy("t", "id")) > 1).drop("epoch")


def bounded_deliveries(sends: DataFrame, sender: str, most: int = MOST_SENT, oldest: int = OLDEST_SENT) -> DataFrame:
    """Sends (sender, key, id, t, ok) with ``duplicate``, by senders that remember ``most`` keys.

    A key that is remembered is a duplicate.  One key more than ``most`` makes the sender forget its ``oldest``; a
    failed send forgets its key.  Null keys are one key.  A sender is one task's work, since what it forgets
    depends on all it has sent before; its state is ``most`` keys.
    """
    rows = sends.select(sender, "key", "id", "t", "ok")
    step = lambda sent, key, ok: already_sent(sent, key, ok, most, oldest)
    return walked(rows, [sender], ["t", "id"], [sender, "key", "id"], ["key", "ok"], dict, step, "duplicate")


def retained(jobs: DataFrame, now: Column, seconds: float, newest: int, states: tuple[str, ...]) -> DataFrame:
    """Jobs (id, created, state, queued) that stay: not older than ``seconds`` unless queued, and of those in
    an end state only the ``newest``."""
    fresh = jobs.where((now - F.col("created") <= seconds) | F.col("queued"))
    ended = fresh.where(F.col("state").isin(*states)).orderBy(F.col("created").desc(), F.col("id").desc()).limit(newest)
    return fresh.where(~F.col("state").isin(*states)).unionByName(ended)


def outdated(jobs: dict, now: float, seconds: float, newest: int, states: tuple[str, ...]) -> list[tuple[object, str]]:
    """Ids of jobs (id: (created, state, queued)) that retention drops, with the reason: age, or too many in an end state."""
    old = [k for k, (created, _, queued) in jobs.items() if now - created > seconds and not queued]
    gone = set(old)
    ended = sorted((created, k) for k, (created, state, _) in jobs.items() if state in states and k not in gone)
    return [(k, "age") for k in old] + [(k, "number") for _, k in ended[: max(0, len(ended) - newest)]]


def latest_per_key(rows: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The values of each key's latest row, as one aggregate."""
    return rows.groupBy(key).agg(F.max(F.struct(at, *values)).alias("m")).select(key, f"m.{at}", *[f"m.{v}" for v in values])


def latest_upserts(rows: DataFrame, key: str, at: str, keep: int = 20) -> DataFrame:
    """Newest row of each key, and of those the ``keep`` newest."""
    last = Window.partitionBy(key).orderBy(F.col(at).desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").orderBy(F.col(at).desc(), key).limit(keep)


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, values: list[str], tolerance: float) -> DataFrame:
    """Left rows (key, t, ...) with the newest right row of the key not later than t and younger than ``tolerance``.

    One sort of the union by (key, t) instead of a join: no pairs are made.
    """
    names = left.columns
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(t, *values).alias("s")).schema["s"].dataType))
    other = right.select(key, t, F.lit(0).alias("_side"), F.struct(t, *values).alias("_v"))
    rows = both.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    near = F.col(t) - F.col(f"_last.{t}") < tolerance
    return rows.select(*names, *[F.when(near, F.col(f"_last.{v}")).alias(v) for v in values])
