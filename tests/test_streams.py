"""Stateful streams and their tables against plain loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from roadlens.operators import stateful
from roadlens.streaming import events


class Feed:
    """A folder of files that a stream reads one by one, and the query over it."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.parquet(f"{self.path}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def start(self, out, name):
        self.query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{self.path}/c").start()

    def step(self, rows):
        self.put(rows)
        self.query.processAllAvailable()

    def state_rows(self):
        return self.query.lastProgress["stateOperators"][0]["numRowsTotal"]


def seconds(at):
    return F.timestamp_micros((F.lit(1_800_000_000_000_000) + F.col(at) * 1_000_000).cast("long"))


def limited_by_hand(rows, window, limit):
    logs, out = {}, {}
    for key, name, t in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        log = [x for x in logs.get(key, []) if t is None or t - x <= window]
        out[name] = t is not None and len(log) < limit
        logs[key] = log + [t] if out[name] else log
    return out


def test_rate_limit_with_null_and_large_keys(spark):
    """Nulls are one key of their own and leave large whole numbers as they are."""
    rng = random.Random(1)
    keys = [None, 2**53, 2**53 + 1, -(2**63), 7]
    rows = [(rng.choice(keys), k, rng.choice([None, *range(200)]) if k % 9 == 0 else float(rng.randrange(200))) for k in range(600)]
    rows = [(k, n, None if t is None else float(t)) for k, n, t in rows]
    df = spark.createDataFrame(rows, "user long, id long, t double").repartition(7)
    got = {r["id"]: (r["user"], r["accepted"]) for r in stateful.rate_limited(df, ["user"], 30.0, 3).collect()}
    want = limited_by_hand(rows, 30.0, 3)
    assert got == {n: (k, want[n]) for k, n, _ in rows}
    two = df.withColumn("kind", F.when(F.col("id") % 3 == 0, None).otherwise("x"))
    got = {r["id"]: r["accepted"] for r in stateful.rate_limited(two, ["user", "kind"], 30.0, 3).collect()}
    assert got == limited_by_hand([((k, n % 3 == 0), n, t) for k, n, t in rows], 30.0, 3)
    assert stateful.rate_limited(df.limit(0), ["user"], 30.0, 3).count() == 0


def test_rate_limit_of_nan_keys_is_one_key(spark):
    df = spark.createDataFrame([(float("nan"), k, float(k)) for k in range(6)] + [(None, 9, 1.0)], "key double, id long, t double")
    assert stateful.rate_limited(df, ["key"], 60.0, 2).where("accepted").count() == 3


def sent_by_hand(rows, most, oldest):
    sent, out = {}, {}
    for sender, key, name, _, ok in sorted(rows, key=lambda r: (r[3], r[2])):
        mine = sent.setdefault(sender, [])
        out[name] = key in mine
        if key in mine:
            continue
        mine.append(key)
        if len(mine) > most:
            del mine[:oldest]
        if not ok and key in mine:
            mine.remove(key)
    return out


def sends(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), k, k // 3, rng.random() < 0.8) for k in range(n)]


@pytest.mark.parametrize("most,oldest", [(20, 5), (3, 3), (5_000, 1_000)])
def test_bounded_deliveries(spark, most, oldest):
    rows = sends(900)
    df = spark.createDataFrame(rows, "sender string, key long, id long, t long, ok boolean").repartition(5)
    got = {r["id"]: r["duplicate"] for r in stateful.bounded_deliveries(df, "sender", most, oldest).collect()}
    assert got == sent_by_hand(rows, most, oldest)


def test_bounded_deliveries_stream(spark, tmp_path):
    """Ten micro-batches agree with a plain loop and with the table, and state keeps its bound."""
    rows = sends(600)
    feed = Feed(spark, tmp_path, "sender string, key long, id long, t long, ok boolean")
    feed.start(events.bounded_deliveries_stream(feed.stream().withColumn("ts", seconds("t")), 20, 5), "sent")
    for k in range(0, 600, 60):
        feed.step(rows[k : k + 60])
        assert feed.state_rows() <= 3 * (20 + 1)
    feed.query.stop()
    got = {r["id"]: r["duplicate"] for r in spark.table("sent").collect()}
    assert got == sent_by_hand(rows, 20, 5)
    table = stateful.bounded_deliveries(spark.createDataFrame(rows, feed.schema), "sender", 20, 5)
    assert got == {r["id"]: r["duplicate"] for r in table.collect()}


def test_rate_limit_stream_forgets(spark, tmp_path):
    """Micro-batches agree with a plain loop; after the window of the last events no state is left but that of the newest key."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 2**53, 2**53 + 1, 5]), k, k / 2) for k in range(240)]
    feed = Feed(spark, tmp_path, "key long, id long, t double")
    feed.start(events.rate_limit_stream(feed.stream().withColumn("ts", seconds("t")), 20.0, 3, "5 seconds"), "limited")
    for k in range(0, 240, 40):
        feed.step(rows[k : k + 40])
    assert feed.state_rows() > 0
    got = {r["id"]: (r["key"], r["accepted"]) for r in spark.table("limited").collect()}
    want = limited_by_hand(rows, 20.0, 3)
    assert got == {n: (k, want[n]) for k, n, _ in rows}
    feed.step([(99, 1000, 1000.0)])
    feed.step([(99, 1001, 2000.0)])
    feed.step([(99, 1002, None)])
    only = feed.state_rows()
    feed.query.stop()
    one = Feed(spark, tmp_path / "one", feed.schema)
    one.start(events.rate_limit_stream(one.stream().withColumn("ts", seconds("t")), 20.0, 3, "5 seconds"), "single")
    one.step([(99, 1001, 2000.0)])
    assert only == one.state_rows()
    one.query.stop()


def kept_by_hand(updates, now, age, newest):
    jobs = {}
    for _, name, _, created, state, queued in updates:
        jobs[name] = (created, state, queued)
    stay = {k: v for k, v in jobs.items() if now - v[0] <= age or v[2]}
    ended = sorted(((v[0], k) for k, v in stay.items() if v[1] in ("done", "failed")), reverse=True)
    return {k for k, v in stay.items() if v[1] not in ("done", "failed")} | {k for _, k in ended[:newest]}


def test_retention_stream(spark, tmp_path):
    """Jobs go by number at once and by age without another update of their own; queued ones stay."""
    feed = Feed(spark, tmp_path, "scope string, id long, t double, created double, state string, queued boolean")
    feed.start(events.retention_stream(feed.stream().withColumn("ts", seconds("t")).withColumn("created", F.col("created") + 1_800_000_000), 100.0, 3, ("done", "failed"), "1 second"), "gone")
    first = [("s", k, 10.0 + k, float(k), ["open", "done", "failed"][k % 3], k == 0) for k in range(12)]
    feed.step(first)
    gone = lambda: {(r["scope"], r["id"]): r["reason"] for r in spark.table("gone").collect()}
    assert {k for k, in [(n,) for _, n in gone()]} == set(range(12)) - kept_by_hand(first, 20.0, 100.0, 3)
    assert set(gone().values()) == {"number"}
    later = [("other", 50, 120.0, 119.0, "open", False)]
    feed.step(later)  # moves the watermark to 119, more than 100 seconds past all jobs' creation
    feed.step([("other", 51, 121.0, 120.0, "open", False)])
    left = set(range(12)) - {n for s, n in gone() if s == "s"}
    assert left == kept_by_hand(first, 119.0, 100.0, 3) == {0}
    feed.step([("s", 0, 122.0, 0.0, "done", False)])
    feed.step([("other", 51, 123.0, 120.0, "done", False)])
    assert ("s", 0) in gone() and gone()["s", 0] == "age"
    feed.query.stop()
    table = spark.createDataFrame(first, feed.schema)
    stays = stateful.retained(table, F.lit(20.0), 100.0, 3, ("done", "failed"))
    assert {r["id"] for r in stays.collect()} == kept_by_hand(first, 20.0, 100.0, 3)


def test_admit_leaves_no_trace_of_rejected_events():
    log = deque()
    assert [admit_at for admit_at in (0, 1, 2, 3, 60, 61, 61.5, 62) if stateful.admit(log, admit_at, 60, 3)] == [0, 1, 2, 61, 61.5]
