"""The streaming consumer in strict order: retries hold back a partition, dead letters let it go on."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions.retry import DeadLetters, Pause
from tidelog.sources.log import LOG_SCHEMA
from tidelog.streaming.runner import Hooks, Runner

AT = datetime(2024, 1, 1)


def rows(spark, partition, offsets):
    return spark.createDataFrame([("t", partition, o, AT, "k", str(o), None, AT) for o in offsets], LOG_SCHEMA)


def failing_at(offset, times, error="StandardError"):
    return lambda df: df.withColumn("failed", (F.col("offset") == offset) & (F.col("attempt") <= times)).withColumn("error_class", F.lit(error))


@pytest.fixture
def clock():
    now = [0]
    return now, lambda: now[0]


def test_order_is_kept_while_a_message_is_retried(spark, tmp_path, clock):
    now, tell = clock
    runner = Runner(spark, str(tmp_path), failing_at(3, 1), DeadLetters("dead", max_retries=2), Pause(1000), clock=tell)
    runner.batch(rows(spark, 0, range(6)), 1)
    assert [r.cursor for r in runner.cursors().collect()] == [3]
    assert sorted(r.offset for r in runner.held().collect()) == [3, 4, 5]
    runner.batch(rows(spark, 0, [6]), 2)  # paused: nothing moves
    assert [r.cursor for r in runner.cursors().collect()] == [3]
    now[0] += 2_000_000  # the first failure waits twice the timeout
    runner.batch(None, 3)
    assert [r.cursor for r in runner.cursors().collect()] == [7]
    assert not runner.held().collect()
    assert sorted(r.offset for r in runner.processed().collect()) == list(range(7))


def test_a_message_that_keeps_failing_is_dead_lettered_and_skipped(spark, tmp_path):
    ended = []
    hooks = Hooks(eofed=lambda: ended.append("eof"))
    runner = Runner(spark, str(tmp_path), failing_at(10, 99), DeadLetters("dead", max_retries=2), hooks=hooks)
    runner.batch(rows(spark, 0, range(30)), 1)
    runner.drain()
    assert sorted(r.offset for r in runner.processed().collect()) == [o for o in range(30) if o != 10]
    assert [(r.topic, r.value, r.source_offset) for r in runner.dead_letters().collect()] == [("dead", "10", 10)]
    assert [r.cursor for r in runner.cursors().collect()] == [30]
    assert ended == ["eof"]


def test_draining_does_not_end_while_rows_are_held(spark, tmp_path):
    ended = []
    runner = Runner(spark, str(tmp_path), failing_at(1, 3), DeadLetters("dead", max_retries=9), hooks=Hooks(eofed=lambda: ended.append("eof")))
    runner.batch(rows(spark, 0, range(3)), 1)
    with pytest.raises(RuntimeError, match="still held"):
        runner.drain(most=2)
    assert ended == []
    runner.drain()
    assert sorted(r.offset for r in runner.processed().collect()) == [0, 1, 2] and ended == ["eof"]


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), failing_at(-1, 0))
    runner.batch(rows(spark, 0, range(5)), 1)
    runner.batch(rows(spark, 0, range(5)), 1)
    assert runner.processed().count() == 5


def test_seek_back_and_revocation(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), failing_at(2, 99), DeadLetters(), ordered=True)
    runner.batch(rows(spark, 0, range(5)).unionByName(rows(spark, 1, range(3))), 1)
    assert {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 2), (1, 2)}
    runner.seek(spark.createDataFrame([("t", 0, 4)], "topic string, partition int, cursor long"))
    assert {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 4), (1, 2)}
    assert {(r.partition, r.offset) for r in runner.held().collect()} == {(0, 4), (1, 2)}
    lost = spark.createDataFrame([("t", 1)], "topic string, partition int")
    runner.revoke(lost)
    assert {(r.partition, r.offset, r.attempts) for r in runner.held().collect()} == {(0, 4, 0), (1, 2, 0)}


# --------------------------------------------------------------------------- restarts


def passing(df):
    return df.withColumn("failed", F.lit(False)).withColumn("error_class", F.lit(None).cast("string"))


def offsets(df):
    return sorted(r.offset for r in df.collect())


class Gone(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
@pytest.mark.parametrize("batch", [1, 2])
def test_a_consumer_that_dies_at_any_step_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step, batch):
    runner = Runner(spark, str(tmp_path), failing_at(3, 1), DeadLetters("dead", max_retries=2), Pause(1), ordered=False)
    given = {1: rows(spark, 0, range(5)), 2: rows(spark, 0, range(5, 8))}
    if batch == 2:
        runner.batch(given[1], 1)
    steps = [0]

    def dying(f, after):
        def g(*args, **kwargs):
            steps[0] += 1
            if steps[0] == step + 1 and not after:
                raise Gone
            out = f(*args, **kwargs)
            if steps[0] == step + 1:
                raise Gone
            return out

        return g

    # the writes of a round, before and after each, and the commit
    monkeypatch.setattr(runner, "_write", dying(runner._write, after=step % 2 == 1))
    monkeypatch.setattr(runner.files, "write", dying(runner.files.write, after=step == 3))
    with pytest.raises(Gone):
        runner.batch(given[batch], batch)
        runner.batch(None)
    again = Runner(spark, str(tmp_path), failing_at(3, 1), DeadLetters("dead", max_retries=2), Pause(1), ordered=False)
    for number in (1, 2):
        again.batch(given[number], number)
    again.drain()
    assert offsets(again.processed()) == list(range(8))
    assert [r.cursor for r in again.cursors().collect()] == [8]


def test_held_rows_and_cursors_survive(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), failing_at(3, 1), DeadLetters("dead", max_retries=2))
    runner.batch(rows(spark, 0, range(6)), 0)
    again = Runner(spark, str(tmp_path), failing_at(3, 1), DeadLetters("dead", max_retries=2))
    assert offsets(again.held()) == [3, 4, 5] and [r.cursor for r in again.cursors().collect()] == [3]
    again.batch(rows(spark, 0, range(6)), 0)  # delivered again
    again.batch(rows(spark, 0, [6]), 1)
    again.drain()
    assert offsets(again.processed()) == list(range(7)) and [r.cursor for r in again.cursors().collect()] == [7]


# --------------------------------------------------------------------------- a live stream


class Live:
    """A stream of files that grows."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, f"{path}/log", 0

    def add(self, partition, offsets):
        rows(self.spark, partition, offsets).coalesce(1).write.mode("append").parquet(self.path)

    @property
    def stream(self):
        return self.spark.readStream.schema(LOG_SCHEMA).parquet(self.path)

    @property
    def log(self):
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)


def cursors(spark, *rows_):
    return spark.createDataFrame(list(rows_), "topic string, partition int, cursor long")


def test_seek_both_ways_in_a_live_stream(spark, tmp_path):
    live, ended = Live(spark, tmp_path), []
    runner = Runner(spark, str(tmp_path / "state"), passing, hooks=Hooks(eofed=lambda: ended.append(1)))
    live.add(0, range(4))
    assert runner.run(live.stream) and ended == [1]
    assert not runner.seek(cursors(spark, ("t", 0, 4)))  # already there: no round
    with pytest.raises(ValueError, match="log"):
        runner.seek(cursors(spark, ("t", 0, 1)))
    assert runner.seek(cursors(spark, ("t", 0, 1)), live.log)
    live.add(0, [4, 5])
    runner.run(live.stream)
    assert offsets(runner.processed()) == [0, 1, 1, 2, 2, 3, 3, 4, 5]
    runner.seek(cursors(spark, ("t", 0, 8)))
    live.add(0, range(6, 10))
    runner.run(live.stream)
    assert offsets(runner.processed()) == [0, 1, 1, 2, 2, 3, 3, 4, 5, 8, 9]
    assert [r.cursor for r in runner.cursors().collect()] == [10]


def test_quiet_keeps_what_comes(spark, tmp_path):
    live, ended = Live(spark, tmp_path), []
    runner = Runner(spark, str(tmp_path / "state"), passing, hooks=Hooks(shutdown=lambda: ended.append(1)))
    live.add(0, range(3))
    query = runner.start(live.stream, available_now=False, every="100 milliseconds")
    query.processAllAvailable()
    assert runner.quieten(query) and not ended
    live.add(0, [3, 4])
    with pytest.raises(Exception, match="nothing new"):
        runner.batch(rows(spark, 0, [99]), 99)
    live.add(0, [5])
    assert runner.run(live.stream, seconds=0.5, every="100 milliseconds") and ended == [1]
    runner.run(live.stream)
    assert offsets(runner.processed()) == list(range(6)) and [r.cursor for r in runner.cursors().collect()] == [6]


def test_stopping_waits_for_the_running_round(spark, tmp_path):
    import threading
    import time

    live, begun = Live(spark, tmp_path), threading.Event()

    def slow(df):
        begun.set()
        time.sleep(2)
        return passing(df)

    live.add(0, range(3))
    runner = Runner(spark, str(tmp_path / "state"), slow)
    query = runner.start(live.stream, available_now=False, every="100 milliseconds")
    assert begun.wait(30)
    assert runner.stop(query)
    assert offsets(runner.processed()) == [0, 1, 2]


# --------------------------------------------------------------------------- marks, pauses, revocation


def test_manual_marks(spark, tmp_path):
    def consume(df):
        return passing(df).withColumn("marked", F.col("offset") == 2)

    runner = Runner(spark, str(tmp_path), consume, manual=True)
    runner.batch(rows(spark, 0, range(5)).unionByName(rows(spark, 1, range(2))), 0)
    assert {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 3)}
    assert runner.mark("t", 0, 4) and {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 3)}
    assert runner.commit() and {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 5)}
    assert runner.mark("t", 0, 1, sync=True)  # an older one: the cursor goes back
    assert runner.mark("t", 1, 0) and runner.mark("t", 1, 1)  # the last counts
    runner.batch(rows(spark, 0, [7]), 1)
    again = Runner(spark, str(tmp_path), consume, manual=True)
    assert {(r.partition, r.cursor) for r in again.cursors().collect()} == {(0, 2), (1, 2)}
    at = again.round
    assert again.commit() and again.mark("t", 1, 1, sync=True) and again.round == at  # nothing to store
    again.revoke(spark.createDataFrame([("t", 1)], "topic string, partition int"))
    assert not again.mark("t", 1, 5)
    assert {(r.partition, r.cursor) for r in again.cursors().collect()} == {(0, 2), (1, 2)}


def test_dead_letters_mark_as_they_are_told(spark, tmp_path):
    for marks, want in ((None, set()), (True, {3}), (False, set())):
        runner = Runner(spark, str(tmp_path / str(marks)), failing_at(2, 9), DeadLetters("dead", max_retries=0, mark_after_dispatch=marks), manual=True)
        runner.batch(rows(spark, 0, range(3)), 0)
        assert {r.cursor for r in runner.cursors().collect()} == want
    runner = Runner(spark, str(tmp_path / "auto"), failing_at(2, 9), DeadLetters("dead", max_retries=0, mark_after_dispatch=False))
    runner.batch(rows(spark, 0, range(3)), 0)
    assert {r.cursor for r in runner.cursors().collect()} == {2}


def test_hold_and_resume(spark, tmp_path, clock):
    now, tell = clock
    runner = Runner(spark, str(tmp_path), passing, clock=tell)
    runner.hold([("t", 0)])
    runner.hold([("t", 1)], timeout_ms=5)
    for p in (0, 1, 2):
        runner.batch(rows(spark, p, range(2)), p)
    assert {r.partition for r in runner.processed().collect()} == {2}
    now[0] += 5000
    runner.batch(None)
    assert {r.partition for r in runner.processed().collect()} == {1, 2}
    runner.resume([("t", 0)])
    runner.batch(None)
    assert {(r.partition, r.cursor) for r in runner.cursors().collect()} == {(0, 2), (1, 2), (2, 2)}


def test_revoked_rows_wait_until_the_partition_comes_back(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), failing_at(1, 2), DeadLetters("dead", max_retries=5), Pause(0))
    runner.batch(rows(spark, 0, range(3)), 0)
    part = spark.createDataFrame([("t", 0)], "topic string, partition int")
    runner.revoke(part)
    runner.batch(rows(spark, 0, [3]), 1)
    assert offsets(runner.processed()) == [0] and {r.attempts for r in runner.held().collect()} == {0}
    runner.assign(part)
    runner.drain()
    assert sorted((r.offset, r.attempts) for r in runner.processed().collect()) == [(0, 1), (1, 3), (2, 3), (3, 3)]  # one counter for the partition


@pytest.mark.parametrize("independent", [True, False])
def test_attempts_are_counted_as_by_the_simulation(spark, tmp_path, independent):
    from tidelog.operators.failures import dispatched, shared_attempts

    fails = {1: 2, 2: 2, 3: 1, 4: 9, 6: 3, 7: 1, 8: 3}
    table = F.create_map(*(F.lit(x) for pair in fails.items() for x in pair))

    def consume(df):  # a message fails as often as it is said to, whatever the counter says
        left = F.coalesce(table[F.col("offset").cast("int")], F.lit(0)) - F.coalesce(tries[0], F.lit(0))
        return df.withColumn("failed", left > 0).withColumn("error_class", F.lit("E"))

    tries, seen = [F.lit(0)], {}
    runner = Runner(spark, str(tmp_path), consume, DeadLetters("dead", max_retries=3, independent=independent), Pause(0))
    first = rows(spark, 0, range(10))
    for turn in range(40):
        pairs = [x for o, n in seen.items() for x in (F.lit(o), F.lit(n))]
        tries[0] = F.create_map(*pairs)[F.col("offset").cast("int")] if pairs else F.lit(0)
        runner.batch(first if turn == 0 else None, turn if turn == 0 else None)
        failed = [r.offset for r in runner._outcomes().filter(f"round = {runner.round} and decision in ('retry', 'dispatch')").collect()]
        for o in failed:
            seen[o] = seen.get(o, 0) + 1
        if not runner.held().take(1):
            break
    config = runner.dead
    messages = spark.createDataFrame([("t", 0, 0, o, fails.get(o, 0), "E") for o in range(10)], "topic string, partition int, batch long, offset long, fails_for int, error_class string")
    want = dispatched(messages, config) if independent else shared_attempts(messages, config)
    assert sorted(r.source_offset for r in runner.dead_letters().collect()) == sorted(r.offset for r in want.collect())
    assert offsets(runner.processed()) == sorted(set(range(10)) - {r.offset for r in want.collect()})


def test_stream_seek_equals_its_sql_in_a_log_longer_than_the_offset_sought(spark, tmp_path, monkeypatch):
    import duckdb

    from tidelog.streaming import queries

    last, where = 10**6 + 20, f"{tmp_path}/events.parquet"
    ids = spark.range(last + 30).select(F.col("id").alias("event_id"), F.when(F.col("id") < last, 1).otherwise(4).cast("long").alias("user_id"))
    ids.select("*", F.timestamp_seconds("event_id").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(where)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{where}/*.parquet')")
    counts, runners = queries._counts, []
    monkeypatch.setattr(queries, "_counts", lambda runner: runners.append(runner) or counts(runner))
    columns = ["partition", "deliveries", "messages", "cursor"]
    got = queries.stream_seek(spark, str(tmp_path)).select(*columns).orderBy("partition").collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['stream_seek']}) ORDER BY partition").fetchall()
    assert [tuple(r) for r in got] == want == [(0, 50, 30, 30), (1, last, last, 10**6)]
    assert offsets(runners[0].held()) == list(range(10**6, last))  # partition 1 is paused: they wait, none is lost
    runners[0].resume([("events", 1)])
    runners[0].drain()
    assert [tuple(r) for r in counts(runners[0]).select(*columns).orderBy("partition").collect()] == [(0, 50, 30, 30), (1, last + 20, last, last)]
