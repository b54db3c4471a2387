"""Continuous consumption: a stream's micro-batches go to a function, with retries, dead letters and cursors.

State lives in tables under one folder. A round writes its rows with what was decided about them
(``outcomes``), what is known of each partition (``state``), and last of all a small file
(``commits``) that makes both count. Opened again, a folder goes on behind its last commit: what a
round left half written is removed, and a micro-batch that was committed isn't taken twice. What
the user's function does outside may repeat, as delivery is at least once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from time import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.retry import DeadLetters, Pause, decision
from tidelog.functions.strategies import select
from tidelog.sources.log import LOG_SCHEMA
from tidelog.stage import Files

PART = ["topic", "partition"]
LOG = [x.split()[0] for x in LOG_SCHEMA.replace("map<string, array<string>>", "map").split(", ")]
HELD = [*LOG, "attempts", "paused_until_us"]
OUTCOMES = LOG_SCHEMA + ", attempts int, paused_until_us long, attempt int, decision string, marked boolean"
#: top: one behind the last mark; position: one behind the furthest row delivered; floor: earlier rows are skipped.
STATE = "topic string, partition int, cursor long, top long, position long, floor long, paused_until_us long, revoked boolean"
FOREVER = (1 << 63) - 1


class Quiet(RuntimeError):
    """A micro-batch came while nothing new is taken; the stream delivers it again when it is started again."""


@dataclass
class Hooks:
    """What a consumer may define besides its function; ``wrap`` surrounds every round."""

    initialized: Callable[[], None] = lambda: None
    eofed: Callable[[], None] = lambda: None
    revoked: Callable[[DataFrame], None] = lambda partitions: None
    shutdown: Callable[[], None] = lambda: None
    wrap: Callable[[str], AbstractContextManager] = lambda action: nullcontext()


@dataclass
class Runner:
    """Runs ``consume`` over a stream of log rows.

    ``consume`` gets the round's rows with their ``attempt`` and returns them with ``failed``
    (boolean) and ``error_class``. A failed row waits (``paused_until_us``, from ``pause``) and is
    delivered again, until it passes or its retries are used up and its payload goes to the dead
    letters. With ``ordered`` the rows behind a partition's first failure are held too, so that a
    partition is consumed strictly in order, and, unless the dead letters are ``independent``, its
    rows share one counter of attempts until one is dead-lettered or none is held. Without
    ``ordered`` other rows go on, only failed ones wait, and each counts for itself.

    Cursors are one behind the last row that was marked: without ``manual`` every row that passed
    or was dead-lettered, up to the first that is still held. With ``manual`` rows that ``consume``
    returns with ``marked`` true, and what :meth:`mark` says; then the cursor is where the last
    mark put it, also further back.
    """

    spark: SparkSession
    folder: str
    consume: Callable[[DataFrame], DataFrame]
    dead: DeadLetters = field(default_factory=DeadLetters)
    pause: Pause = field(default_factory=Pause)
    ordered: bool = True
    manual: bool = False
    hooks: Hooks = field(default_factory=Hooks)
    clock: Callable[[], int] = lambda: int(time() * 1e6)

    def __post_init__(self) -> None:
        self.files, self.quiet, self._busy = Files(self.spark, self.folder), False, threading.RLock()
        self._marks: dict[tuple[str, int], int] = {}
        done = [int(x) for x in self.files.names("commits") if x.isdigit()]
        known = json.loads(self.files.read(f"commits/{max(done)}")) if done else {}
        self.round, self.last_batch = known.get("round", 0), known.get("batch", -1)
        self._held_round, self._state_round = known.get("held", 0), known.get("state", 0)
        for table in ("outcomes", "state"):  # what a round left half written
            for name in self.files.names(table):
                if name.startswith("round=") and int(name[6:]) > self.round:
                    self.files.delete(f"{table}/{name}")

    @classmethod
    def of(cls, features: Iterable[str], spark: SparkSession, folder: str, consume: Callable[[DataFrame], DataFrame], dead: DeadLetters | None = None, **settings: object) -> Runner:
        """A consumer that follows the rules of its topic's features (see :func:`tidelog.functions.strategies.select`).

        Without automatic marking it is manual, dead letters need their feature and a setting, and
        jobs are run, retried and marked each by itself.
        """
        rules = select(*features)
        if rules.dispatches != (dead is not None and dead.active):
            raise ValueError(f"strategy {rules.name} {'needs' if rules.dispatches else 'has no'} dead letters")
        return cls(spark, folder, consume, dead or DeadLetters(), manual=not (rules.marks or rules.each), ordered=not rules.each, **settings)

    # ----------------------------------------------------------------------- tables

    def _table(self, table: str, schema: str, number: int) -> DataFrame:
        if number < 1:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/round={number}")

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/round={number}")

    def _commit(self, number: int, batch: int | None, held: bool) -> None:
        """From here on the round counts."""
        what = {"round": number, "batch": self.last_batch if batch is None else batch, "held": number if held else self._held_round, "state": number}
        self.files.write(f"commits/{number}", json.dumps(what))
        self.round, self.last_batch, self._held_round, self._state_round = what["round"], what["batch"], what["held"], what["state"]
        self.files.delete(f"commits/{number - 2}")

    def _next(self) -> int:
        """The next round's number; what an attempt at it that failed has left goes."""
        for table in ("outcomes", "state"):
            self.files.delete(f"{table}/round={self.round + 1}")
        return self.round + 1

    def held(self) -> DataFrame:
        """Rows that wait for a next delivery."""
        return self._table("outcomes", OUTCOMES, self._held_round).filter("decision in ('retry', 'hold', 'wait')").select(*HELD)

    def state(self) -> DataFrame:
        return self._table("state", STATE, self._state_round)

    def cursors(self) -> DataFrame:
        return self.state().filter("cursor is not null").select(*PART, "cursor")

    def _outcomes(self) -> DataFrame:
        schema = OUTCOMES + ", round int"
        if not self._held_round:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/outcomes").filter(F.col("round") <= self.round)

    def processed(self) -> DataFrame:
        """Rows that passed, with the number of attempts it took."""
        return self._outcomes().filter("decision = 'mark'").select(*LOG, F.col("attempt").alias("attempts"), "round")

    def dead_letters(self) -> DataFrame:
        rows = self._outcomes().filter("decision = 'dispatch'" if isinstance(self.dead.topic, str) else "false")
        return rows.select(F.lit(self.dead.topic or None).cast("string").alias("topic"), "value", F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), "round")

    # ----------------------------------------------------------------------- rounds

    def batch(self, rows: DataFrame | None, number: int | None = None) -> None:
        """One round: new rows and those whose pause is over. ``number`` is that of the stream's micro-batch."""
        if self.quiet and number is not None:
            raise Quiet("nothing new is taken")
        with self._busy:
            if number is not None and number <= self.last_batch:  # committed already, delivered again
                return
            with self.hooks.wrap("consume"):
                self._round(rows, number)

    def _round(self, rows: DataFrame | None, batch: int | None) -> None:
        number, now, state = self._next(), F.lit(self.clock()), self.state()
        held, new = self.held(), None
        if rows is not None:
            new = rows.select(*LOG).join(state.select(*PART, "floor"), PART, "left").filter("floor is null or offset >= floor").drop("floor")
            held = held.unionByName(new.withColumn("attempts", F.lit(0)).withColumn("paused_until_us", F.lit(0).cast("long")))
        gates = state.select(*PART, F.greatest(F.coalesce("paused_until_us", F.lit(0)), F.when(F.col("revoked"), F.lit(FOREVER))).alias("gate"))
        held = held.join(gates, PART, "left").withColumn("gate", F.greatest("gate", "paused_until_us"))
        own = Window.partitionBy(*PART)  # what is consumed in order is one task's for each partition
        shared = self.ordered and not self.dead.independent
        if self.ordered:  # a paused row holds back its partition
            held = held.withColumn("gate", F.max("gate").over(own))
        held = held.withColumn("ready", F.col("gate") <= now).drop("gate")
        held = held.withColumn("attempt", (F.max("attempts").over(own) if shared else F.col("attempts")) + 1)
        done = self.consume(held.filter("ready").drop("ready"))
        if "marked" not in done.columns:
            done = done.withColumn("marked", F.lit(False))
        behind = F.lit(False)
        if self.ordered:
            done = done.withColumn("first", F.min(F.when(F.col("failed"), F.struct("offset", "attempt", "error_class"))).over(own))
            behind = F.coalesce(F.col("offset") > F.col("first.offset"), F.lit(False))
        limit = F.lit(self.dead.max_retries if self.dead.active else 2**31 - 1)
        judged = lambda failed, error, attempt: decision(failed, F.coalesce(error, F.lit("")), attempt, limit)
        done = done.withColumn("decision", F.when(behind, "hold").otherwise(judged(F.col("failed"), F.col("error_class"), F.col("attempt"))))
        retry, counted = F.col("decision") == "retry", F.col("attempts")
        if shared:  # rows held behind a failure share its counter, which a dispatch sets back
            again = judged(F.lit(True), F.col("first.error_class"), F.col("first.attempt")) == "retry"
            counted = F.when(F.col("decision") == "hold", F.when(again, F.col("first.attempt")).otherwise(0)).otherwise(counted)
        done = done.withColumn("attempts", F.when(retry, F.col("attempt")).otherwise(counted).cast("int"))
        done = done.withColumn("paused_until_us", F.when(retry, now + self.pause.wait(F.col("attempt")) * 1000).otherwise(F.lit(0)).cast("long"))
        waiting = held.filter("not ready").withColumn("decision", F.lit("wait")).withColumn("marked", F.lit(False))
        columns = [*HELD, "attempt", "decision", "marked"]
        self._write(done.select(*columns).unionByName(waiting.select(*columns)), "outcomes", number)
        self._write(self._reached(state, number, new), "state", number)
        self._commit(number, batch, held=True)
        self._marks.clear()

    def _reached(self, state: DataFrame, number: int, new: DataFrame | None) -> DataFrame:
        """What is known of each partition after a round."""
        done = self._table("outcomes", OUTCOMES, number)
        passed, dead = F.col("decision") == "mark", F.col("decision") == "dispatch"
        marked = (F.col("marked") & ~F.col("decision").isin("hold", "wait")) if self.manual else passed
        if self.dead.marks(self.manual):
            marked = marked | dead
        lowest = F.min(F.when(F.col("decision").isin("retry", "hold", "wait"), F.col("offset")))
        round_ = done.groupBy(*PART).agg((F.max(F.when(marked, F.col("offset"))) + 1).alias("now"), lowest.alias("lowest"), (F.max("offset") + 1).alias("seen"))
        rows = state.join(round_, PART, "full").join(self._said(), PART, "left")
        # without manual marks the furthest counts, and the cursor stops at the first row that waits
        top = F.coalesce("said", "now", "top") if self.manual else F.coalesce("said", F.greatest("top", "now"))
        cursor = F.col("top") if self.manual else F.when(F.col("said").isNotNull(), F.col("top")).otherwise(F.least("top", "lowest"))
        return rows.withColumn("top", top).select(*PART, cursor.alias("cursor"), "top", F.greatest("position", "seen").alias("position"), "floor", "paused_until_us", F.coalesce("revoked", F.lit(False)).alias("revoked"))

    def _said(self) -> DataFrame:
        return self.spark.createDataFrame([(t, p, o) for (t, p), o in self._marks.items()], "topic string, partition int, said long")

    def start(self, stream: DataFrame, available_now: bool = True, every: str = "5 seconds") -> StreamingQuery:
        """Consume a stream; by default what is there now, to its end. A stopped or failed run goes on where it was."""
        self.quiet = False
        if not self.files.exists("checkpoint"):  # a stream from its beginning numbers its batches anew
            self.last_batch = -1
        self.hooks.initialized()
        writer = stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda rows, number: self.batch(rows, number))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

    def run(self, stream: DataFrame, seconds: float | None = None, every: str = "1 second") -> bool:
        """Consume what is there now; with ``seconds``, consume for that long and stop. Whether it ended in time."""
        query = self.start(stream, available_now=seconds is None, every=every)
        if seconds is None:
            query.awaitTermination()
            self.hooks.eofed()
            return True
        query.awaitTermination(seconds)
        return self.stop(query)

    def drain(self, most: int = 100) -> int:
        """Deliver held rows until none is left, as if their pauses were over; the rounds that took.

        Raises if rows are still held after ``most`` rounds.
        """
        clock, rounds, late = self.clock, 0, 0
        while rounds < most and self.held().take(1):
            late += 2 * self.pause.max_timeout * 1000
            self.clock = lambda: clock() + late  # noqa: B023
            self.batch(None)
            rounds += 1
        self.clock = clock
        if rounds >= most and self.held().take(1):
            raise RuntimeError(f"rows are still held after {rounds} rounds")
        self.hooks.eofed()
        return rounds

    # ----------------------------------------------------------------------- what the user asks for

    def mark(self, topic: str, partition: int, offset: int, sync: bool = False) -> bool:
        """Mark a message as consumed; the cursor goes behind it with the next round, or at once with ``sync``.

        False for a partition that was taken away; true, and nothing is stored, where the cursor is already.
        """
        with self._busy:
            known = self.state().filter((F.col("topic") == topic) & (F.col("partition") == partition)).first()
            if known is not None and known.revoked:
                return False
            at = self._marks.get((topic, partition), known.cursor if known is not None else None)
            if at != offset + 1:
                self._marks[topic, partition] = offset + 1
            return self.commit() if sync else True

    def commit(self) -> bool:
        """Make the marks so far count now; true also if there were none. Marks of partitions taken away since don't, and give false."""
        with self._busy:
            if not self._marks:
                return True
            number, state, said = self._next(), self.state(), self._said()
            lost = state.filter("revoked").join(said, PART, "left_semi").select(*PART)
            lost_any = bool(lost.take(1))
            rows = state.join(said.join(lost, PART, "left_anti"), PART, "full")
            at = lambda name: F.coalesce("said", name).alias(name)
            self._write(rows.select(*PART, at("cursor"), at("top"), "position", "floor", "paused_until_us", F.coalesce("revoked", F.lit(False)).alias("revoked")), "state", number)
            self._commit(number, None, held=False)
            self._marks.clear()
            return not lost_any

    def _change(self, partitions: DataFrame, **columns: Column) -> None:
        """Set columns of the state of some partitions, in a round of its own."""
        number = self._next()
        keys = partitions.select(*PART).distinct().withColumn("asked", F.lit(True))
        rows = self.state().join(keys, PART, "full").withColumn("revoked", F.coalesce("revoked", F.lit(False)))
        for name, value in columns.items():
            rows = rows.withColumn(name, F.when(F.col("asked"), value).otherwise(F.col(name)))
        self._write(rows.drop("asked"), "state", number)
        self._commit(number, None, held=False)

    def _parts(self, partitions: DataFrame | Iterable[tuple[str, int]]) -> DataFrame:
        return partitions if isinstance(partitions, DataFrame) else self.spark.createDataFrame(list(partitions), "topic string, partition int")

    def hold(self, partitions: DataFrame | Iterable[tuple[str, int]], timeout_ms: int | None = None) -> None:
        """Pause partitions: their rows wait, for ``timeout_ms`` or until :meth:`resume`."""
        with self._busy:
            self._change(self._parts(partitions), paused_until_us=F.lit(FOREVER if timeout_ms is None else self.clock() + timeout_ms * 1000))

    def resume(self, partitions: DataFrame | Iterable[tuple[str, int]]) -> None:
        with self._busy:
            self._change(self._parts(partitions), paused_until_us=F.lit(None).cast("long"))

    def seek(self, cursors: DataFrame, log: DataFrame | None = None) -> bool:
        """Go on from other cursors (topic, partition, cursor); false, and nothing changes, where they are already.

        Rows from the new cursor on that were delivered before are delivered again, out of ``log``;
        rows before it are skipped, those that the stream has yet to bring too. Attempts start anew.
        Going back without ``log`` is an error.
        """
        with self._busy:
            moved = cursors.select(*PART, F.col("cursor").alias("to"))
            held = self.held()
            known = moved.join(self.state(), PART, "left").join(held.groupBy(*PART).agg(F.min("offset").alias("lowest")), PART, "left")
            if not known.filter("cursor is null or to <> cursor or lowest is not null").take(1):
                return False
            if log is None and known.filter("to < least(position, coalesce(lowest, position))").take(1):
                raise ValueError("rows that were consumed come again from the log only: give it")
            number = self._next()
            positions = moved.join(self.state().select(*PART, "position"), PART, "left")
            rest = held.join(moved, PART, "left_anti")
            if log is None:
                again = held.join(positions, PART).filter("offset >= to")
            else:
                again = log.join(positions, PART).filter("offset >= to and offset < position")
            again = again.select(*LOG, F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("paused_until_us"))
            rows = rest.unionByName(again).withColumn("attempt", F.lit(None).cast("int")).withColumn("decision", F.lit("wait")).withColumn("marked", F.lit(False))
            self._write(rows, "outcomes", number)
            state = self.state().join(moved, PART, "full").withColumn("floor", F.when(F.col("to").isNotNull(), F.when(F.col("to") > F.coalesce("position", F.lit(0)), F.col("to"))).otherwise(F.col("floor")))
            at = lambda name: F.coalesce("to", name).alias(name)
            self._write(state.select(*PART, at("cursor"), at("top"), "position", "floor", "paused_until_us", F.coalesce("revoked", F.lit(False)).alias("revoked")), "state", number)
            self._commit(number, None, held=True)
            return True

    def revoke(self, partitions: DataFrame) -> None:
        """Partitions went to another consumer: their rows wait, with attempts set back, until :meth:`assign`; marks of them fail."""
        with self._busy:
            number, lost = self._next(), partitions.select(*PART).distinct().withColumn("lost", F.lit(True))
            rows = self.held().join(lost, PART, "left").withColumn("attempts", F.when(F.col("lost"), F.lit(0)).otherwise(F.col("attempts"))).drop("lost")
            self._write(rows.withColumn("attempt", F.lit(None).cast("int")).withColumn("decision", F.lit("wait")).withColumn("marked", F.lit(False)), "outcomes", number)
            state = self.state().join(lost, PART, "full").withColumn("revoked", F.coalesce("lost", "revoked", F.lit(False))).drop("lost")
            self._write(state, "state", number)
            self._commit(number, None, held=True)
            self.hooks.revoked(partitions)

    def assign(self, partitions: DataFrame) -> None:
        """Partitions came back: what waited is delivered."""
        with self._busy:
            self._change(partitions, revoked=F.lit(False))

    def quieten(self, query: StreamingQuery, timeout: float = 60) -> bool:
        """Let the running round end and take nothing new; whether it ended in time. What wasn't taken comes with the next start."""
        self.quiet = True
        ended = self._busy.acquire(timeout=timeout)
        try:
            query.stop()
        finally:
            if ended:
                self._busy.release()
        return ended

    def stop(self, query: StreamingQuery, timeout: float = 60) -> bool:
        """Let the running round end, take nothing new, and shut down; whether the round ended in time."""
        ended = self.quieten(query, timeout)
        self.hooks.shutdown()
        return ended
