"""Retry and dead-letter routing of a recorded log, as data: what a consumer would have done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.retry import CRITICAL, DeadLetters, Pause, decision, retrying


def attempts(messages: DataFrame, config: DeadLetters, pause: Pause = Pause()) -> DataFrame:
    """Every execution of messages that fail (topic, partition, offset, fails_for, error_class), each with its own retries.

    A message fails ``fails_for`` times and then succeeds. One row an attempt: its number, whether
    it failed, the decision, and the wait that follows in milliseconds; after a dispatch the
    counter is 0 again, so that wait is the plain timeout. A critical error is retried until it
    passes, never dead-lettered.
    """
    critical = F.col("error_class").isin(*CRITICAL)
    last = F.when(critical, F.col("fails_for") + 1).otherwise(F.least(F.col("fails_for"), F.lit(config.max_retries)) + 1)
    rows = messages.filter("fails_for > 0").withColumn("attempt", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    failed = F.col("attempt") <= F.col("fails_for")
    what = decision(failed, F.coalesce("error_class", F.lit("")), F.col("attempt"), F.lit(config.max_retries))
    rows = rows.withColumn("failed", failed).withColumn("decision", what).withColumn("retrying", retrying(F.col("attempt")))
    wait = F.when(~F.col("failed"), F.lit(0)).when(F.col("decision") == "dispatch", pause.wait(F.lit(0))).otherwise(pause.wait(F.col("attempt")))
    return rows.withColumn("wait_ms", wait.cast("long"))


def shared_attempts(messages: DataFrame, config: DeadLetters) -> DataFrame:
    """Dispatched offsets of each batch (topic, partition, batch) when its messages share one counter.

    Without the independent mode only a finished batch or a dispatch sets the counter back, so
    failures of earlier messages use up the retries of later ones. Folded over a batch's failing
    messages in order; a batch is bounded by what one poll returns.
    """
    failing = F.array_sort(F.collect_list(F.when(F.col("fails_for") > 0, F.struct("offset", "fails_for", F.col("error_class").isin(*CRITICAL).alias("critical")))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("dead"))

    def step(state, m):
        total = state["used"] + m["fails_for"]
        dead = ~F.coalesce(m["critical"], F.lit(False)) & (total > config.max_retries)
        return F.struct(F.when(dead, F.lit(0)).otherwise(total).cast("long").alias("used"), F.when(dead, F.concat(state["dead"], F.array(m["offset"]))).otherwise(state["dead"]).alias("dead"))

    rows = messages.groupBy("topic", "partition", "batch").agg(failing.alias("f"))
    return rows.select("topic", "partition", "batch", F.explode(F.aggregate("f", start, step)["dead"]).alias("offset"))


def dispatched(messages: DataFrame, config: DeadLetters) -> DataFrame:
    """Messages that go to the dead-letter topic, each with retries of its own: failures outnumber the retries and aren't critical."""
    return messages.filter((F.col("fails_for") > config.max_retries) & ~F.coalesce(F.col("error_class").isin(*CRITICAL), F.lit(False)))


def dead_letters(messages: DataFrame, config: DeadLetters, extra: bool = False) -> DataFrame:
    """Rows of the dead-letter topic: the raw payload alone, or with key and origin too. Nothing for ``topic=False``."""
    rows = dispatched(messages, config) if config.topic else messages.limit(0)
    out = [F.lit(config.topic or None).cast("string").alias("topic"), F.col("value")]
    if extra:
        out += [F.col("key"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset")]
    return rows.select(*out)


def skippable(batch: DataFrame, cursors: DataFrame) -> DataFrame:
    """The message to skip in each batch: that at the marked cursor if the batch has it, else the first."""
    rows = batch.join(cursors, ["topic", "partition"], "left")
    at_cursor = F.min(F.when(F.col("offset") == F.col("cursor"), F.col("offset")))
    return rows.groupBy("topic", "partition", "batch").agg(F.coalesce(at_cursor, F.min("offset")).alias("offset"))


def final_cursors(messages: DataFrame, config: DeadLetters, manual: bool = False) -> DataFrame:
    """Committed cursor of each partition once everything was processed or dead-lettered.

    In manual mode nothing is marked but what dead-lettering marks.
    """
    if manual:
        rows = dispatched(messages, config) if config.marks(manual) else messages.limit(0)
    else:
        rows = messages
    return rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("cursor"))


def dispatch_jobs(jobs: DataFrame, now_us: int) -> DataFrame:
    """Where jobs (job_id, queue, method, run_at_us) go: at once when due, else they are refused, as later runs need a scheduler."""
    due = F.col("run_at_us").isNull() | (F.col("run_at_us") <= now_us)
    return jobs.select("job_id", F.col("queue").alias("topic"), F.coalesce("method", F.lit("produce_async")).alias("method"), F.when(due, "dispatched").otherwise("not_implemented").alias("outcome"))
