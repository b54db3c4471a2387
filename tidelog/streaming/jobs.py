"""Background jobs as a log topic: dispatched as rows, executed batch by batch; and queries that are kept running."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def as_messages(jobs: DataFrame) -> DataFrame:
    """Rows to append to the job topics: the queue names the topic, the job travels as JSON."""
    return jobs.select(F.col("queue").alias("topic"), F.lit(None).cast("string").alias("key"), F.to_json(F.struct(*(c for c in jobs.columns if c != "queue"))).alias("value"))


def job_consumer(run: Callable[[DataFrame], DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A consume function for :class:`tidelog.streaming.runner.Runner` that parses jobs and runs them.

    ``run`` gets rows with a ``job`` struct and adds ``failed`` and ``error_class``; each job is
    retried, marked or dead-lettered by itself.
    """

    def consume(rows: DataFrame) -> DataFrame:
        return run(rows.withColumn("job", F.from_json("value", schema, {"mode": "FAILFAST"}))).drop("job")

    return consume


def keep_running(start: Callable[[], StreamingQuery], restarts: int | None = None, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Start a query and, when it fails, wait and start it again; returns how often it was restarted.

    Ends when the query ends by itself. With ``restarts`` the failure after the last one is raised.
    """
    again = 0
    while True:
        try:
            start().awaitTermination()
            return again
        except Exception:
            if restarts is not None and again >= restarts:
                raise
            again += 1
            sleep(wait)
