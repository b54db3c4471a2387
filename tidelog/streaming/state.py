"""State that outlives a micro-batch, and events of running queries."""

from __future__ import annotations

import logging
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

TOTALS = "topic string, partition int, messages long, last_offset long"


def running_totals(stream: DataFrame) -> DataFrame:
    """Messages and last offset so far of each (topic, partition), in Spark's own aggregation state; for update mode."""
    return stream.groupBy("topic", "partition").agg(F.count("*").alias("messages"), F.max("offset").alias("last_offset"))


class EventLog(StreamingQueryListener):
    """Named events of streaming queries: the last ``most`` as rows, and all of them to a logger if one is given."""

    def __init__(self, logger: logging.Logger | None = None, most: int = 10_000) -> None:
        self.rows: deque[tuple[str, str, str]] = deque(maxlen=most)
        self.logger = logger

    def _add(self, name: str, query: object, detail: str = "") -> None:
        self.rows.append((name, str(query), detail))
        if self.logger is not None:
            failed = name == "query.stopped" and detail
            self.logger.log(logging.ERROR if failed else logging.INFO, "%s %s %s", name, query, detail)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add("query.started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._add("batch.consumed", event.progress.id, str(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add("query.idle", event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add("query.stopped", event.id, event.exception or "")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "name string, query string, detail string")
