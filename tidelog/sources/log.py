"""The canonical log: one row a message, addressed by (topic, partition, offset).

Columns: topic string, partition int, offset long, timestamp timestamp_ntz, key string, value
string, headers map<string, array<string>>, and whatever else the source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "topic string, partition int, offset long, timestamp timestamp_ntz, key string, value string, headers map<string, array<string>>, received_at timestamp_ntz"
EVENT_LOG = "topic string, partition int, offset long, timestamp timestamp_ntz, key string, value string, event_id long, event_type string, amount double"
PARTITIONS = 4
_CHUNK = 1 << 16


def numbered(rows: DataFrame, by: list[str], order: str, name: str, chunk: int = _CHUNK) -> DataFrame:
    """Number the rows of each group from 0 in the order of an integer column, without one task a group.

    A group is cut into ranges of ``chunk`` values of ``order``. Ranges are counted first, with
    partial sums, and the counts before each range are added to the number within it; rows and
    counts are dealt by the same keys, so a group of any size is spread over many tasks.
    """
    rows = rows.withColumn("__range", F.floor(F.col(order) / chunk))
    keys = [*by, "__range"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("__within", within).join(sizes, keys).withColumn(name, (F.col("__within") + F.col("__before")).cast("long")).drop("__range", "__within", "__before")


def from_events(events: DataFrame, topic: str | Column = "events", partitions: int = PARTITIONS) -> DataFrame:
    """The log that the ``events`` table stands for: dense offsets by event_id in partitions by user.

    Every 97th event is a tombstone. The source's event_id, event_type and amount stay as columns.
    """
    name = F.lit(topic) if isinstance(topic, str) else topic
    rows = events.select(
        name.alias("topic"),
        F.pmod(F.col("user_id"), F.lit(partitions)).cast("int").alias("partition"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_id") % 97 != 0, F.col("props")).alias("value"),
        "event_id",
        "event_type",
        F.col("value").alias("amount"),
    )
    return numbered(rows, ["topic", "partition"], "event_id", "offset")


def read_recorded(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """A recorded log: Parquet laid out by topic and partition, so that both prune files and offsets are pushed down."""
    return spark.read.schema(schema).parquet(path).select(*(c.split()[0] for c in schema.replace("map<string, array<string>>", "map").split(", ")))


def write_recorded(log: DataFrame, path: str) -> None:
    """Record a log, sorted by offset within its files so that their statistics prune offset ranges."""
    log.repartition("topic", "partition", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("topic", "partition", "offset").write.mode("append").partitionBy("topic", "partition").parquet(path)


def micros(column: str = "timestamp") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def millis(column: str = "timestamp") -> Column:
    return F.floor(micros(column) / 1000).cast("long")
