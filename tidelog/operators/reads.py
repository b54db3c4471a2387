"""Bounded reads of a log and questions about its offsets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.log import micros


def watermarks(log: DataFrame) -> DataFrame:
    """(topic, partition, low, high): the earliest offset and the one after the last."""
    return log.groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def offset_range(low: int, high: int, count: int, start: int, by_time: bool = False) -> tuple[int, int]:
    """First and last offset of a bounded read; last below first if it is empty.

    A negative start counts back from the end, -1 being the last ``count``; before the beginning it
    means the beginning. A time later than everything (start < 0) reads nothing. What lies outside
    low to high - 1 is cut off, not shifted.
    """
    if start < 0:
        start = high if by_time else high - count - abs(start) + 1
    if start < 0:
        start = low
    return max(start, low), min(start + count - 1, high - 1)


def read_topic(log: DataFrame, topic: str, partition: int, count: int, start: int | datetime = -1) -> DataFrame:
    """At most ``count`` messages of one partition from an offset, from the end, or from a time on, by offset.

    The watermarks (one row) are fetched first, so the read itself is a filter on literals that the
    scan can use.
    """
    part = log.filter((F.col("topic") == topic) & (F.col("partition") == partition))
    by_time = isinstance(start, datetime)
    found = part.agg(F.min("offset"), F.max("offset") + 1, F.min(F.when(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"), F.col("offset"))) if by_time else F.lit(None).cast("long")).first()
    low, high = (found[0], found[1]) if found[0] is not None else (0, 0)
    if by_time:
        start = -1 if found[2] is None else found[2]
    first, last = offset_range(low, high, count, start, by_time)
    return part.filter(F.col("offset").between(first, last)).orderBy("offset")


def offsets_for_times(log: DataFrame, times: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """First offset with a timestamp at or after each (topic, partition, at_us); -1 beyond the end.

    Clocks may run backwards, so this is the least offset of all later messages. The log is reduced
    to the least offset of each hour; messages themselves only meet the times of their own hour.
    """
    bucket = lambda us: F.floor(us / bucket_us).alias("bucket")
    keys = ["topic", "partition", "at_us"]
    asked = times.select(*keys, bucket(F.col("at_us")))
    rows = log.select("topic", "partition", "offset", micros().alias("us"), bucket(micros()))
    hours = rows.groupBy("topic", "partition", "bucket").agg(F.min("offset").alias("offset"))
    later = asked.join(hours.withColumnRenamed("bucket", "hour"), ["topic", "partition"]).filter("hour > bucket").select(*keys, "offset")
    same = asked.join(rows, ["topic", "partition", "bucket"]).filter("us >= at_us").select(*keys, "offset")
    found = later.unionByName(same).groupBy(*keys).agg(F.min("offset").alias("offset"))
    return times.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("offset", F.lit(-1)).alias("offset"))


def partition_offsets(log: DataFrame, specs: DataFrame) -> DataFrame:
    """Answers to (topic, partition, spec, at_us): earliest, latest, max_timestamp, or time with at_us.

    Every spec of a partition is answered from one aggregation of it; (offset, ts_us) are -1 where
    nothing matches, and ts_us where the question isn't about a message.
    """
    newest = F.struct(micros().alias("us"), (-F.col("offset")).alias("back"))
    ends = log.groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"), F.max(newest).alias("newest"))
    timed = offsets_for_times(log, specs.filter("spec = 'time'").select("topic", "partition", "at_us"))
    kind = F.col("spec")
    offset = F.when(kind == "earliest", F.col("low")).when(kind == "latest", F.col("high")).when(kind == "max_timestamp", -F.col("newest.back")).otherwise(F.col("offset"))
    rows = specs.join(ends, ["topic", "partition"], "left").join(timed, ["topic", "partition", "at_us"], "left")
    return rows.select("topic", "partition", "spec", "at_us", F.coalesce(offset, F.lit(-1)).alias("offset"), F.coalesce(F.when(kind == "max_timestamp", F.col("newest.us")), F.lit(-1)).alias("ts_us"))


def last_stable(log: DataFrame) -> DataFrame:
    """(topic, partition, latest, stable) of a log with a ``committed`` flag: read committed ends at the first open message."""
    opened = F.min(F.when(~F.col("committed"), F.col("offset")))
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("latest"), F.coalesce(opened, F.max("offset") + 1).alias("stable"))


def topic_info(partitions: DataFrame, name: str | None = None) -> DataFrame:
    """Partition count and replication factor of each topic, or of one; asking for one that isn't there is a LookupError."""
    if name is not None and not partitions.filter(F.col("topic") == name).take(1):
        raise LookupError(f"unknown topic: {name}")
    rows = partitions if name is None else partitions.filter(F.col("topic") == name)
    return rows.groupBy("topic").agg(F.count("*").alias("partition_count"), F.max(F.size("replicas")).alias("replication_factor"))


def cluster_info(brokers: DataFrame, partitions: DataFrame) -> DataFrame:
    """For each broker: its host, the topics and partitions it holds, and of how many it is the first replica."""
    held = partitions.select("topic", "partition", F.explode("replicas").alias("node_id"), F.element_at("replicas", 1).alias("leader"))
    rows = brokers.join(held, "node_id", "left")
    return rows.groupBy("node_id", "host").agg(F.countDistinct("topic").alias("topics"), F.count("partition").alias("partitions"), F.count_if(F.col("leader") == F.col("node_id")).alias("leads"))


def at_end(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Whether each (topic, partition, position) has reached the end; an empty partition has."""
    rows = positions.join(watermarks(log), ["topic", "partition"], "left")
    return rows.select("topic", "partition", "position", F.coalesce(F.col("position") >= F.col("high"), F.lit(True)).alias("eof"))


def distinct_offsets(log: DataFrame, prefer: str) -> DataFrame:
    """One row for each offset, the first by ``prefer``: what is polled again after a revocation goes.

    The first is found by an aggregation with partial results, not by sorting the partitions.
    """
    rest = [c for c in log.columns if c not in ("topic", "partition", "offset", prefer)]
    first = log.groupBy("topic", "partition", "offset").agg(F.min(F.struct(prefer, *rest)).alias("first"))
    return first.select("topic", "partition", "offset", "first.*")


def without_partitions(log: DataFrame, revoked: DataFrame) -> DataFrame:
    """Rows of partitions that weren't taken away."""
    return log.join(revoked, ["topic", "partition"], "left_anti")
