"""Slices of a log as a consumer gets them, and what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.log import micros, numbered

NO_OFFSET = -1001


def batches(log: DataFrame, max_messages: int) -> DataFrame:
    """Adds ``batch``: each partition's messages in lots of ``max_messages`` by offset; gaps don't count."""
    rows = numbered(log, ["topic", "partition"], "offset", "__no")
    return rows.withColumn("batch", F.floor(F.col("__no") / max_messages).cast("long")).drop("__no")


def rate_limited(log: DataFrame, per_slot: int, slot_ms: int) -> DataFrame:
    """Adds ``slot`` and ``not_before_ms``: when a consumer that pauses after every ``per_slot`` messages of a partition takes each."""
    rows = numbered(log, ["topic", "partition"], "offset", "__no")
    slot = F.floor(F.col("__no") / per_slot).cast("long")
    return rows.withColumn("slot", slot).withColumn("not_before_ms", slot * slot_ms).drop("__no")


def batch_metadata(sliced: DataFrame, now_us: Column, *by: str) -> DataFrame:
    """Size, first and last offset and created_us of each batch; created_us is the last message's time, but never in the future."""
    keys = by or ("topic", "partition", "batch")
    last = F.max_by(micros(), F.col("offset"))
    return sliced.groupBy(*keys).agg(
        F.count("offset").alias("size"),
        F.coalesce(F.min("offset"), F.lit(NO_OFFSET)).alias("first_offset"),
        F.coalesce(F.max("offset"), F.lit(NO_OFFSET)).alias("last_offset"),
        F.coalesce(F.least(last, now_us), now_us).alias("created_us"),
    )


def lag_ms(processed_us: Column, since_us: Column) -> Column:
    """Milliseconds between two times, rounded half up; -1 while not processed."""
    return F.coalesce(F.floor((processed_us - since_us + 500) / 1000).cast("long"), F.lit(-1).cast("long"))


def batch_values(sliced: DataFrame) -> DataFrame:
    """First and last payload, number of messages and of tombstones of each batch, without sorting it."""
    tombstone = F.col("key").isNotNull() & F.col("value").isNull()
    first, last = F.min(F.struct("offset", "value")), F.max(F.struct("offset", "value"))
    return sliced.groupBy("topic", "partition", "batch").agg(F.count("*").alias("size"), first["value"].alias("first_value"), last["value"].alias("last_value"), F.count_if(tombstone).alias("tombstones"))
