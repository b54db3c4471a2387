"""Committed offsets: marking, lag, and moving or copying the cursors of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import offsets_for_times, watermarks


def cursors(marks: DataFrame) -> DataFrame:
    """Cursor of each (topic, partition) after marks (seq, offset, revoked): one behind the last mark, not the highest.

    Marking an older offset rewinds. A mark of a revoked partition doesn't count.
    """
    good = marks.filter("not revoked")
    return good.groupBy("topic", "partition").agg((F.max_by("offset", "seq") + 1).alias("cursor"), F.count("*").alias("marks"))


def mark_results(marks: DataFrame) -> DataFrame:
    """What each mark returns: false when revoked; and whether it stored anything, being no repeat of the cursor's own offset."""
    good = F.when(~F.col("revoked"), F.col("offset"))
    before = F.last(good, ignorenulls=True).over(Window.partitionBy("topic", "partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return marks.select("seq", "topic", "partition", "offset", (~F.col("revoked")).alias("result"), (~F.col("revoked") & ~F.coalesce(before == F.col("offset"), F.lit(False))).alias("stored"))


def lags(routes: DataFrame, partitions: DataFrame, committed: DataFrame, log: DataFrame) -> DataFrame:
    """Offset and lag of every partition of every group's active topics.

    -1 and -1 where nothing was committed. A topic that isn't in the cluster is one row without a
    partition. (routes: group_id, topic, active; committed: group_id, topic, partition, offset)
    """
    wanted = routes.filter("active").select("group_id", "topic").distinct()
    grid = wanted.join(partitions.select("topic", "partition"), "topic", "left")
    rows = grid.join(committed, ["group_id", "topic", "partition"], "left").join(watermarks(log), ["topic", "partition"], "left")
    at = F.when(F.col("offset") >= 0, F.col("offset"))
    known = F.col("partition").isNotNull()
    return rows.select("group_id", "topic", "partition", F.when(known, F.coalesce(at, F.lit(-1))).cast("long").alias("offset"), F.when(known, F.coalesce(F.coalesce("high", F.lit(0)) - at, F.lit(-1))).cast("long").alias("lag"))


def seek(commands: DataFrame, partitions: DataFrame, log: DataFrame) -> DataFrame:
    """Cursors that seek commands lead to: (seq, group_id, topic, partition, kind, value).

    kind is ``offset`` (value), ``time`` (value in microseconds; beyond the end means the end),
    ``earliest`` or ``latest``. A null partition means all of the topic. The last command for a
    partition wins.
    """
    every = commands.filter("partition is null").drop("partition").join(partitions.select("topic", "partition"), "topic")
    one = commands.filter("partition is not null")
    rows = one.unionByName(every.select(*one.columns))
    last = rows.groupBy("group_id", "topic", "partition").agg(F.max_by(F.struct("kind", "value"), "seq").alias("c")).select("group_id", "topic", "partition", "c.*")
    timed = offsets_for_times(log, last.filter("kind = 'time'").select("topic", "partition", F.col("value").alias("at_us")).distinct()).select("topic", "partition", F.col("at_us").alias("value"), F.lit("time").alias("kind"), F.col("offset").alias("found"))
    rows = last.join(watermarks(log), ["topic", "partition"], "left").join(timed, ["topic", "partition", "kind", "value"], "left")
    high, low = F.coalesce("high", F.lit(0)), F.coalesce("low", F.lit(0))
    target = F.when(F.col("kind") == "earliest", low).when(F.col("kind") == "latest", high).when(F.col("kind") == "time", F.when(F.coalesce("found", F.lit(-1)) < 0, high).otherwise(F.col("found"))).otherwise(F.col("value"))
    return rows.select("group_id", "topic", "partition", target.cast("long").alias("offset"))


def upsert(committed: DataFrame, new: DataFrame) -> DataFrame:
    """Committed offsets with those of ``new`` in place of older ones."""
    keys = ["group_id", "topic", "partition"]
    return committed.join(new, keys, "left_anti").select(*keys, "offset").unionByName(new.select(*keys, "offset"))


def copy_group(committed: DataFrame, old: str, new: str, topics: list[str] | None = None) -> DataFrame:
    """Committed offsets with those of one group given to another too; negative ones aren't copied."""
    rows = committed.filter((F.col("group_id") == old) & (F.col("offset") >= 0))
    if topics is not None:
        rows = rows.filter(F.col("topic").isin(topics))
    return upsert(committed, rows.withColumn("group_id", F.lit(new)))


def delete_group(committed: DataFrame, group: str) -> DataFrame:
    return committed.filter(F.col("group_id") != group)


def rename_group(committed: DataFrame, old: str, new: str, topics: list[str] | None = None, delete_previous: bool = True) -> DataFrame:
    out = copy_group(committed, old, new, topics)
    return delete_group(out, old) if delete_previous else out
