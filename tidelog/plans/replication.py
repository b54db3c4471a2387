"""Replica placement: plans for more replicas or an even spread, their checks and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_brokers(brokers: DataFrame) -> DataFrame:
    """One row with the sorted ids; a cluster has few brokers."""
    return brokers.agg(F.array_sort(F.collect_list("node_id")).alias("brokers"))


def _round_robin(ids: Column, partition: Column, count: Column) -> Column:
    """``count`` ids in turn from the partition's own place on; none if there are none to choose from."""
    n = F.size(ids)
    steps = F.when((count > 0) & (n > 0), F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.element_at(ids, (F.pmod(partition + i, F.greatest(n, F.lit(1))) + 1).cast("int")))


def plan(partitions: DataFrame, brokers: DataFrame, topic: str, to: int) -> DataFrame:
    """Replicas of each partition for a replication factor of ``to``: those it has, and others in turn."""
    rows = partitions.filter(F.col("topic") == topic).join(F.broadcast(_all_brokers(brokers)))
    free = F.array_except("brokers", "replicas")
    added = _round_robin(free, F.col("partition"), F.lit(to) - F.size("replicas"))
    return rows.select("topic", "partition", F.array_sort(F.concat("replicas", added)).alias("replicas"))


def rebalance(partitions: DataFrame, brokers: DataFrame, topic: str) -> DataFrame:
    """As many replicas as the first partition has, dealt evenly over all brokers."""
    rows = partitions.filter(F.col("topic") == topic)
    factor = rows.agg(F.min_by(F.size("replicas"), "partition").alias("factor"))
    rows = rows.join(F.broadcast(_all_brokers(brokers))).join(F.broadcast(factor))
    return rows.select("topic", "partition", F.array_sort(_round_robin(F.col("brokers"), F.col("partition"), F.col("factor"))).alias("replicas"))


def violations(partitions: DataFrame, brokers: DataFrame, requests: DataFrame) -> DataFrame:
    """Broken rules of requests (topic, target, manual array<int> of the partitions placed by hand, or null)."""
    held = partitions.groupBy("topic").agg(F.min_by(F.size("replicas"), "partition").alias("current"), F.array_sort(F.collect_list("partition")).alias("all"))
    n = brokers.agg(F.count("*").alias("brokers"))
    rows = requests.join(held, "topic", "left").join(F.broadcast(n))
    rules = {
        "topic_missing": F.col("current").isNull(),
        "target_not_above_current": F.col("target") <= F.col("current"),
        "target_above_brokers": F.col("target") > F.col("brokers"),
        "manual_incomplete": F.col("manual").isNotNull() & (F.size(F.array_except("all", "manual")) > 0),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return rows.select("topic", F.explode(broken).alias("rule"))


def as_json(assignment: DataFrame) -> DataFrame:
    """A plan as the one JSON document that reassignment tools read."""
    entry = F.struct("topic", "partition", "replicas")
    return assignment.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(entry)).alias("partitions"))).alias("json"))


def steps(file: str, servers: str = "localhost:9092") -> dict[str, str]:
    """Commands that start and check a reassignment from the plan's file."""
    command = f"kafka-reassign-partitions.sh --bootstrap-server {servers} --reassignment-json-file {file}"
    return {"execute": f"{command} --execute", "verify": f"{command} --verify"}
