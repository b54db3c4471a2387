"""Consumer groups and topics as a catalog: building it, filtering it, checking it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUTES = "group_id string, topic string, consumer string, active boolean, max_messages int, max_wait_time int, initial_offset string, kafka map<string,string>, subscription_group string, position int"
# Defaults of client settings and of a topic; what a name may consist of.
KAFKA_DEFAULTS = {"statistics.interval.ms": "5000", "max.poll.interval.ms": "300000"}
NAME = r"^[a-zA-Z0-9\._\-]+$"


@dataclass
class Routes:
    """Declares groups and their topics in order; ``frame`` makes the catalog of it."""

    kafka: dict[str, str] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)

    def topic(self, group: str, name: str, consumer: str | None = None, active: bool = True, max_messages: int = 100, max_wait_time: int = 1000, initial_offset: str = "earliest", kafka: dict[str, str] | None = None, subscription_group: str | None = None) -> Routes:
        self.rows.append((group, name, consumer, active, max_messages, max_wait_time, initial_offset, self.kafka | (kafka or {}), subscription_group, len(self.rows)))
        return self

    def clear(self) -> None:
        self.rows.clear()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ROUTES)


def passes(name: Column, included: list[str], excluded: list[str]) -> Column:
    """Whether a name is active: with lists, one that is included, or, if something is excluded, one that isn't and nothing else is asked for.

    A name in both lists is active.
    """
    if not included and not excluded:
        return F.lit(True)
    if included:
        return name.isin(included)
    return ~name.isin(excluded)


def active_topics(routes: DataFrame, include: dict[str, list[str]], exclude: dict[str, list[str]]) -> DataFrame:
    """Routes that are flagged active and pass the lists of groups, subscription groups and topics."""
    out = routes.filter("active")
    for kind, column in (("consumer_groups", "group_id"), ("subscription_groups", "subscription_group"), ("topics", "topic")):
        out = out.filter(passes(F.col(column), include.get(kind, []), exclude.get(kind, [])))
    return out


def subscriptions(routes: DataFrame) -> DataFrame:
    """Active topic names of each subscription group, sorted."""
    return routes.filter("active").groupBy("group_id", "subscription_group").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


def find(routes: DataFrame, **attributes: object) -> DataFrame:
    """The first route whose attributes all have the given values."""
    rows = routes
    for name, value in attributes.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.orderBy("position").limit(1)


def with_defaults(routes: DataFrame, defaults: dict[str, str] = KAFKA_DEFAULTS) -> DataFrame:
    """Client settings with defaults where a route has none of its own."""
    given = F.create_map(*(F.lit(x) for k, v in defaults.items() for x in (k, v)))
    missing = F.map_filter(given, lambda k, _: ~F.coalesce(F.map_contains_key("kafka", k), F.lit(False)))
    return routes.withColumn("kafka", F.map_concat(F.coalesce("kafka", F.create_map().cast("map<string,string>")), missing))


def subscription_groups(routes: DataFrame) -> DataFrame:
    """Topics of a group that can share a connection, numbered in first-seen order, as ``group_name_number``.

    Those share one whose settings, limits, initial offset and named subscription group are equal.
    """
    settings = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("kafka", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    name = F.coalesce("subscription_group", F.lit(""))
    key = F.concat_ws("|", settings, F.col("max_messages").cast("string"), F.col("max_wait_time").cast("string"), "initial_offset", name)
    rows = routes.withColumn("settings", key)
    first = F.min("position").over(Window.partitionBy("group_id", "settings"))
    rows = rows.withColumn("first", first)
    number = F.dense_rank().over(Window.partitionBy("group_id").orderBy("first")) - 1
    return rows.withColumn("number", number.cast("int")).select("group_id", "topic", "number", F.concat_ws("_", "group_id", F.when(name != "", name), F.col("number").cast("string")).alias("id"))


def topic_violations(routes: DataFrame) -> DataFrame:
    """Broken rules of single topics: (group_id, topic, rule)."""
    rules = {
        "name_format": ~F.col("topic").rlike(NAME),
        "max_messages": F.col("max_messages") < 1,
        "max_wait_time": F.col("max_wait_time") < 10,
        "initial_offset": ~F.col("initial_offset").isin("earliest", "latest"),
        "consumer_missing": F.col("active") & F.col("consumer").isNull(),
        "bootstrap_servers_missing": ~F.coalesce(F.map_contains_key("kafka", "bootstrap.servers"), F.lit(False)),
        "mixed_separators": F.col("topic").contains(".") & F.col("topic").contains("_"),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return routes.select("group_id", "topic", F.explode(broken).alias("rule"))


def group_violations(routes: DataFrame) -> DataFrame:
    """Broken rules of groups: a topic listed twice, one topic with several consumers, names that only differ in . and _."""
    twice = routes.groupBy("group_id", "topic").agg(F.count("*").alias("n"), F.countDistinct("consumer").alias("consumers"))
    same = routes.groupBy("group_id", F.translate("topic", ".", "_").alias("plain")).agg(F.countDistinct("topic").alias("names"), F.min("topic").alias("topic"))
    return (
        twice.filter("n > 1").select("group_id", "topic", F.lit("repeated_topic").alias("rule"))
        .unionByName(twice.filter("consumers > 1").select("group_id", "topic", F.lit("several_consumers").alias("rule")))
        .unionByName(same.filter("names > 1").select("group_id", "topic", F.lit("separator_collision").alias("rule")))
    )


def undeclared(routes: DataFrame, dead_letter: DataFrame, declarations: DataFrame) -> DataFrame:
    """Routed and dead-letter topics without a declaration."""
    named = routes.filter("active").select("topic").union(dead_letter.filter("dlq_topic is not null").select("dlq_topic")).distinct()
    return named.join(declarations.select("topic"), "topic", "left_anti")


def dead_letter_violations(config: DataFrame) -> DataFrame:
    """Broken rules of dead-letter settings (topic, dlq_topic, max_retries, dispatch_method, marking_method)."""
    rules = {
        "max_retries": F.col("max_retries").isNull() | (F.col("max_retries") < 0),
        "dlq_topic_format": F.col("dlq_topic").isNotNull() & ~F.col("dlq_topic").rlike(NAME),
        "dispatch_method": ~F.col("dispatch_method").isin("produce_async", "produce_sync"),
        "marking_method": ~F.col("marking_method").isin("mark_as_consumed", "mark_as_consumed!"),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return config.select("topic", F.explode(broken).alias("rule"))


def job_violations(features: DataFrame) -> DataFrame:
    """Topics of jobs (topic, active_job, manual_offset_management) that would mark jobs by batch: a job that didn't run could count as done."""
    return features.filter(F.col("active_job") & ~F.coalesce("manual_offset_management", F.lit(False))).select("topic", F.lit("manual_offset_management").alias("rule"))
