"""Live topics through Spark's Kafka connector. Not covered by tests here: the connector's jar isn't installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of client settings, of the Java clients and of librdkafka, that only one kind of client has.
PRODUCER_ONLY = frozenset(
    """acks batch.num.messages batch.size buffer.memory compression.codec compression.level compression.type delivery.report.only.error delivery.timeout.ms enable.gapless.guarantee enable.idempotence key.serializer linger.ms
    max.block.ms max.in.flight.requests.per.connection max.request.size message.send.max.retries message.timeout.ms partitioner partitioner.class partitioner.ignore.keys produce.offset.report queue.buffering.backpressure.threshold
    queue.buffering.max.kbytes queue.buffering.max.messages queue.buffering.max.ms queuing.strategy request.required.acks request.timeout.ms retries sticky.partitioning.linger.ms transaction.timeout.ms transactional.id value.serializer""".split()
)
CONSUMER_ONLY = frozenset(
    """auto.commit.enable auto.commit.interval.ms auto.offset.reset check.crcs consume.callback.max.messages coordinator.query.interval.ms enable.auto.commit enable.auto.offset.store enable.partition.eof exclude.internal.topics fetch.error.backoff.ms
    fetch.max.bytes fetch.max.wait.ms fetch.message.max.bytes fetch.min.bytes fetch.queue.backoff.ms fetch.wait.max.ms group.id group.instance.id group.protocol group.protocol.type group.remote.assignor heartbeat.interval.ms isolation.level
    key.deserializer max.partition.fetch.bytes max.poll.interval.ms max.poll.records offset.store.method offset.store.path offset.store.sync.interval.ms partition.assignment.strategy queued.max.messages.kbytes queued.min.messages session.timeout.ms value.deserializer""".split()
)


def settings_for(settings: dict[str, str], producer: bool) -> dict[str, str]:
    """The part of mixed client settings that a producer, or a consumer, may get."""
    other = CONSUMER_ONLY if producer else PRODUCER_ONLY
    return {k: v for k, v in settings.items() if k not in other}


def source_options(settings: dict[str, str], topics: list[str] | None = None, assign: str | None = None, initial_offset: str = "earliest", max_messages: int | None = None, isolation: str | None = None) -> dict[str, str]:
    """Options of the ``kafka`` source: subscribe to topics, or take assigned partitions as JSON."""
    out = {f"kafka.{k}": v for k, v in settings_for(settings, producer=False).items() if k not in ("group.id", "auto.offset.reset", "enable.auto.commit")}
    out |= {"assign": assign} if assign else {"subscribe": ",".join(topics or [])}
    out |= {"startingOffsets": initial_offset, "includeHeaders": "true"}
    if max_messages:
        out["maxOffsetsPerTrigger"] = str(max_messages)
    if isolation:
        out["kafka.isolation.level"] = isolation
    return out


def canonical(rows: DataFrame, text: bool = False) -> DataFrame:
    """Rows of the connector as log rows: key and value are the bytes that were sent, or with ``text`` strings.

    Headers are a map from each name to its values, all of them in their order, as a name may
    occur again; without headers it is empty.
    """
    kind = "string" if text else "binary"
    headers = F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>"))
    names = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    values = F.transform(names, lambda k: F.transform(F.filter(headers, lambda h: h["key"] == k), lambda h: h["value"].cast(kind)))
    return rows.select("topic", "partition", "offset", "timestamp", F.col("key").cast(kind).alias("key"), F.col("value").cast(kind).alias("value"), F.map_from_arrays(names, values).alias("headers"), F.current_timestamp().alias("received_at"))


def outgoing(rows: DataFrame) -> DataFrame:
    """Log rows as the connector writes them: headers as a list, a name once for each of its values."""
    columns = [c for c in ("topic", "partition", "key", "value") if c in rows.columns]
    if "headers" in rows.columns:
        pairs = F.flatten(F.transform(F.map_entries("headers"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.cast("binary").alias("value")))))
        return rows.select(*columns, pairs.alias("headers"))
    return rows.select(*columns)


def stream(spark: SparkSession, text: bool = False, **options: str) -> DataFrame:
    return canonical(spark.readStream.format("kafka").options(**options).load(), text)


def batch(spark: SparkSession, text: bool = False, **options: str) -> DataFrame:
    return canonical(spark.read.format("kafka").options(**options).load(), text)


def produce(rows: DataFrame, settings: dict[str, str], topic: str | None = None) -> None:
    """Write key, value and headers; rows name their topic unless one is given."""
    writer = outgoing(rows).write.format("kafka").options(**{f"kafka.{k}": v for k, v in settings_for(settings, producer=True).items()})
    (writer.option("topic", topic) if topic else writer).save()
