"""Rules that the tables of the queries don't reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog import queries as Q
from tidelog.functions import payload
from tidelog.functions.retry import DeadLetters, Pause
from tidelog.operators import batches, failures, metrics, reads
from tidelog.plans import replication, routes
from tidelog.sources import kafka
from tidelog.sources.log import numbered, read_recorded, write_recorded


@pytest.mark.parametrize(
    ("low", "high", "count", "start", "by_time", "want"),
    [
        (0, 100, 10, -1, False, (90, 99)),
        (0, 100, 10, -2, False, (89, 98)),
        (0, 5, 10, -2, False, (0, 4)),  # clamped to the beginning: the newest is included
        (20, 100, 10, 15, False, (20, 24)),  # below the low end: fewer, not shifted
        (0, 100, 10, 95, False, (95, 99)),
        (0, 100, 10, -1, True, (100, 99)),  # a time after all: nothing
    ],
)
def test_offset_range(low, high, count, start, by_time, want):
    assert reads.offset_range(low, high, count, start, by_time) == want


def test_waits(spark):
    waits = [r.w for r in spark.range(1, 7).select(Pause().wait(F.col("id")).alias("w")).collect()]
    assert waits == [2000, 4000, 8000, 16000, 30000, 30000]


def test_three_retries_are_four_executions(spark):
    rows = spark.createDataFrame([("t", 0, 5, 9, "E")], "topic string, partition int, offset long, fails_for int, error_class string")
    got = [(r.attempt, r.decision, r.wait_ms) for r in failures.attempts(rows, DeadLetters("d")).orderBy("attempt").collect()]
    assert got == [(1, "retry", 2000), (2, "retry", 4000), (3, "retry", 8000), (4, "dispatch", 1000)]


def test_shared_counter_uses_up_later_retries(spark):
    rows = spark.createDataFrame([("t", 0, 0, o, n, "E") for o, n in ((1, 2), (2, 2), (3, 1), (4, 9))], "topic string, partition int, batch long, offset long, fails_for int, error_class string")
    assert sorted(r.offset for r in failures.shared_attempts(rows, DeadLetters("d", max_retries=3)).collect()) == [2, 4]


def test_strict_parsing_fails_and_lazy_parsing_does_not(spark):
    rows = spark.createDataFrame([("t", '{"a": 1}'), ("t", "{bad")], "topic string, value string")
    parsed = payload.parsed(rows, {}, payload.json_strict("a long"))
    assert parsed.select("value").count() == 2  # nobody asked for the payload
    with pytest.raises(Exception, match="(?i)malformed"):
        parsed.select("payload.a").collect()


def test_numbering_equals_row_number_over_chunks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("o"))
    got = {(r.g, r.o): r.n for r in numbered(rows, ["g"], "o", "n", chunk=64).collect()}
    for g in range(3):
        assert [got[k] for k in sorted(k for k in got if k[0] == g)] == list(range(sum(k[0] == g for k in got)))


def test_recorded_log_prunes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    rows = Q.log(spark, sf_dir).select("topic", "partition", "offset", "timestamp", "key", "value", F.lit(None).cast("map<string,array<string>>").alias("headers"), F.col("timestamp").alias("received_at"))
    write_recorded(rows, path)
    part = read_recorded(spark, path).filter("topic = 'events' and partition = 1 and offset between 5 and 9")
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThanOrEqual(offset,5)" in plan
    assert sorted(r.offset for r in part.collect()) == [5, 6, 7, 8, 9]


def test_empty_batch_has_no_offsets(spark):
    rows = spark.createDataFrame([("t", 0, 0, None, None)], "topic string, partition int, batch long, offset long, timestamp timestamp_ntz")
    got = batches.batch_metadata(rows, F.lit(7)).first()
    assert (got["size"], got.first_offset, got.last_offset, got.created_us) == (0, -1001, -1001, 7)


def test_activity_lists(spark):
    def active(name, included, excluded):
        return spark.range(1).select(routes.passes(F.lit(name), included, excluded)).first()[0]

    assert active("a", [], []) and active("a", ["a"], []) and active("a", ["a"], ["a"])
    assert not active("b", ["a"], []) and not active("b", ["a"], ["c"]) and not active("b", [], ["b"]) and active("a", [], ["b"])


def test_placement_without_free_brokers(spark):
    parts = spark.createDataFrame([("t", 0, [1, 2])], "topic string, partition int, replicas array<int>")
    brokers = spark.createDataFrame([(1,), (2,)], "node_id int")
    assert replication.plan(parts, brokers, "t", 2).first().replicas == [1, 2]


def test_dead_letter_settings():
    assert DeadLetters("d").marks(manual=False) and not DeadLetters("d").marks(manual=True)
    assert DeadLetters("d", mark_after_dispatch=True).marks(manual=True) and DeadLetters("d", mark_after_dispatch=False).marks(False, jobs=True)
    assert not DeadLetters().active and DeadLetters(False).active


def test_kafka_rows_keep_their_bytes_and_headers(spark):
    made = [("t", 0, 5, bytearray(b"\xff\x00"), bytearray(b"\x80"), [("a", bytearray(b"1")), ("b", None), ("a", bytearray(b"\xfe"))]), ("t", 0, 6, None, None, None)]
    rows = spark.createDataFrame(made, "topic string, partition int, offset long, key binary, value binary, headers array<struct<key:string,value:binary>>").withColumn("timestamp", F.current_timestamp())
    one, two = kafka.canonical(rows).orderBy("offset").collect()
    assert (one.key, one.value) == (b"\xff\x00", b"\x80") and one.headers == {"a": [b"1", b"\xfe"], "b": [None]}
    assert (two.key, two.value, two.headers) == (None, None, {})
    back = kafka.outgoing(kafka.canonical(rows)).filter("key is not null").first()
    assert sorted((h.key, h.value) for h in back.headers if h.value) == [("a", b"1"), ("a", b"\xfe")] and bytes(back.value) == b"\x80"
    text = kafka.canonical(rows.withColumn("value", F.encode(F.lit("é"), "utf-8")).filter("offset = 6"), text=True).first()
    assert text.value == "é"


def test_unknown_topics_are_an_error(spark):
    parts = spark.createDataFrame([("t", 0, [1, 2])], "topic string, partition int, replicas array<int>")
    assert reads.topic_info(parts, "t").first().partition_count == 1
    with pytest.raises(LookupError, match="unknown topic: u"):
        reads.topic_info(parts, "u")


def test_oldest_topics_are_forgotten(spark):
    events = spark.createDataFrame([(1, "assign", "old", [0, 1]), (2, "assign", "mid", [0]), (3, "revoke", "new", [0]), (4, "assign", "old", [0])], "seq long, type string, topic string, partitions array<int>")
    seen = lambda most: {(r.topic, r.partition, r.generation) for r in metrics.generations(events, most).collect()}
    assert seen(100) == {("old", 0, 2), ("old", 1, 1), ("mid", 0, 1), ("new", 0, 0)}
    assert seen(3) == {("mid", 0, 1), ("new", 0, 0)}


def test_no_folder_is_made_up_on_a_cluster():
    from types import SimpleNamespace

    from tidelog.stage import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://a:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]"))


def test_client_settings_are_split():
    assert not kafka.PRODUCER_ONLY & kafka.CONSUMER_ONLY
    settings = {"bootstrap.servers": "b", "acks": "all", "group.id": "g"}
    assert kafka.settings_for(settings, producer=True) == {"bootstrap.servers": "b", "acks": "all"}
    assert kafka.source_options(settings, ["t"], max_messages=5) == {"kafka.bootstrap.servers": "b", "subscribe": "t", "startingOffsets": "earliest", "includeHeaders": "true", "maxOffsetsPerTrigger": "5"}
