"""Applying plans to a catalog; strategies; jobs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog.fixtures import frame
from tidelog.functions import strategies
from tidelog.functions.retry import DeadLetters
from tidelog.plans import replication, routes, topics
from tidelog.plans.catalog import Catalog, Declarations
from tidelog.plans.routes import Routes
from tidelog.sources.log import LOG_SCHEMA
from tidelog.streaming.jobs import as_messages, job_consumer, keep_running
from tidelog.streaming.runner import Runner


@pytest.fixture
def catalog(spark, tmp_path):
    out = Catalog(spark, str(tmp_path))
    out.put("brokers", frame(spark, "brokers"))
    out.put("partitions", frame(spark, "cluster_topics"))
    out.put("configs", frame(spark, "configs"))
    return out


def counts(catalog):
    return {r.topic: r["existing"] for r in topics.sizes(catalog.table("partitions")).collect()}


def test_migration_follows_the_plan(spark, catalog):
    declared = frame(spark, "declarations")
    want = {r.topic: r.partitions for r in topics.migrated(declared, catalog.table("partitions")).collect()}
    catalog.migrate(declared)
    assert counts(catalog) == want
    assert not topics.to_create(declared, catalog.table("partitions")).collect()
    assert not topics.to_align(declared, catalog.table("partitions"), catalog.table("configs")).collect()
    assert {r.direction for r in topics.to_repartition(declared, catalog.table("partitions")).collect()} == {"down"}
    placed = catalog.table("partitions").filter("topic = 'orders'").collect()
    assert all(len(set(r.replicas)) == 3 for r in placed)


def test_topics_come_and_go(spark, catalog):
    catalog.create_topic("t", 2, 2)
    catalog.create_partitions("t", 5)
    catalog.create_partitions("t", 3)
    assert counts(catalog)["t"] == 5
    catalog.delete_topic("t", "view")
    assert not {"t", "view"} & counts(catalog).keys()
    declared = Declarations(partitions=2).topic("click").topic("click", partitions=3, retention_ms="5").frame(spark)
    catalog.reset(declared)
    assert counts(catalog)["click"] == 3


def test_plan_is_exported(spark, catalog, tmp_path):
    plan = replication.plan(catalog.table("partitions"), catalog.table("brokers"), "view", 2)
    catalog.export(replication.as_json(plan), str(tmp_path / "plan"))
    assert spark.read.json(str(tmp_path / "plan")).select(F.size("partitions")).first()[0] == 4
    assert "--execute" in replication.steps("plan.json")["execute"]


def test_strategies():
    assert strategies.select().name == "default" and strategies.select("dead_letter_queue", "manual_offset_management").name == "dlq_mom"
    with pytest.raises(LookupError):
        strategies.select("active_job")


def test_a_consumer_follows_its_features(spark, tmp_path):
    make = lambda *features, dead=None: Runner.of(features, spark, str(tmp_path / "-".join(features)), lambda df: df, dead)
    dead, mom, jobs = DeadLetters("dead"), "manual_offset_management", "active_job"
    assert [(r.manual, r.ordered) for r in (make(), make(mom), make(jobs, mom), make("dead_letter_queue", mom, dead=dead))] == [(False, True), (True, True), (False, False), (True, True)]
    for features, letters in (((), dead), (("dead_letter_queue",), None)):
        with pytest.raises(ValueError, match="dead letters"):
            make(*features, dead=letters)


def test_job_topics_need_manual_marking(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", True, None), ("d", False, False)], "topic string, active_job boolean, manual_offset_management boolean")
    assert {(r.topic, r.rule) for r in routes.job_violations(rows).collect()} == {("b", "manual_offset_management"), ("c", "manual_offset_management")}


def test_routes_are_declared_in_order(spark):
    rows = Routes({"bootstrap.servers": "b"}).topic("g", "a", "A").topic("g", "b", "B", kafka={"x": "1"}).frame(spark).collect()
    assert [(r.topic, r.position) for r in rows] == [("a", 0), ("b", 1)] and rows[1].kafka == {"bootstrap.servers": "b", "x": "1"}


def test_jobs_run_one_by_one(spark, tmp_path):
    jobs = spark.createDataFrame([("q", n) for n in range(4)], "queue string, n long")
    rows = as_messages(jobs).withColumn("n", F.get_json_object("value", "$.n").cast("long"))
    log = rows.select("topic", F.lit(0).alias("partition"), F.col("n").alias("offset"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), "key", "value", F.lit(None).cast("map<string,array<string>>").alias("headers"), F.lit(None).cast("timestamp_ntz").alias("received_at"))
    run = job_consumer(lambda df: df.withColumn("failed", F.col("job.n") == 2).withColumn("error_class", F.lit("E")), "n long")
    runner = Runner(spark, str(tmp_path), run, DeadLetters("dead", max_retries=1), ordered=False)
    runner.batch(log.to(spark.createDataFrame([], LOG_SCHEMA).schema), 1)
    runner.drain()
    assert sorted(r.offset for r in runner.processed().collect()) == [0, 1, 3]
    assert [r.source_offset for r in runner.dead_letters().collect()] == [2]


def test_failed_queries_are_started_again():
    left = [RuntimeError("a"), RuntimeError("b"), None]

    class Query:
        def awaitTermination(self):  # noqa: N802
            if (e := left.pop(0)) is not None:
                raise e

    waits = []
    assert keep_running(Query, wait=60, sleep=waits.append) == 2 and waits == [60, 60]
    left[:] = [RuntimeError("c")]
    with pytest.raises(RuntimeError):
        keep_running(Query, restarts=0, sleep=waits.append)


def test_a_catalog_is_opened_again(spark, catalog, tmp_path):
    catalog.create_topic("t", 2)
    again = Catalog(spark, str(tmp_path))
    assert counts(again) == counts(catalog) and again.table("brokers").count() == catalog.table("brokers").count()
    again.create_topic("u", 1)
    assert counts(Catalog(spark, str(tmp_path)))["u"] == 1
    with pytest.raises(OSError, match="already"):  # the first catalog doesn't know of it
        catalog.create_topic("w", 1)
