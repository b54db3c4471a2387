"""Operational figures from logs of batches, polls, jobs, statistics and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_US = 5 * 60 * 1_000_000
# Forward-only states of a process and of a listener, in order.
PROCESS_STATES = ("initializing", "initialized", "supervising", "running", "quieting", "quiet", "stopping", "stopped", "terminated")
LISTENER_STATES = ("pending", "starting", "running", "quieting", "quiet", "stopping", "stopped")
_STATS = "struct<name:string,brokers:map<string,struct<nodeid:bigint,rtt:struct<p95:bigint>,connects:bigint>>,topics:map<string,struct<partitions:map<string,struct<consumer_lag:bigint,consumer_lag_stored:bigint,fetch_state:string>>>>>"


def batch_metrics(batches: DataFrame) -> DataFrame:
    """Messages, batches, last offset and spread of batch size and lags of each topic partition."""
    return batches.groupBy("topic", "partition").agg(
        F.sum("size").alias("messages"),
        F.count("*").alias("batches"),
        F.max_by("last_offset", "batch").alias("offset"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.max("consumption_lag").alias("max_consumption_lag"),
        F.max("processing_lag").alias("max_processing_lag"),
    )


def batch_histograms(batches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Batch sizes and lags (ms) of each topic partition at some shares of its batches, one row a figure and share.

    Exact: figures are counted by value with partial results before shares are looked for. Batches
    not processed yet (-1) have no lag.
    """
    figures = ("size", "consumption_lag", "processing_lag")
    rows = batches.select("topic", "partition", F.explode(F.array(*(F.struct(F.lit(f).alias("figure"), F.col(f).alias("value")) for f in figures))).alias("f")).select("topic", "partition", "f.*").filter("value >= 0")
    keys = ["topic", "partition", "figure"]
    counts = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    asked = upto.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("upto") >= F.ceil(F.col("share") * F.col("all")))
    return asked.groupBy(*keys, "share").agg(F.min("value").alias("value"))


def poll_metrics(polls: DataFrame) -> DataFrame:
    """Polls, messages and time of each subscription group (subscription_group, messages, time_ms)."""
    return polls.groupBy("subscription_group").agg(F.count("*").alias("polls"), F.sum("messages").alias("messages"), F.sum("time_ms").alias("time_ms"), F.max("time_ms").alias("max_time_ms"), F.count_if(F.col("messages") == 0).alias("empty"))


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type", "topic").agg(F.count("*").alias("errors"))


def jobs_statistics(events: DataFrame, threads: int) -> DataFrame:
    """Busy and enqueued jobs after each event (queue, seq, change +1 start or -1 finish): as many are busy as there are threads."""
    open_jobs = F.sum("change").over(Window.partitionBy("queue").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.select("queue", "seq", F.least(open_jobs, F.lit(threads)).alias("busy"), F.greatest(open_jobs - threads, F.lit(0)).alias("enqueued"))


def worker_metrics(stats: DataFrame, threads: int) -> DataFrame:
    return stats.groupBy("queue").agg(F.lit(threads).alias("total"), F.max("busy").alias("max_busy"), F.max("enqueued").alias("max_enqueued"), F.max_by("busy", "seq").alias("busy"), F.max_by("enqueued", "seq").alias("enqueued"))


def own_statistics(statistics: DataFrame) -> DataFrame:
    """Statistics of a client itself: those that name another client, of the same process, are dropped."""
    parsed = statistics.withColumn("s", F.from_json("json", _STATS))
    return parsed.filter(F.col("s.name") == F.col("client_name"))


def flat_statistics(statistics: DataFrame) -> DataFrame:
    """One row a figure: broker round trips and connects, and each partition's lags.

    Leaves out bootstrap brokers (node -1), the internal partition -1, lags of -1, and partitions
    whose fetching is stopped or was never started.
    """
    own = own_statistics(statistics)
    figure = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    brokers = own.select("group_id", "emitted_us", F.explode("s.brokers").alias("name", "b")).filter("b.nodeid <> -1")
    brokers = brokers.select("group_id", "emitted_us", F.lit("broker").alias("scope"), "name", F.lit(None).cast("string").alias("partition"), F.explode(F.array(figure("rtt.p95", F.col("b.rtt.p95")), figure("connects", F.col("b.connects")))).alias("m"))
    parts = own.select("group_id", "emitted_us", F.explode("s.topics").alias("name", "t")).select("group_id", "emitted_us", "name", F.explode("t.partitions").alias("partition", "p"))
    parts = parts.filter("partition <> '-1' and p.fetch_state not in ('stopped', 'none')")
    parts = parts.select("group_id", "emitted_us", F.lit("topic").alias("scope"), "name", "partition", F.explode(F.array(figure("consumer_lag", F.col("p.consumer_lag")), figure("consumer_lag_stored", F.col("p.consumer_lag_stored")))).alias("m")).filter("m.value <> -1")
    return brokers.unionByName(parts).select("group_id", "emitted_us", "scope", "name", "partition", "m.metric", "m.value").filter("value is not null")


def topic_lags(statistics: DataFrame) -> DataFrame:
    """Summed lags of each topic's partitions in each statistics event, 0 where every partition is left out (-1)."""
    own = own_statistics(statistics)
    parts = own.select("group_id", "emitted_us", F.explode("s.topics").alias("topic", "t")).select("group_id", "emitted_us", "topic", F.explode("t.partitions").alias("partition", "p"))
    counts = F.expr("partition <> '-1' and p.consumer_lag <> -1 and p.consumer_lag_stored <> -1")
    return parts.groupBy("group_id", "emitted_us", "topic").agg(F.coalesce(F.sum(F.when(counts, F.col("p.consumer_lag"))), F.lit(0)).alias("consumer_lag"), F.coalesce(F.sum(F.when(counts, F.col("p.consumer_lag_stored"))), F.lit(0)).alias("consumer_lag_stored"))


def insights(statistics: DataFrame, now_us: int, ttl_us: int = TTL_US) -> DataFrame:
    """The latest lags of each (group, topic, partition), not older than the time to live."""
    own = own_statistics(statistics).filter(F.col("emitted_us") >= now_us - ttl_us)
    parts = own.select("group_id", "emitted_us", F.explode("s.topics").alias("topic", "t")).select("group_id", "emitted_us", "topic", F.explode("t.partitions").alias("partition", "p"))
    parts = parts.filter("partition <> '-1' and p.fetch_state not in ('stopped', 'none')")
    latest = parts.groupBy("group_id", "topic", "partition").agg(F.max_by(F.struct("p.consumer_lag", "p.consumer_lag_stored"), "emitted_us").alias("p"), F.max("emitted_us").alias("emitted_us"))
    return latest.select("group_id", "topic", F.col("partition").cast("int").alias("partition"), "p.consumer_lag", "p.consumer_lag_stored", "emitted_us")


def liveness(ticks: DataFrame, now_us: int, ttl_us: dict[str, int]) -> DataFrame:
    """Health of each process from its ticks (node, kind, at_us, unrecoverable): dead once a kind's last tick is older than its limit."""
    limit = F.create_map(*(x for k, v in ttl_us.items() for x in (F.lit(k), F.lit(v))))
    last = ticks.groupBy("node", "kind").agg(F.max("at_us").alias("at_us"), F.max("unrecoverable").alias("unrecoverable"))
    late = last.withColumn("late", now_us - F.col("at_us") > limit[F.col("kind")])
    reasons = F.array_join(F.array_sort(F.collect_list(F.when(F.col("late"), F.col("kind")))), ",")
    return late.groupBy("node").agg((~(F.max("late") | F.max("unrecoverable"))).alias("healthy"), reasons.alias("late"))


def sweep(nodes: DataFrame, now_us: int, quiet_us: int = 60_000_000, restart_us: int = 5_000_000) -> DataFrame:
    """What a supervisor does with each node (node, alive, hanging, status, reported_us, died_us)."""
    silent = now_us - F.col("reported_us") > quiet_us
    what = F.when(~F.col("alive"), F.when(now_us - F.col("died_us") >= restart_us, "restart").otherwise("cleanup")).when(F.col("hanging"), "kill").when(F.col("status") > 0, "stop").when(silent, "stop").otherwise("none")
    return nodes.select("node", what.alias("action"))


def states(transitions: DataFrame, order: tuple[str, ...] = PROCESS_STATES) -> DataFrame:
    """The state of each process: the furthest it has come, as states only go forward."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("state"))
    return transitions.groupBy("process").agg(F.max_by("state", rank).alias("state"), F.max(rank).alias("rank"))


def assignments(events: DataFrame) -> DataFrame:
    """Partitions assigned now, sorted, for each subscription group and topic, from events (seq, type, subscription_group, topic, partitions).

    The last event of a partition decides; a reset ends every earlier assignment of its group.
    """
    resets = events.filter("type = 'reset'").groupBy("subscription_group").agg(F.max("seq").alias("reset"))
    each = events.filter("type <> 'reset'").select("seq", "type", "subscription_group", "topic", F.explode("partitions").alias("partition"))
    last = each.groupBy("subscription_group", "topic", "partition").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq"))
    held = last.join(resets, "subscription_group", "left").filter("type = 'assign' and seq > coalesce(reset, -1)")
    return held.groupBy("subscription_group", "topic").agg(F.array_join(F.array_sort(F.collect_list("partition")), ",").alias("partitions"))


def generations(events: DataFrame, most: int = 100_000) -> DataFrame:
    """How often each partition was assigned; 0 for one that was only revoked.

    Beyond ``most`` partitions, whole topics are forgotten, those first seen longest ago first.
    """
    each = events.filter("type <> 'reset'").select("seq", "type", "topic", F.explode("partitions").alias("partition"))
    counts = each.groupBy("topic", "partition").agg(F.count_if(F.col("type") == "assign").alias("generation"), F.min("seq").alias("seen"))
    topics = counts.groupBy("topic").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    newer = F.sum("n").over(Window.orderBy(F.desc("seen"), "topic").rowsBetween(Window.unboundedPreceding, 0))  # a row a topic
    return counts.join(topics.withColumn("upto", newer).filter(F.col("upto") <= most).select("topic"), "topic").select("topic", "partition", "generation")
