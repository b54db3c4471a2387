"""Queries of the log operators over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import fixtures
from tidelog.fixtures import NOW, T0, frame
from tidelog.functions import ids, payload
from tidelog.functions.retry import DeadLetters, Pause
from tidelog.operators import batches as B
from tidelog.operators import cursors as C
from tidelog.operators import failures as X
from tidelog.operators import metrics as M
from tidelog.operators import reads as R
from tidelog.plans import replication, routes, topics
from tidelog.sources.log import EVENT_LOG, from_events, micros, read_recorded, write_recorded
from tidelog.stage import Stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LOG = """{name} AS (SELECT {topic} AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
 CAST(row_number() OVER (PARTITION BY {topic}, user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset", epoch_us(ts) AS us,
 CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 97 <> 0 THEN props END AS value, event_id, event_type, value AS amount FROM events)"""
_PARTS = {
    "log": _LOG.format(name="log", topic="'events'"),
    "tlog": _LOG.format(name="tlog", topic="event_type"),
    "skewed": """skewed AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN us - 3600000000 ELSE us END AS us) FROM tlog)""",
    "marks_of": """marks_of AS (SELECT topic, partition, min("offset") AS low, max("offset") + 1 AS high FROM tlog GROUP BY ALL)""",
    "sliced": """sliced AS (SELECT *, CAST((row_number() OVER (PARTITION BY topic, partition ORDER BY "offset") - 1) // 100 AS BIGINT) AS batch FROM log)""",
    "meta": """meta AS (SELECT topic, partition, batch, count(*) AS size, min("offset") AS first_offset, max("offset") AS last_offset, arg_max(us, "offset") AS created_us FROM sliced GROUP BY ALL)""",
    "failing": """failing AS (SELECT *, CASE WHEN event_type = 'error' THEN CAST(event_id % 7 AS INTEGER) ELSE 0 END AS fails_for, CASE WHEN event_id % 11 = 0 THEN 'SystemExit' ELSE 'StandardError' END AS error_class FROM log)""",
}
_NEEDS = {"skewed": ["tlog"], "marks_of": ["tlog"], "sliced": ["log"], "meta": ["sliced"], "failing": ["log"]}


def with_parts(sql: str, parts: str) -> str:
    """The statement with the common tables it names, each after those it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for name in parts.split():
        add(name)
    text = ",\n".join(_PARTS.get(n) or fixtures.sql(n) for n in done)
    if not done:
        return sql
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("RECURSIVE ", "", 1)
    if sql.startswith("WITH "):
        return f"WITH {recursive}{text},\n{sql[5:]}"
    return f"WITH {recursive}{text}\n{sql}"


def query(name: str, sql: str | None = None, parts: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_parts(" ".join(sql.split()), parts)
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_logs: dict[tuple[str, str, str], str] = {}


def _recorded(spark: SparkSession, sf_dir: str, name: str, topic: str | Column) -> DataFrame:
    """The events recorded as a log, once for an application, and read as logs are: pruned by topic, partition and offsets."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _logs:
        path = Stage(spark, f"log-{name}").path("log")
        write_recorded(from_events(events(spark, sf_dir), topic), path)
        _logs[key] = path
    return read_recorded(spark, _logs[key], EVENT_LOG)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic of everything."""
    return _recorded(spark, sf_dir, "events", "events")


def tlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each type of event."""
    return _recorded(spark, sf_dir, "types", F.col("event_type"))


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every tenth clock an hour late, so that the newest time isn't the last offset's."""
    late = F.when(F.col("event_id") % 10 == 0, F.col("timestamp") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("timestamp"))
    return tlog(spark, sf_dir).withColumn("timestamp", late)


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batches(log(spark, sf_dir), 100)


def failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors fail as often as their id says, some of them critically."""
    rows = log(spark, sf_dir)
    return rows.withColumn("fails_for", F.when(F.col("event_type") == "error", (F.col("event_id") % 7).cast("int")).otherwise(0)).withColumn("error_class", F.when(F.col("event_id") % 11 == 0, "SystemExit").otherwise("StandardError"))


_FAR = 4_102_444_800_000_000

# --------------------------------------------------------------------------- reads


@query("watermarks", "SELECT topic, partition, low, high FROM marks_of", "marks_of")
def _(s, d):
    return R.watermarks(tlog(s, d))


_READ = 'SELECT topic, partition, "offset", us AS timestamp_us, key, value FROM log WHERE partition = 0 AND '


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("topic", "partition", "offset", micros().alias("timestamp_us"), "key", "value")


@query("read_last", _READ + '"offset" > (SELECT max("offset") FROM log WHERE partition = 0) - 50', "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 50))


@query("read_from_offset", _READ + '"offset" BETWEEN 10 AND 34', "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 25, 10))


@query("read_back", _READ + '"offset" BETWEEN (SELECT max("offset") + 1 - 20 - 30 + 1 FROM log WHERE partition = 0) AND (SELECT max("offset") + 1 - 30 FROM log WHERE partition = 0)', "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 20, -30))


@query("read_more_than_all", _READ + "true", "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 10**9, -2))


@query("read_from_time", _READ + f'"offset" >= (SELECT min("offset") FROM log WHERE partition = 0 AND us >= {T0 + 10 * 86_400_000_000}) AND "offset" < (SELECT min("offset") FROM log WHERE partition = 0 AND us >= {T0 + 10 * 86_400_000_000}) + 40', "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 40, datetime(2024, 1, 11)))


@query("read_beyond_time", _READ + "false", "log")
def _(s, d):
    return _read(R.read_topic(log(s, d), "events", 0, 40, datetime(2034, 1, 1)))


@query(
    "partition_offsets",
    """SELECT s.topic, s.partition, s.spec, s.at_us, coalesce(CASE s.spec WHEN 'earliest' THEN m.low WHEN 'latest' THEN m.high WHEN 'max_timestamp' THEN m.newest
    ELSE (SELECT min(k."offset") FROM skewed k WHERE k.topic = s.topic AND k.partition = s.partition AND k.us >= s.at_us) END, -1) AS "offset",
    coalesce(CASE WHEN s.spec = 'max_timestamp' THEN m.us END, -1) AS ts_us
    FROM specs s LEFT JOIN (SELECT topic, partition, min("offset") AS low, max("offset") + 1 AS high, max(us) AS us, arg_max("offset", CAST(us AS HUGEINT) * 1000000 - "offset") AS newest FROM skewed GROUP BY ALL) m USING (topic, partition)""",
    "skewed specs",
)
def _(s, d):
    return R.partition_offsets(skewed(s, d), frame(s, "specs"))


@query("offsets_for_times", """SELECT t.topic, t.partition, t.at_us, coalesce(min(CASE WHEN k.us >= t.at_us THEN k."offset" END), -1) AS "offset" FROM times t LEFT JOIN skewed k USING (topic, partition) GROUP BY ALL""", "skewed times")
def _(s, d):
    return R.offsets_for_times(skewed(s, d), frame(s, "times"))


@query("last_stable", """SELECT topic, partition, max("offset") + 1 AS latest, coalesce(min(CASE WHEN event_id % 40 = 39 AND event_id > 5000 THEN "offset" END), max("offset") + 1) AS stable FROM tlog GROUP BY ALL""", "tlog")
def _(s, d):
    return R.last_stable(tlog(s, d).withColumn("committed", ~((F.col("event_id") % 40 == 39) & (F.col("event_id") > 5000))))


@query("topic_info", "SELECT topic, count(*) AS partition_count, max(len(replicas)) AS replication_factor FROM cluster_topics GROUP BY topic", "cluster_topics")
def _(s, d):
    return R.topic_info(frame(s, "cluster_topics")).withColumn("replication_factor", F.col("replication_factor").cast("long"))


@query(
    "cluster_info",
    """SELECT b.node_id, b.host, count(DISTINCT c.topic) AS topics, count(c.partition) AS partitions, count(CASE WHEN c.replicas[1] = b.node_id THEN 1 END) AS leads
    FROM brokers b LEFT JOIN cluster_topics c ON list_contains(c.replicas, b.node_id) GROUP BY ALL""",
    "brokers cluster_topics",
)
def _(s, d):
    return R.cluster_info(frame(s, "brokers"), frame(s, "cluster_topics"))


@query("eof", "SELECT p.topic, p.partition, p.position, coalesce(p.position >= m.high, true) AS eof FROM positions p LEFT JOIN marks_of m USING (topic, partition)", "positions marks_of")
def _(s, d):
    return R.at_end(tlog(s, d), frame(s, "positions"))


@query("poll_dedupe", 'SELECT topic, partition, "offset", event_id, 0 AS poll FROM log', "log")
def _(s, d):
    rows = log(s, d).select("topic", "partition", "offset", "event_id")
    again = rows.filter("event_id % 5 = 0").withColumn("poll", F.lit(1))
    return R.distinct_offsets(rows.withColumn("poll", F.lit(0)).unionByName(again), "poll")


@query("revoked_rows", 'SELECT topic, partition, count(*) AS n, max("offset") AS last FROM tlog t WHERE NOT EXISTS (SELECT 1 FROM revoked r WHERE r.topic = t.topic AND r.partition = t.partition) GROUP BY ALL', "tlog revoked")
def _(s, d):
    return R.without_partitions(tlog(s, d), frame(s, "revoked")).groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


# --------------------------------------------------------------------------- payloads


@query("payload_json", "SELECT topic, partition, \"offset\", CAST(json_extract(value, '$.k') AS BIGINT) AS k FROM log", "log")
def _(s, d):
    parse = payload.json_strict("k long")
    return payload.parsed(log(s, d), {"events": parse}, parse).select("topic", "partition", "offset", "payload.k")


@query("payload_variant", "SELECT topic, sum(CAST(json_extract(value, '$.k') AS BIGINT))::BIGINT AS k FROM tlog GROUP BY topic", "tlog")
def _(s, d):
    parsed = payload.parsed(tlog(s, d), {}, payload.json_variant)
    return parsed.groupBy("topic").agg(F.sum(F.variant_get("payload", "$.k", "long")).alias("k"))


@query("payload_by_topic", "SELECT topic, partition, \"offset\", CASE topic WHEN 'click' THEN CAST(json_extract(value, '$.k') AS VARCHAR) WHEN 'view' THEN upper(value) ELSE value END AS payload FROM tlog", "tlog")
def _(s, d):
    parsers = {"click": lambda v: payload.field(v, "k"), "view": F.upper}
    return payload.parsed(tlog(s, d), parsers).select("topic", "partition", "offset", "payload")


_MIXED = "CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN '{broken' WHEN 2 THEN key WHEN 3 THEN event_type ELSE '#' || key END"


def _mixed(s, d):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.col("value")).when(kind == 1, "{broken").when(kind == 2, F.col("key")).when(kind == 3, F.col("event_type")).otherwise(F.concat(F.lit("#"), "key"))
    return log(s, d).withColumn("value", text)


@query("payload_quarantine", f"SELECT status, count(*) AS n, min(raw) AS least FROM (SELECT CASE WHEN v IS NULL THEN 'null' WHEN json_valid(v) THEN 'valid' ELSE 'malformed' END AS status, v AS raw FROM (SELECT {_MIXED} AS v FROM log)) GROUP BY status", "log")
def _(s, d):
    rows = _mixed(s, d).withColumn("status", payload.status(F.col("value")))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query("payload_formats", f"SELECT format, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'null' WHEN json_valid(v) THEN 'json' WHEN regexp_full_match(v, '[0-9]+') THEN 'digits' WHEN regexp_full_match(v, '[A-Za-z]+') THEN 'letters' ELSE 'binary' END AS format FROM (SELECT {_MIXED} AS v FROM log)) GROUP BY format", "log")
def _(s, d):
    return _mixed(s, d).groupBy(payload.payload_format(F.col("value")).alias("format")).agg(F.count("*").alias("n"))


@query("tombstones", 'SELECT topic, partition, "offset", key FROM tlog WHERE key IS NOT NULL AND value IS NULL', "tlog")
def _(s, d):
    return tlog(s, d).filter(payload.tombstone(F.col("key"), F.col("value"))).select("topic", "partition", "offset", "key")


@query("headers_round_trip", "SELECT \"offset\", partition, event_type AS kind, '[\"' || key || '\",\"' || event_type || '\"]' AS tags FROM log", "log")
def _(s, d):
    made = payload.headers([("kind", F.col("event_type"), False), ("tags", F.array("key", "event_type"), True)])
    rows = log(s, d).withColumn("headers", made)
    return rows.select("offset", "partition", payload.header(F.col("headers"), "kind").alias("kind"), payload.header(F.col("headers"), "tags").alias("tags"))


# --------------------------------------------------------------------------- batches


@query("batch_slices", 'SELECT topic, partition, batch, count(*) AS size, min("offset") AS first_offset FROM sliced GROUP BY ALL', "sliced")
def _(s, d):
    return sliced(s, d).groupBy("topic", "partition", "batch").agg(F.count("*").alias("size"), F.min("offset").alias("first_offset"))


@query("batch_gaps", 'SELECT partition, batch, count(*) AS size, min("offset") AS first_offset, max("offset") AS last_offset FROM (SELECT *, CAST((row_number() OVER (PARTITION BY partition ORDER BY "offset") - 1) // 64 AS BIGINT) AS batch FROM log WHERE "offset" % 3 <> 0) GROUP BY ALL', "log")
def _(s, d):
    return B.batches(log(s, d).filter("offset % 3 <> 0"), 64).groupBy("partition", "batch").agg(F.count("*").alias("size"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("batch_metadata", f"SELECT topic, partition, batch, size, first_offset, last_offset, least(created_us, {T0 + 15 * 86_400_000_000}) AS created_us FROM meta", "meta")
def _(s, d):
    return B.batch_metadata(sliced(s, d), F.lit(T0 + 15 * 86_400_000_000))


def _lags(s, d):
    rows = B.batch_metadata(sliced(s, d), F.lit(_FAR))
    scheduled = F.col("created_us") + 1_499 + F.col("batch") * 7
    processed = F.when(F.col("batch") % 10 != 9, scheduled + 250_500 + F.col("partition"))
    return rows.withColumn("consumption_lag", B.lag_ms(processed, F.col("created_us"))).withColumn("processing_lag", B.lag_ms(processed, scheduled))


_LAGS = """SELECT topic, partition, batch, size, last_offset, CASE WHEN batch % 10 <> 9 THEN (1499 + batch * 7 + 250500 + partition + 500) // 1000 ELSE -1 END AS consumption_lag,
 CASE WHEN batch % 10 <> 9 THEN (250500 + partition + 500) // 1000 ELSE -1 END AS processing_lag FROM meta"""


@query("batch_lags", _LAGS, "meta")
def _(s, d):
    return _lags(s, d).select("topic", "partition", "batch", "size", "last_offset", "consumption_lag", "processing_lag")


@query("batch_values", """SELECT topic, partition, batch, count(*) AS size, arg_min(struct_pack(v := value), "offset").v AS first_value, arg_max(struct_pack(v := value), "offset").v AS last_value, count(CASE WHEN value IS NULL THEN 1 END) AS tombstones FROM sliced GROUP BY ALL""", "sliced")
def _(s, d):
    return B.batch_values(sliced(s, d))


@query("group_by_partition", 'SELECT topic, partition, count(*) AS n FROM tlog GROUP BY ALL', "tlog")
def _(s, d):
    return tlog(s, d).groupBy("topic", "partition").agg(F.count("*").alias("n"))


@query("rate_limited", 'SELECT partition, "offset", CAST("offset" // 50 AS BIGINT) AS slot, CAST("offset" // 50 * 2000 AS BIGINT) AS not_before_ms FROM log', "log")
def _(s, d):
    return B.rate_limited(log(s, d), 50, 2000).select("partition", "offset", "slot", "not_before_ms")


@query("feedback_loop", "WITH RECURSIVE loop AS (SELECT 0 AS turn, 3 AS value UNION ALL SELECT turn + 1, value * 2 + 1 FROM loop WHERE turn < 12) SELECT turn, CAST(value AS BIGINT) AS value FROM loop")
def _(s, d):
    return s.sql("WITH RECURSIVE loop(turn, value) AS (SELECT 0, CAST(3 AS BIGINT) UNION ALL SELECT turn + 1, value * 2 + 1 FROM loop WHERE turn < 12) SELECT turn, value FROM loop")


# --------------------------------------------------------------------------- cursors


@query("cursors", 'SELECT topic, partition, arg_max("offset", seq) + 1 AS cursor, count(*) AS marks FROM marks WHERE NOT revoked GROUP BY ALL', "marks")
def _(s, d):
    return C.cursors(frame(s, "marks"))


@query("mark_results", """SELECT seq, topic, partition, "offset", NOT revoked AS result, NOT revoked AND coalesce(before <> "offset", true) AS stored FROM (SELECT *, last_value(CASE WHEN NOT revoked THEN "offset" END IGNORE NULLS) OVER (PARTITION BY topic, partition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks)""", "marks")
def _(s, d):
    return C.mark_results(frame(s, "marks"))


@query(
    "consumer_lags",
    """SELECT g.group_id, g.topic, p.partition, CASE WHEN p.partition IS NOT NULL THEN CASE WHEN c."offset" >= 0 THEN c."offset" ELSE -1 END END AS "offset",
    CASE WHEN p.partition IS NOT NULL THEN CASE WHEN c."offset" >= 0 THEN coalesce(m.high, 0) - c."offset" ELSE -1 END END AS lag
    FROM (SELECT DISTINCT group_id, topic FROM routes WHERE active) g LEFT JOIN cluster_topics p USING (topic)
    LEFT JOIN committed c ON c.group_id = g.group_id AND c.topic = g.topic AND c.partition = p.partition LEFT JOIN marks_of m ON m.topic = g.topic AND m.partition = p.partition""",
    "routes cluster_topics committed marks_of",
)
def _(s, d):
    return C.lags(frame(s, "routes"), frame(s, "cluster_topics"), frame(s, "committed"), tlog(s, d))


@query(
    "group_seek",
    """WITH wide AS (SELECT s.seq, s.group_id, s.topic, coalesce(s.partition, c.partition) AS partition, s.kind, s.value FROM seeks s LEFT JOIN cluster_topics c ON s.partition IS NULL AND c.topic = s.topic),
    last AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY group_id, topic, partition ORDER BY seq DESC) = 1)
    SELECT l.group_id, l.topic, l.partition, CASE l.kind WHEN 'earliest' THEN m.low WHEN 'latest' THEN m.high WHEN 'offset' THEN l.value
    ELSE coalesce((SELECT min(k."offset") FROM tlog k WHERE k.topic = l.topic AND k.partition = l.partition AND k.us >= l.value), m.high) END AS "offset" FROM last l LEFT JOIN marks_of m USING (topic, partition)""",
    "seeks cluster_topics marks_of",
)
def _(s, d):
    return C.seek(frame(s, "seeks"), frame(s, "cluster_topics"), tlog(s, d))


_COPY = """SELECT group_id, topic, partition, "offset" FROM committed c WHERE NOT (group_id = 'audit' AND EXISTS (SELECT 1 FROM committed a WHERE a.group_id = 'app' AND a."offset" >= 0 AND a.topic = c.topic AND a.partition = c.partition))
 UNION ALL SELECT 'audit', topic, partition, "offset" FROM committed WHERE group_id = 'app' AND "offset" >= 0"""


@query("group_copy", _COPY, "committed")
def _(s, d):
    return C.copy_group(frame(s, "committed"), "app", "audit")


@query("group_rename", f"SELECT * FROM ({_COPY}) WHERE group_id <> 'app'", "committed")
def _(s, d):
    return C.rename_group(frame(s, "committed"), "app", "audit")


@query("committed_offsets", "SELECT topic, partition, \"offset\" FROM committed WHERE group_id = 'app'", "committed")
def _(s, d):
    return frame(s, "committed").filter("group_id = 'app'").select("topic", "partition", "offset")


# --------------------------------------------------------------------------- failures

_WAIT = "CAST(least(power(2, {a}) * 1000, 30000) AS BIGINT)"
_ATTEMPTS = f"""SELECT partition, "offset", attempt, failed, decision, attempt > 1 AS retrying, CASE WHEN NOT failed THEN 0 WHEN decision = 'dispatch' THEN 1000 ELSE {_WAIT.format(a="attempt")} END AS wait_ms FROM (
 SELECT *, CASE WHEN NOT failed THEN 'mark' WHEN error_class = 'SystemExit' THEN 'retry' WHEN attempt <= {{n}} THEN 'retry' ELSE 'dispatch' END AS decision FROM (
 SELECT *, attempt <= fails_for AS failed FROM (SELECT *, CAST(unnest(range(1, CASE WHEN error_class = 'SystemExit' THEN fails_for + 1 ELSE least(fails_for, {{n}}) + 1 END + 1)) AS INTEGER) AS attempt FROM failing WHERE fails_for > 0)))"""


def _attempts(s, d, n):
    return X.attempts(failing(s, d), DeadLetters("dead", max_retries=n)).select("partition", "offset", "attempt", "failed", "decision", "retrying", "wait_ms")


@query("retry_attempts", _ATTEMPTS.format(n=3), "failing")
def _(s, d):
    return _attempts(s, d, 3)


@query("retry_none", _ATTEMPTS.format(n=0), "failing")
def _(s, d):
    return _attempts(s, d, 0)


@query("backoff", f"SELECT attempt, {_WAIT.format(a='attempt')} AS exponential_ms, CAST(1000 AS BIGINT) AS constant_ms FROM (SELECT CAST(unnest(range(0, 12)) AS BIGINT) AS attempt)")
def _(s, d):
    rows = s.range(12).withColumnRenamed("id", "attempt")
    return rows.select("attempt", Pause().wait(F.col("attempt")).alias("exponential_ms"), Pause(exponential=False).wait(F.col("attempt")).alias("constant_ms"))


@query("dead_letters", "SELECT 'dead' AS topic, value FROM failing WHERE fails_for > 2 AND error_class <> 'SystemExit'", "failing")
def _(s, d):
    return X.dead_letters(failing(s, d), DeadLetters("dead", max_retries=2))


@query("dead_letters_with_origin", "SELECT 'dead' AS topic, value, key, 'events' AS source_topic, partition AS source_partition, \"offset\" AS source_offset FROM failing WHERE fails_for > 3 AND error_class <> 'SystemExit'", "failing")
def _(s, d):
    return X.dead_letters(failing(s, d), DeadLetters("dead"), extra=True)


@query("dead_letters_skipped", "SELECT CAST(NULL AS VARCHAR) AS topic, value FROM failing WHERE false", "failing")
def _(s, d):
    return X.dead_letters(failing(s, d), DeadLetters(topic=False))


_USED = "(CASE WHEN w.dead THEN 0 ELSE w.total END) + f.fails_for"


@query(
    "shared_retries",
    f"""WITH RECURSIVE f AS (SELECT *, error_class = 'SystemExit' AS critical, row_number() OVER (PARTITION BY topic, partition, batch ORDER BY "offset") AS no
    FROM (SELECT *, CAST((row_number() OVER (PARTITION BY topic, partition ORDER BY "offset") - 1) // 100 AS BIGINT) AS batch FROM failing) WHERE fails_for > 0),
    walk AS (SELECT topic, partition, batch, "offset", no, fails_for AS total, NOT critical AND fails_for > 3 AS dead FROM f WHERE no = 1
    UNION ALL SELECT f.topic, f.partition, f.batch, f."offset", f.no, {_USED}, NOT f.critical AND {_USED} > 3 FROM walk w JOIN f ON f.topic = w.topic AND f.partition = w.partition AND f.batch = w.batch AND f.no = w.no + 1)
    SELECT topic, partition, batch, "offset" FROM walk WHERE dead""",
    "failing",
)
def _(s, d):
    return X.shared_attempts(B.batches(failing(s, d), 100), DeadLetters("dead"))


@query("skippable", 'SELECT topic, partition, batch, coalesce(min(CASE WHEN "offset" = c.cursor THEN "offset" END), min("offset")) AS "offset" FROM sliced LEFT JOIN (SELECT partition, CAST(250 + partition AS BIGINT) AS cursor FROM (SELECT DISTINCT partition FROM log) WHERE partition < 3) c USING (partition) GROUP BY ALL', "sliced")
def _(s, d):
    cursors = s.createDataFrame([("events", p, 250 + p) for p in range(3)], "topic string, partition int, cursor long")
    return X.skippable(sliced(s, d), cursors)


@query("dlq_cursor", 'SELECT topic, partition, max("offset") + 1 AS cursor FROM failing GROUP BY ALL', "failing")
def _(s, d):
    return X.final_cursors(failing(s, d), DeadLetters("dead"))


@query("dlq_cursor_manual", "SELECT topic, partition, max(\"offset\") + 1 AS cursor FROM failing WHERE fails_for > 3 AND error_class <> 'SystemExit' GROUP BY ALL", "failing")
def _(s, d):
    return X.final_cursors(failing(s, d), DeadLetters("dead", mark_after_dispatch=True), manual=True)


@query("job_dispatch", f"SELECT job_id, queue AS topic, coalesce(method, 'produce_async') AS method, CASE WHEN run_at_us IS NULL OR run_at_us <= {NOW} THEN 'dispatched' ELSE 'not_implemented' END AS outcome FROM jobs", "jobs")
def _(s, d):
    return X.dispatch_jobs(frame(s, "jobs"), NOW)


# --------------------------------------------------------------------------- metrics


@query("batch_metrics", f"SELECT topic, partition, sum(size)::BIGINT AS messages, count(*) AS batches, arg_max(last_offset, batch) AS \"offset\", min(size) AS min_size, max(size) AS max_size, max(consumption_lag) AS max_consumption_lag, max(processing_lag) AS max_processing_lag FROM ({_LAGS}) GROUP BY ALL", "meta")
def _(s, d):
    return M.batch_metrics(_lags(s, d))


@query(
    "batch_histograms",
    f"""WITH f AS (SELECT topic, partition, unnest(['size', 'consumption_lag', 'processing_lag']) AS figure, unnest([size, consumption_lag, processing_lag]) AS value FROM ({_LAGS})),
    r AS (SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY topic, partition, figure) AS n FROM f WHERE value >= 0 WINDOW w AS (PARTITION BY topic, partition, figure ORDER BY value))
    SELECT topic, partition, figure, share, CAST(value AS BIGINT) AS value FROM r, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS share) WHERE no = ceil(share * n)""",
    "meta",
)
def _(s, d):
    return M.batch_histograms(_lags(s, d))


@query("poll_metrics", "SELECT subscription_group, count(*) AS polls, sum(messages)::BIGINT AS messages, sum(time_ms)::BIGINT AS time_ms, max(time_ms) AS max_time_ms, count(CASE WHEN messages = 0 THEN 1 END) AS empty FROM polls GROUP BY ALL", "polls")
def _(s, d):
    return M.poll_metrics(frame(s, "polls"))


@query("error_counts", "SELECT error_type, topic, count(*) AS errors FROM errors GROUP BY ALL", "errors")
def _(s, d):
    return M.error_counts(frame(s, "errors"))


_BUSY = "SELECT queue, seq, least(n, 3) AS busy, greatest(n - 3, 0) AS enqueued FROM (SELECT queue, seq, CAST(sum(change) OVER (PARTITION BY queue ORDER BY seq) AS BIGINT) AS n FROM job_events)"


@query("jobs_statistics", _BUSY, "job_events")
def _(s, d):
    return M.jobs_statistics(frame(s, "job_events"), 3)


@query("worker_metrics", f"SELECT queue, 3 AS total, max(busy) AS max_busy, max(enqueued) AS max_enqueued, arg_max(busy, seq) AS busy, arg_max(enqueued, seq) AS enqueued FROM ({_BUSY}) GROUP BY queue", "job_events")
def _(s, d):
    return M.worker_metrics(M.jobs_statistics(frame(s, "job_events"), 3), 3)


_STATS = """own AS (SELECT group_id, emitted_us, json::JSON AS j FROM statistics WHERE json_extract_string(json, '$.name') = client_name),
 tops AS (SELECT group_id, emitted_us, unnest(json_keys(j, '$.topics')) AS topic, j FROM own),
 parts AS (SELECT group_id, emitted_us, topic, partition, CAST(json_extract(j, '$.topics.' || topic || '.partitions.\"' || partition || '\".consumer_lag') AS BIGINT) AS consumer_lag,
 CAST(json_extract(j, '$.topics.' || topic || '.partitions.\"' || partition || '\".consumer_lag_stored') AS BIGINT) AS consumer_lag_stored, json_extract_string(j, '$.topics.' || topic || '.partitions.\"' || partition || '\".fetch_state') AS fetch_state
 FROM (SELECT *, unnest(json_keys(j, '$.topics.' || topic || '.partitions')) AS partition FROM tops))"""


@query(
    "flat_statistics",
    f"""WITH {_STATS}, brokers AS (SELECT group_id, emitted_us, name, CAST(json_extract(j, '$.brokers.' || name || '.nodeid') AS BIGINT) AS node, CAST(json_extract(j, '$.brokers.' || name || '.rtt.p95') AS BIGINT) AS p95, CAST(json_extract(j, '$.brokers.' || name || '.connects') AS BIGINT) AS connects FROM (SELECT *, unnest(json_keys(j, '$.brokers')) AS name FROM own))
    SELECT group_id, emitted_us, 'broker' AS scope, name, CAST(NULL AS VARCHAR) AS partition, 'rtt.p95' AS metric, p95 AS value FROM brokers WHERE node <> -1 UNION ALL SELECT group_id, emitted_us, 'broker', name, NULL, 'connects', connects FROM brokers WHERE node <> -1
    UNION ALL SELECT group_id, emitted_us, 'topic', topic, partition, 'consumer_lag', consumer_lag FROM parts WHERE partition <> '-1' AND fetch_state NOT IN ('stopped', 'none') AND consumer_lag <> -1
    UNION ALL SELECT group_id, emitted_us, 'topic', topic, partition, 'consumer_lag_stored', consumer_lag_stored FROM parts WHERE partition <> '-1' AND fetch_state NOT IN ('stopped', 'none') AND consumer_lag_stored <> -1""",
    "statistics",
)
def _(s, d):
    return M.flat_statistics(frame(s, "statistics"))


@query("topic_lags", f"WITH {_STATS} SELECT group_id, emitted_us, topic, coalesce(sum(consumer_lag) FILTER (ok), 0)::BIGINT AS consumer_lag, coalesce(sum(consumer_lag_stored) FILTER (ok), 0)::BIGINT AS consumer_lag_stored FROM (SELECT *, partition <> '-1' AND consumer_lag <> -1 AND consumer_lag_stored <> -1 AS ok FROM parts) GROUP BY ALL", "statistics")
def _(s, d):
    return M.topic_lags(frame(s, "statistics"))


_INSIGHT = f"SELECT group_id, topic, CAST(partition AS INTEGER) AS partition, arg_max(consumer_lag, emitted_us) AS consumer_lag, arg_max(consumer_lag_stored, emitted_us) AS consumer_lag_stored, max(emitted_us) AS emitted_us FROM parts WHERE emitted_us >= {NOW - M.TTL_US} AND partition <> '-1' AND fetch_state NOT IN ('stopped', 'none') GROUP BY ALL"


@query("insights", f"WITH {_STATS} {_INSIGHT}", "statistics")
def _(s, d):
    return M.insights(frame(s, "statistics"), NOW)


@query("batch_insights", f"WITH {_STATS}, i AS ({_INSIGHT}) SELECT t.topic, t.partition, t.n, i.consumer_lag, i.consumer_lag IS NOT NULL AS has_insights FROM (SELECT topic, partition, count(*) AS n FROM tlog GROUP BY ALL) t LEFT JOIN i ON i.group_id = 'app' AND i.topic = t.topic AND i.partition = t.partition", "statistics tlog")
def _(s, d):
    known = M.insights(frame(s, "statistics"), NOW).filter("group_id = 'app'").select("topic", "partition", "consumer_lag")
    rows = tlog(s, d).groupBy("topic", "partition").agg(F.count("*").alias("n"))
    return rows.join(known, ["topic", "partition"], "left").withColumn("has_insights", F.col("consumer_lag").isNotNull())


@query("liveness", f"SELECT node, NOT (bool_or(late) OR bool_or(bad)) AS healthy, coalesce(string_agg(CASE WHEN late THEN kind END, ',' ORDER BY kind), '') AS late FROM (SELECT node, kind, {NOW} - max(at_us) > 300000000 AS late, bool_or(unrecoverable) AS bad FROM ticks GROUP BY ALL) GROUP BY node", "ticks")
def _(s, d):
    return M.liveness(frame(s, "ticks"), NOW, {"polling": 300_000_000, "consuming": 300_000_000})


@query("swarm_sweep", f"SELECT node, CASE WHEN NOT alive THEN CASE WHEN {NOW} - died_us >= 5000000 THEN 'restart' ELSE 'cleanup' END WHEN hanging THEN 'kill' WHEN status > 0 THEN 'stop' WHEN {NOW} - reported_us > 60000000 THEN 'stop' ELSE 'none' END AS action FROM heartbeats", "heartbeats")
def _(s, d):
    return M.sweep(frame(s, "heartbeats"), NOW)


_STATES = ", ".join(f"'{x}'" for x in M.PROCESS_STATES)


@query("process_states", f"SELECT process, arg_max(state, r) AS state, CAST(max(r) AS BIGINT) AS rank FROM (SELECT *, list_position([{_STATES}], state) AS r FROM transitions) GROUP BY process", "transitions")
def _(s, d):
    return M.states(frame(s, "transitions"))


@query(
    "assignments",
    """WITH each AS (SELECT seq, type, subscription_group, topic, unnest(partitions) AS partition FROM rebalances WHERE type <> 'reset'),
    last AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY subscription_group, topic, partition ORDER BY seq DESC) = 1)
    SELECT subscription_group, topic, string_agg(CAST(partition AS VARCHAR), ',' ORDER BY partition) AS partitions FROM last l
    WHERE type = 'assign' AND seq > coalesce((SELECT max(seq) FROM rebalances r WHERE r.type = 'reset' AND r.subscription_group = l.subscription_group), -1) GROUP BY ALL""",
    "rebalances",
)
def _(s, d):
    return M.assignments(frame(s, "rebalances"))


@query("generations", "SELECT topic, partition, count(CASE WHEN type = 'assign' THEN 1 END) AS generation FROM (SELECT type, topic, unnest(partitions) AS partition FROM rebalances WHERE type <> 'reset') GROUP BY ALL", "rebalances")
def _(s, d):
    return M.generations(frame(s, "rebalances"))


# --------------------------------------------------------------------------- routes


@query("active_topics", "SELECT group_id, topic, position FROM routes WHERE active AND group_id IN ('app', 'audit') AND topic NOT IN ('view', 'x.y')", "routes")
def _(s, d):
    return routes.active_topics(frame(s, "routes"), {"consumer_groups": ["app", "audit"]}, {"consumer_groups": ["app"], "topics": ["view", "x.y"]}).select("group_id", "topic", "position")


@query("subscriptions", "SELECT group_id, subscription_group, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM routes WHERE active GROUP BY ALL", "routes")
def _(s, d):
    return routes.subscriptions(frame(s, "routes"))


@query("route_lookup", "SELECT group_id, topic, consumer, position FROM routes WHERE topic = 'click' AND initial_offset = 'latest' ORDER BY position LIMIT 1", "routes")
def _(s, d):
    return routes.find(frame(s, "routes"), topic="click", initial_offset="latest").select("group_id", "topic", "consumer", "position")


@query("default_settings", "SELECT topic, position, coalesce(kafka['statistics.interval.ms'], '5000') AS statistics_ms, coalesce(kafka['max.poll.interval.ms'], '300000') AS poll_ms, CAST(cardinality(kafka) + 2 AS BIGINT) AS settings FROM routes", "routes")
def _(s, d):
    return routes.with_defaults(frame(s, "routes")).select("topic", "position", F.col("kafka")["statistics.interval.ms"].alias("statistics_ms"), F.col("kafka")["max.poll.interval.ms"].alias("poll_ms"), F.size("kafka").cast("long").alias("settings"))


@query(
    "subscription_groups",
    """WITH keyed AS (SELECT *, concat_ws('|', CAST(kafka AS VARCHAR), max_messages, max_wait_time, initial_offset, coalesce(subscription_group, '')) AS k FROM routes),
    firsts AS (SELECT *, min(position) OVER (PARTITION BY group_id, k) AS f FROM keyed), numbers AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY group_id ORDER BY f) - 1 AS INTEGER) AS number FROM firsts)
    SELECT group_id, topic, number, concat_ws('_', group_id, subscription_group, number) AS id FROM numbers""",
    "routes",
)
def _(s, d):
    return routes.subscription_groups(frame(s, "routes"))


def _rules(table: str, rules: dict[str, str], *names: str) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(names)}, '{rule}' AS rule FROM {table} WHERE {when}" for rule, when in rules.items())


@query("topic_violations", _rules("routes", {"name_format": r"NOT regexp_full_match(topic, '[a-zA-Z0-9\._\-]+')", "max_messages": "max_messages < 1", "max_wait_time": "max_wait_time < 10", "initial_offset": "initial_offset NOT IN ('earliest', 'latest')", "consumer_missing": "active AND consumer IS NULL", "bootstrap_servers_missing": "kafka['bootstrap.servers'] IS NULL", "mixed_separators": "contains(topic, '.') AND contains(topic, '_')"}, "group_id", "topic"), "routes")
def _(s, d):
    return routes.topic_violations(frame(s, "routes"))


@query("group_violations", """SELECT group_id, topic, 'repeated_topic' AS rule FROM routes GROUP BY group_id, topic HAVING count(*) > 1 UNION ALL SELECT group_id, topic, 'several_consumers' FROM routes GROUP BY group_id, topic HAVING count(DISTINCT consumer) > 1
 UNION ALL SELECT group_id, min(topic), 'separator_collision' FROM routes GROUP BY group_id, replace(topic, '.', '_') HAVING count(DISTINCT topic) > 1""", "routes")
def _(s, d):
    return routes.group_violations(frame(s, "routes"))


@query("undeclared_topics", "SELECT topic FROM routes WHERE active UNION SELECT dlq_topic FROM dlq_config WHERE dlq_topic IS NOT NULL EXCEPT SELECT topic FROM declarations", "routes dlq_config declarations")
def _(s, d):
    return routes.undeclared(frame(s, "routes"), frame(s, "dlq_config"), frame(s, "declarations"))


@query("dlq_violations", _rules("dlq_config", {"max_retries": "max_retries IS NULL OR max_retries < 0", "dlq_topic_format": r"dlq_topic IS NOT NULL AND NOT regexp_full_match(dlq_topic, '[a-zA-Z0-9\._\-]+')", "dispatch_method": "dispatch_method NOT IN ('produce_async', 'produce_sync')", "marking_method": "marking_method NOT IN ('mark_as_consumed', 'mark_as_consumed!')"}, "topic"), "dlq_config")
def _(s, d):
    return routes.dead_letter_violations(frame(s, "dlq_config"))


# --------------------------------------------------------------------------- topics, replication, access

_SIZES = "sizes AS (SELECT topic, CAST(count(*) AS INTEGER) AS existing FROM cluster_topics GROUP BY topic)"


@query("plan_create", "SELECT topic, partitions, replication_factor, CAST(to_json(details) AS VARCHAR) AS details FROM declarations WHERE active AND topic NOT IN (SELECT topic FROM cluster_topics)", "declarations cluster_topics")
def _(s, d):
    return topics.to_create(frame(s, "declarations"), frame(s, "cluster_topics"))


@query("plan_repartition", f"WITH {_SIZES} SELECT topic, existing, partitions, CASE WHEN existing < partitions THEN 'up' ELSE 'down' END AS direction FROM declarations JOIN sizes USING (topic) WHERE active AND existing <> partitions", "declarations cluster_topics")
def _(s, d):
    return topics.to_repartition(frame(s, "declarations"), frame(s, "cluster_topics"))


_WANTED = """wanted AS (SELECT topic, unnest(map_keys(details)) AS key, unnest(map_values(details)) AS wanted FROM declarations WHERE active AND topic IN (SELECT topic FROM cluster_topics)),
 actual AS (SELECT resource_name AS topic, value AS actual, list_distinct([name] || coalesce(synonyms, [])) AS names FROM configs WHERE resource_type = 'topic')"""


@query("plan_alter", f"WITH {_WANTED} SELECT w.topic, w.key, a.actual, w.wanted, CASE WHEN a.actual IS NULL THEN 'add' ELSE 'change' END AS action FROM wanted w LEFT JOIN actual a ON a.topic = w.topic AND list_contains(a.names, w.key) WHERE a.actual IS NULL OR a.actual <> w.wanted", "declarations cluster_topics configs")
def _(s, d):
    return topics.to_alter(frame(s, "declarations"), frame(s, "cluster_topics"), frame(s, "configs"))


@query("plan_align", f"WITH {_WANTED} SELECT w.topic, w.key, w.wanted FROM wanted w JOIN actual a ON a.topic = w.topic AND list_contains(a.names, w.key) WHERE a.actual <> w.wanted", "declarations cluster_topics configs")
def _(s, d):
    return topics.to_align(frame(s, "declarations"), frame(s, "cluster_topics"), frame(s, "configs"))


@query("plan_migrated", f"WITH {_SIZES} SELECT coalesce(s.topic, c.topic) AS topic, greatest(coalesce(existing, 0), coalesce(partitions, 0)) AS partitions FROM (SELECT * FROM declarations WHERE active) c FULL JOIN sizes s ON s.topic = c.topic", "declarations cluster_topics")
def _(s, d):
    return topics.migrated(frame(s, "declarations"), frame(s, "cluster_topics"))


@query(
    "alter_configs",
    """SELECT coalesce(c.resource_type, o.resource_type) AS resource_type, coalesce(c.resource_name, o.resource_name) AS resource_name, coalesce(c.name, o.name) AS name,
    CASE WHEN o.op IS NULL THEN c.value WHEN o.op = 'set' THEN o.value WHEN o.op = 'append' THEN concat_ws(',', nullif(c.value, ''), o.value)
    ELSE array_to_string(list_filter(string_split(c.value, ','), lambda x: NOT list_contains(string_split(o.value, ','), x)), ',') END AS value
    FROM configs c FULL JOIN config_ops o ON c.resource_type = o.resource_type AND c.resource_name = o.resource_name AND c.name = o.name WHERE o.op IS NULL OR o.op <> 'delete'""",
    "configs config_ops",
)
def _(s, d):
    return topics.alter_configs(frame(s, "configs"), frame(s, "config_ops"))


@query("config_flags", "SELECT resource_type, resource_name, name, is_default > 0 AS is_default, is_read_only > 0 AS is_read_only, is_sensitive > 0 AS is_sensitive, is_synonym > 0 AS is_synonym FROM configs", "configs")
def _(s, d):
    return topics.config_flags(frame(s, "configs"))


@query("acl_describe", "SELECT * FROM acls WHERE resource_type = 'topic' AND operation = 'read'", "acls")
def _(s, d):
    return topics.matching_acls(frame(s, "acls"), resource_type="topic", resource_name="any", operation="read", principal="any")


@query("acl_all", "SELECT * FROM acls", "acls")
def _(s, d):
    return topics.matching_acls(frame(s, "acls"), resource_type="any", operation="any")


@query("acl_delete", "SELECT * FROM acls WHERE NOT (principal = 'User:a' AND resource_type = 'topic')", "acls")
def _(s, d):
    return topics.without_acls(frame(s, "acls"), principal="User:a", resource_type="topic")


_FREE = "SELECT topic, partition, replicas, list_sort(list_filter((SELECT list(node_id ORDER BY node_id) FROM brokers), lambda x: NOT list_contains(replicas, x))) AS free FROM cluster_topics WHERE topic = 'click'"
_PLAN = f"SELECT topic, partition, array_to_string(list_sort(replicas || list_transform(range(0, 4 - len(replicas)), lambda i: free[((partition + i) % len(free)) + 1])), ',') AS replicas FROM ({_FREE})"


@query("replication_plan", _PLAN, "brokers cluster_topics")
def _(s, d):
    return replication.plan(frame(s, "cluster_topics"), frame(s, "brokers"), "click", 4).withColumn("replicas", F.array_join("replicas", ","))


@query("replication_rebalance", "SELECT topic, partition, array_to_string(list_sort(list_transform(range(0, 3), lambda i: all_brokers[((partition + i) % len(all_brokers)) + 1])), ',') AS replicas FROM cluster_topics, (SELECT list(node_id ORDER BY node_id) AS all_brokers FROM brokers) WHERE topic = 'purchase'", "brokers cluster_topics")
def _(s, d):
    return replication.rebalance(frame(s, "cluster_topics"), frame(s, "brokers"), "purchase").withColumn("replicas", F.array_join("replicas", ","))


@query(
    "replication_violations",
    """WITH held AS (SELECT topic, arg_min(len(replicas), partition) AS current, list(partition) AS parts FROM cluster_topics GROUP BY topic), r AS (SELECT q.*, h.current, h.parts, (SELECT count(*) FROM brokers) AS n FROM replication_requests q LEFT JOIN held h USING (topic))
    SELECT topic, 'topic_missing' AS rule FROM r WHERE current IS NULL UNION ALL SELECT topic, 'target_not_above_current' FROM r WHERE target <= current UNION ALL SELECT topic, 'target_above_brokers' FROM r WHERE target > n
    UNION ALL SELECT topic, 'manual_incomplete' FROM r WHERE manual IS NOT NULL AND len(list_filter(parts, lambda x: NOT list_contains(manual, x))) > 0""",
    "cluster_topics brokers replication_requests",
)
def _(s, d):
    return replication.violations(frame(s, "cluster_topics"), frame(s, "brokers"), frame(s, "replication_requests"))


@query("replication_json", f"SELECT '{{\"version\":1,\"partitions\":[' || string_agg('{{\"topic\":\"' || topic || '\",\"partition\":' || partition || ',\"replicas\":[' || replicas || ']}}', ',' ORDER BY partition) || ']}}' AS json FROM ({_PLAN})", "brokers cluster_topics")
def _(s, d):
    return replication.as_json(replication.plan(frame(s, "cluster_topics"), frame(s, "brokers"), "click", 4))


@query("static_ids", "SELECT position, concat_ws('_', prefix, node, position) AS id FROM ids", "ids")
def _(s, d):
    return frame(s, "ids").select("position", ids.static_id(F.col("prefix"), F.col("node"), F.col("position")).alias("id"))


@query("short_hashes", "SELECT n, substr(sha256(CAST(n AS VARCHAR)), 1, 12) AS hash FROM (SELECT CAST(unnest(range(0, 20)) AS BIGINT) AS n)")
def _(s, d):
    return s.range(20).select(F.col("id").alias("n"), ids.short_hash(F.col("id")).alias("hash"))
