"""Small catalog and event tables for the queries, written once for Spark and for SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

T0 = 1_704_067_200_000_000  # 2024-01-01 in microseconds
NOW = T0 + 3_600_000_000


def _stats(client: str, brokers: dict, topics: dict) -> str:
    broker = {k: {"nodeid": n, "rtt": {"p95": p}, "connects": c} for k, (n, p, c) in brokers.items()}
    topic = {t: {"partitions": {p: {"consumer_lag": a, "consumer_lag_stored": b, "fetch_state": s} for p, (a, b, s) in parts.items()}} for t, parts in topics.items()}
    return json.dumps({"name": client, "brokers": broker, "topics": topic})


_K = {"bootstrap.servers": "b1:9092"}
#: name: (columns, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "routes": (
        "group_id string, topic string, consumer string, active boolean, max_messages int, max_wait_time int, initial_offset string, kafka map<string,string>, subscription_group string, position int",
        [
            ("app", "click", "Clicks", True, 100, 1000, "earliest", _K, None, 0),
            ("app", "view", "Views", True, 100, 1000, "earliest", _K, None, 1),
            ("app", "purchase", "Orders", True, 50, 1000, "earliest", _K, None, 2),
            ("app", "signup", "Signups", True, 100, 1000, "earliest", _K, "own", 3),
            ("app", "missing", "Nothing", True, 100, 1000, "earliest", _K, None, 4),
            ("audit", "click", "Audit", True, 100, 1000, "latest", _K, None, 5),
            ("audit", "error", "Errors", False, 100, 1000, "latest", _K, None, 6),
            ("audit", "a.b_c", "Mixed", True, 0, 5, "newest", {}, None, 7),
            ("audit", "x.y", None, True, 10, 100, "latest", _K, None, 8),
            ("audit", "x_y", "Xy", True, 10, 100, "latest", _K, None, 9),
            ("audit", "click", "Other", True, 100, 1000, "latest", _K | {"client.id": "z"}, None, 10),
        ],
    ),
    "declarations": (
        "topic string, active boolean, partitions int, replication_factor int, details map<string,string>",
        [
            ("click", True, 4, 2, {"retention.ms": "86400000", "cleanup.policy": "delete"}),
            ("view", True, 6, 2, {"log.retention.ms": "1000"}),
            ("purchase", True, 2, 3, {"retention.ms": "604800000", "max.message.bytes": "2097152"}),
            ("signup", True, 4, 1, {}),
            ("orders", True, 3, 3, {"cleanup.policy": "compact"}),
            ("old", False, 1, 1, {}),
        ],
    ),
    "cluster_topics": (
        "topic string, partition int, replicas array<int>",
        [(t, p, [1 + (p + k) % 5 for k in range(r)]) for t, n, r in (("click", 4, 2), ("view", 4, 1), ("purchase", 4, 3), ("signup", 4, 1), ("error", 4, 2)) for p in range(n)],
    ),
    "brokers": ("node_id int, host string", [(n, f"broker-{n}") for n in (1, 2, 3, 4, 5, 6)]),
    "configs": (
        "resource_type string, resource_name string, name string, value string, synonyms array<string>, is_default int, is_read_only int, is_sensitive int, is_synonym int",
        [
            ("topic", "click", "retention.ms", "86400000", ["log.retention.ms"], 1, 0, 0, 0),
            ("topic", "click", "cleanup.policy", "compact", ["log.cleanup.policy"], 0, 0, 0, 0),
            ("topic", "view", "retention.ms", "5000", ["log.retention.ms"], 0, 0, 0, 0),
            ("topic", "purchase", "retention.ms", "86400000", ["log.retention.ms"], 1, 0, 0, 1),
            ("broker", "1", "ssl.key", "x", None, 0, 1, 1, 0),
            ("broker", "1", "listeners", "a,b", [], -1, 1, 0, 0),
        ],
    ),
    "config_ops": (
        "resource_type string, resource_name string, name string, op string, value string",
        [
            ("topic", "click", "cleanup.policy", "append", "delete"),
            ("topic", "click", "retention.ms", "set", "1"),
            ("topic", "view", "retention.ms", "delete", None),
            ("topic", "view", "min.isr", "set", "2"),
            ("broker", "1", "listeners", "subtract", "b"),
        ],
    ),
    "acls": (
        "resource_type string, resource_name string, resource_pattern_type string, principal string, host string, operation string, permission_type string",
        [
            ("topic", "click", "literal", "User:a", "*", "read", "allow"),
            ("topic", "click", "literal", "User:b", "*", "write", "allow"),
            ("topic", "app-", "prefixed", "User:a", "*", "read", "allow"),
            ("group", "app", "literal", "User:a", "10.0.0.1", "read", "allow"),
            ("topic", "click", "literal", "User:c", "*", "read", "deny"),
        ],
    ),
    "committed": (
        "group_id string, topic string, partition int, offset bigint",
        [("app", "click", 0, 100), ("app", "click", 1, 0), ("app", "view", 0, 50), ("app", "view", 1, -1), ("app", "purchase", 3, 7), ("audit", "click", 2, 10), ("old", "click", 0, 5)],
    ),
    "times": ("topic string, partition int, at_us bigint", [(t, p, T0 + h * 3_600_000_000) for t in ("click", "view") for p in range(4) for h in (-1, 0, 50, 10_000)]),
    "specs": (
        "topic string, partition int, spec string, at_us bigint",
        [(t, p, s, a) for t in ("click", "error") for p in range(5) for s, a in (("earliest", -1), ("latest", -1), ("max_timestamp", -1), ("time", T0 + 86_400_000_000), ("time", T0 + 10**15))],
    ),
    "positions": ("topic string, partition int, position bigint", [("click", 0, 0), ("click", 1, 10**9), ("view", 2, 1), ("nothing", 0, 0)]),
    "revoked": ("topic string, partition int", [("click", 1), ("view", 3), ("other", 0)]),
    "seeks": (
        "seq bigint, group_id string, topic string, partition int, kind string, value bigint",
        [
            (1, "app", "click", None, "earliest", None), (2, "app", "click", 2, "offset", 17), (3, "app", "click", 3, "time", T0 + 86_400_000_000), (4, "app", "view", None, "latest", None),
            (5, "app", "view", 1, "time", T0 + 10**15), (6, "app", "click", 2, "offset", 19), (7, "audit", "click", 0, "latest", None), (8, "new", "signup", None, "time", T0),
        ],
    ),
    "marks": (
        "seq bigint, topic string, partition int, offset bigint, revoked boolean",
        [(1, "t", 0, 0, False), (2, "t", 0, 5, False), (3, "t", 0, 5, False), (4, "t", 0, 2, False), (5, "t", 0, 9, True), (6, "t", 1, 7, False), (7, "u", 0, 3, True), (8, "t", 1, 8, False)],
    ),
    "jobs": (
        "job_id bigint, queue string, method string, run_at_us bigint",
        [(1, "mail", None, None), (2, "mail", "produce_sync", NOW), (3, "report", None, NOW + 1), (4, "report", None, NOW - 5)],
    ),
    "dlq_config": (
        "topic string, dlq_topic string, max_retries int, dispatch_method string, marking_method string",
        [("click", "dead", 3, "produce_async", "mark_as_consumed"), ("view", "bad topic", -1, "produce_async", "mark"), ("purchase", None, 0, "later", "mark_as_consumed!"), ("signup", "orders", None, "produce_sync", "mark_as_consumed")],
    ),
    "rebalances": (
        "seq bigint, type string, subscription_group string, topic string, partitions array<int>",
        [
            (1, "assign", "s0", "click", [3, 0, 1]), (2, "revoke", "s0", "click", [1]), (3, "assign", "s0", "view", [2]), (4, "assign", "s1", "click", [1, 2]), (5, "reset", "s1", None, None),
            (6, "assign", "s1", "click", [2]), (7, "revoke", "s0", "view", [2]), (8, "assign", "s0", "click", [10, 2]), (9, "revoke", "s0", "signup", [0]),
        ],
    ),
    "statistics": (
        "group_id string, client_name string, emitted_us bigint, json string",
        [
            ("app", "c1", NOW - 10**9, _stats("c1", {"b1": (1, 20, 2)}, {"click": {"0": (9, 9, "active"), "1": (4, 4, "active")}})),
            ("app", "c1", NOW - 10**7, _stats("c1", {"b1": (1, 30, 3), "boot": (-1, 5, 1)}, {"click": {"0": (5, 6, "active"), "-1": (7, 7, "active"), "2": (-1, 3, "active"), "3": (2, 1, "stopped")}, "view": {"0": (-1, -1, "none")}})),
            ("app", "c1", NOW - 10**6, _stats("c2", {"b1": (1, 99, 9)}, {"click": {"0": (99, 99, "active")}})),
            ("audit", "c3", NOW - 2 * 10**6, _stats("c3", {"b2": (2, 11, 1)}, {"click": {"1": (0, 0, "active")}})),
        ],
    ),
    "polls": ("subscription_group string, messages bigint, time_ms bigint", [("s0", 10, 5), ("s0", 0, 1000), ("s0", 100, 40), ("s1", 0, 7)]),
    "errors": ("error_type string, topic string", [("consumer.consume.error", "click"), ("consumer.consume.error", "click"), ("librdkafka.error", None), ("consumer.consume.error", "view")]),
    "job_events": ("queue string, seq bigint, change bigint", [("q", 1, 1), ("q", 2, 1), ("q", 3, 1), ("q", 4, -1), ("q", 5, 1), ("q", 6, 1), ("r", 1, 1), ("r", 2, -1)]),
    "ticks": (
        "node int, kind string, at_us bigint, unrecoverable boolean",
        [(0, "polling", NOW - 10**6, False), (0, "consuming", NOW - 299 * 10**6, False), (1, "polling", NOW - 301 * 10**6, False), (1, "consuming", NOW - 400 * 10**6, False), (2, "polling", NOW, True), (3, "polling", NOW - 300 * 10**6, False)],
    ),
    "heartbeats": (
        "node int, alive boolean, hanging boolean, status int, reported_us bigint, died_us bigint",
        [(0, True, False, 0, NOW - 10**6, None), (1, True, True, 0, NOW, None), (2, True, False, 2, NOW, None), (3, True, False, 0, NOW - 61 * 10**6, None), (4, False, False, 0, NOW, NOW - 10**6), (5, False, False, 0, NOW, NOW - 5 * 10**6)],
    ),
    "transitions": ("process string, state string", [("a", "initializing"), ("a", "running"), ("a", "initialized"), ("b", "stopping"), ("b", "quiet"), ("c", "initializing")]),
    "replication_requests": ("topic string, target int, manual array<int>", [("click", 3, None), ("click", 2, None), ("view", 9, None), ("view", 2, [0, 1, 2]), ("none", 2, None), ("signup", 3, [0, 1, 2, 3])]),
    "ids": ("prefix string, node int, position int", [("app", 1, 0), (None, 2, 3), ("x", None, 1)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, columns)


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return f"[{', '.join(map(_literal, value))}]"
    if isinstance(value, dict):
        return f"MAP {{{', '.join(f'{_literal(k)}: {_literal(v)}' for k, v in value.items())}}}" if value else "MAP {}"
    return str(value)


def sql(name: str) -> str:
    """The table as a common table expression."""
    columns, rows = TABLES[name]
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")), strict=True)
    unions = " UNION ALL ".join("SELECT " + ", ".join(f'CAST({_literal(v)} AS {_KINDS[k]}) AS "{n}"' for v, n, k in zip(r, names, kinds, strict=True)) for r in rows)
    return f"{name} AS ({unions})"
