"""Parsing of message payloads as column expressions; what isn't asked for isn't parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Parser = Callable[[Column], Column]


def json_strict(schema: str) -> Parser:
    """JSON that must be valid: a malformed payload fails the query that uses it; null stays null."""
    return lambda value: F.from_json(value, schema, {"mode": "FAILFAST"})


def json_variant(value: Column) -> Column:
    """JSON of any shape; a malformed payload fails the query that uses it."""
    return F.parse_json(value)


def raw(value: Column) -> Column:
    return value


def field(value: Column, name: str) -> Column:
    """A top-level field of a JSON payload as text, without parsing the rest into columns."""
    return F.get_json_object(value, f"$.{name}")


def status(value: Column) -> Column:
    """``null``, ``valid`` or ``malformed``: for keeping bad payloads instead of failing."""
    return F.when(value.isNull(), "null").when(F.try_parse_json(value).isNotNull(), "valid").otherwise("malformed")


def payload_format(value: Column) -> Column:
    """``json``, ``digits``, ``letters`` or ``binary``; bare digits are JSON and count as such."""
    return F.when(value.isNull(), "null").when(F.try_parse_json(value).isNotNull(), "json").when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[A-Za-z]+$"), "letters").otherwise("binary")


def tombstone(key: Column, value: Column) -> Column:
    return key.isNotNull() & value.isNull()


def parsed(log: DataFrame, parsers: dict[str, Parser], default: Parser = raw, name: str = "payload") -> DataFrame:
    """Adds the payload by each topic's own parser; topics without one take the default."""
    out = None
    for topic, parser in parsers.items():
        here = F.col("topic") == topic
        out = F.when(here, parser(F.col("value"))) if out is None else out.when(here, parser(F.col("value")))
    return log.withColumn(name, default(F.col("value")) if out is None else out.otherwise(default(F.col("value"))))


def headers(names_and_values: list[tuple[str, Column, bool]]) -> Column:
    """Headers as map<name, struct<values array<string>, is_array boolean>>, so that a scalar reads back as one."""
    entries = []
    for name, value, many in names_and_values:
        entries += [F.lit(name), F.struct((value if many else F.array(value)).alias("values"), F.lit(many).alias("is_array"))]
    return F.create_map(*entries)


def header(column: Column, name: str) -> Column:
    """One header as text: a scalar as it is, an array as its JSON."""
    found = column[name]
    return F.when(found["is_array"], F.to_json(found["values"])).otherwise(F.element_at(found["values"], 1))
