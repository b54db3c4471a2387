"""What has to change for the cluster's topics to match their declarations, and the change itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("topic").agg(F.count("*").cast("int").alias("existing"))


def to_create(declarations: DataFrame, partitions: DataFrame) -> DataFrame:
    """Active declarations without a topic."""
    rows = declarations.filter("active").join(sizes(partitions), "topic", "left_anti")
    return rows.select("topic", "partitions", "replication_factor", F.to_json("details").alias("details"))


def to_repartition(declarations: DataFrame, partitions: DataFrame) -> DataFrame:
    """Topics whose partition count differs: ``up`` can be applied, ``down`` is only reported."""
    rows = declarations.filter("active").join(sizes(partitions), "topic").filter("existing <> partitions")
    return rows.select("topic", "existing", "partitions", F.when(F.col("existing") < F.col("partitions"), "up").otherwise("down").alias("direction"))


def _wanted(declarations: DataFrame, partitions: DataFrame) -> DataFrame:
    return declarations.filter("active").join(sizes(partitions), "topic", "left_semi").select("topic", F.explode("details").alias("key", "wanted"))


def _actual(configs: DataFrame) -> DataFrame:
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return configs.filter("resource_type = 'topic'").select(F.col("resource_name").alias("topic"), F.explode(names).alias("key"), F.col("value").alias("actual"))


def to_alter(declarations: DataFrame, partitions: DataFrame, configs: DataFrame) -> DataFrame:
    """Declared settings that differ from the actual ones, by name or synonym: ``change``, or ``add`` if the topic has none."""
    rows = _wanted(declarations, partitions).join(_actual(configs), ["topic", "key"], "left")
    rows = rows.filter("actual is null or actual <> wanted")
    return rows.select("topic", "key", "actual", "wanted", F.when(F.col("actual").isNull(), "add").otherwise("change").alias("action"))


def to_align(declarations: DataFrame, partitions: DataFrame, configs: DataFrame) -> DataFrame:
    """Settings to write: only those that the broker lists and that differ."""
    return _wanted(declarations, partitions).join(_actual(configs), ["topic", "key"]).filter("actual <> wanted").select("topic", "key", "wanted")


def migrated(declarations: DataFrame, partitions: DataFrame) -> DataFrame:
    """Partition counts once missing topics are created and the others extended; never fewer than there are."""
    rows = declarations.filter("active").join(sizes(partitions), "topic", "full")
    return rows.select("topic", F.greatest(F.coalesce("existing", F.lit(0)), F.coalesce("partitions", F.lit(0))).alias("partitions"))


def alter_configs(configs: DataFrame, operations: DataFrame) -> DataFrame:
    """Settings of resources after operations (resource_type, resource_name, name, op, value), sorted by name.

    ``set`` puts a value, ``delete`` removes it, ``append`` and ``subtract`` add or take entries of
    a comma-separated list.
    """
    keys = ["resource_type", "resource_name", "name"]
    rows = configs.select(*keys, F.col("value").alias("old")).join(operations.select(*keys, "op", F.col("value").alias("new")), keys, "full")
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    value = (
        F.when(F.col("op").isNull(), F.col("old"))
        .when(F.col("op") == "set", F.col("new"))
        .when(F.col("op") == "append", F.array_join(F.array_union(listed(F.col("old")), listed(F.col("new"))), ","))
        .when(F.col("op") == "subtract", F.array_join(F.array_except(listed(F.col("old")), listed(F.col("new"))), ","))
    )
    return rows.filter("op is null or op <> 'delete'").select(*keys, value.alias("value"))


def config_flags(configs: DataFrame) -> DataFrame:
    """Flags of each setting as booleans: anything above 0 is true."""
    return configs.select("resource_type", "resource_name", "name", *((F.col(c) > 0).alias(c) for c in ("is_default", "is_read_only", "is_sensitive", "is_synonym")))


def matching_acls(acls: DataFrame, **wanted: str) -> DataFrame:
    """Access rules that match all given fields; ``any`` matches everything."""
    rows = acls
    for name, value in wanted.items():
        if value != "any":
            rows = rows.filter(F.col(name) == value)
    return rows


def without_acls(acls: DataFrame, **wanted: str) -> DataFrame:
    """Access rules that are left once those that match are deleted."""
    return acls.join(matching_acls(acls, **wanted), acls.columns, "left_anti")


def with_acl(acls: DataFrame, new: DataFrame) -> DataFrame:
    return acls.unionByName(new).distinct()
