"""The catalog as tables under one folder, declarations for it, and the changes that plans ask for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans import topics
from tidelog.stage import Files

DECLARATIONS = "topic string, active boolean, partitions int, replication_factor int, details map<string,string>"
PARTITIONS = "topic string, partition int, replicas array<int>"
CONFIGS = "resource_type string, resource_name string, name string, value string, synonyms array<string>, is_default int, is_read_only int, is_sensitive int, is_synonym int"
BROKERS = "node_id int, host string"
_SCHEMAS = {"partitions": PARTITIONS, "configs": CONFIGS, "brokers": BROKERS}


@dataclass
class Declarations:
    """Declared topics; declaring one again replaces what was said before, and defaults hold for one draw."""

    topics: dict[str, tuple] = field(default_factory=dict)
    partitions: int = 1
    replication_factor: int = 1
    details: dict[str, str] = field(default_factory=dict)

    def topic(self, name: str, partitions: int | None = None, replication_factor: int | None = None, active: bool = True, **details: str) -> Declarations:
        self.topics[name] = (name, active, partitions or self.partitions, replication_factor or self.replication_factor, self.details | {k.replace("_", "."): v for k, v in details.items()})
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.topics.values()), DECLARATIONS)


class Catalog:
    """Brokers, topic partitions and settings, each the table of its latest version.

    A change writes a new version beside the old one and only then, by a small file, makes it the
    current one, so a change that fails half way leaves the catalog as it was, and a catalog opened
    on the folder later is the same. Of two that write the same version at a time one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)
        done = lambda name: [int(x.removeprefix("v")) for x in self.files.names(f"{name}/current") if x.removeprefix("v").isdigit()]
        self.version = {name: max(done(name), default=0) for name in _SCHEMAS}

    def table(self, name: str) -> DataFrame:
        v = self.version[name]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{v}") if v else self.spark.createDataFrame([], _SCHEMAS[name])

    def put(self, name: str, rows: DataFrame) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.table(name).schema)).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{self.version[name] + 1}")
        self.files.write(f"{name}/current/v{self.version[name] + 1}", "")
        self.version[name] += 1

    def _placed(self, wanted: DataFrame) -> DataFrame:
        """Partitions (topic, first, count, replication_factor) on brokers in turn."""
        brokers = self.table("brokers").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
        rows = wanted.filter("count > first").withColumn("partition", F.explode(F.sequence("first", F.col("count") - 1))).join(F.broadcast(brokers))
        n = F.greatest(F.size("ids"), F.lit(1))
        replicas = F.transform(F.sequence(F.lit(0), F.col("replication_factor") - 1), lambda i: F.get("ids", F.pmod(F.col("partition") + i, n)))
        return rows.select("topic", F.col("partition").cast("int").alias("partition"), replicas.alias("replicas"))

    def create_topic(self, name: str, partitions: int, replication_factor: int = 1) -> None:
        self.put("partitions", self.table("partitions").unionByName(self._placed(self.spark.createDataFrame([(name, 0, partitions, replication_factor)], "topic string, first int, count int, replication_factor int"))))

    def delete_topic(self, *names: str) -> None:
        self.put("partitions", self.table("partitions").filter(~F.col("topic").isin(*names)))

    def create_partitions(self, name: str, total: int) -> None:
        """Extend a topic; never makes it smaller."""
        have = self.table("partitions").filter(F.col("topic") == name).groupBy("topic").agg(F.count("*").cast("int").alias("first"), F.max(F.size("replicas")).alias("replication_factor"))
        self.put("partitions", self.table("partitions").unionByName(self._placed(have.withColumn("count", F.lit(total)))))

    def create(self, declared: DataFrame) -> None:
        new = topics.to_create(declared, self.table("partitions"))
        placed = self._placed(new.select("topic", F.lit(0).alias("first"), F.col("partitions").alias("count"), "replication_factor"))
        settings = declared.join(new.select("topic"), "topic", "left_semi").select(F.lit("topic").alias("resource_type"), F.col("topic").alias("resource_name"), F.explode("details").alias("name", "value"))
        self.put("configs", self.table("configs").unionByName(settings, allowMissingColumns=True))
        self.put("partitions", self.table("partitions").unionByName(placed))

    def repartition(self, declared: DataFrame) -> None:
        grow = topics.to_repartition(declared, self.table("partitions")).filter("direction = 'up'").join(declared.select("topic", "replication_factor"), "topic")
        placed = self._placed(grow.select("topic", F.col("existing").alias("first"), F.col("partitions").alias("count"), "replication_factor"))
        self.put("partitions", self.table("partitions").unionByName(placed))

    def align(self, declared: DataFrame) -> None:
        change = topics.to_align(declared, self.table("partitions"), self.table("configs"))
        names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
        old = self.table("configs")
        same = (F.col("resource_type") == "topic") & (F.col("resource_name") == F.col("topic")) & F.array_contains(names, F.col("key"))
        self.put("configs", old.join(change, same, "left").withColumn("value", F.coalesce("wanted", "value")).select(*old.columns))

    def migrate(self, declared: DataFrame) -> None:
        """Create what is missing, extend what is too small, align settings: in this order."""
        self.create(declared)
        self.repartition(declared)
        self.align(declared)

    def delete(self, declared: DataFrame) -> None:
        self.put("partitions", self.table("partitions").join(declared.filter("active").select("topic"), "topic", "left_anti"))

    def reset(self, declared: DataFrame) -> None:
        self.delete(declared)
        self.create(declared)

    def export(self, plan_json: DataFrame, path: str) -> None:
        """Write a plan's JSON document as one text file."""
        plan_json.select("json").coalesce(1).write.mode("overwrite").text(path)
