"""Tables and small files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_GC_SECONDS = 1.0
#: For tables of our own on a local file system (other systems don't see these settings): no checksum file beside each
#: file. Without Hadoop's native library every file made there starts a process to set its rights, a checksum file too.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Spark removes an execution's shuffle files at its end, not once its plan is garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_let_go_at = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where there is but one machine, a temporary folder of our own takes its
    place if the session has none; on a cluster that is an error.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = _own_dir
    return base.rstrip("/")


class Files:
    """Small files of a folder, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        where = self._at(name)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under its name only once it is whole."""
        half, whole = self._at(f"{name}.tmp"), self._at(name)
        stream = self._fs.create(half, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(half, whole):
            raise OSError(f"{self.folder}/{name} is already there")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class Stage:
    """Tables written to the shared folder between the steps of one operator.

    A written table survives lost executors and cuts the lineage. ``drop`` removes one that is no
    longer needed; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidelog/{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read again; its shuffle files go once it is written."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**_PLAIN).option("compression", "zstd").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        schema = df.schema
        del df
        self._let_go()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        Files(self.spark, self.root).delete(name)

    def _let_go(self) -> None:
        """Shuffle files of other executions (a query's own result, a count) stay on the executors' disks until the driver's
        JVM collects its garbage, by default every half hour. So it is asked to, at most once a second; many small tables
        in turn don't pay for it.
        """
        global _let_go_at
        if time.monotonic() - _let_go_at > _GC_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            _let_go_at = time.monotonic()

    def _forget(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                Files(self.spark, self.root).delete()
            except Exception:  # the JVM may already be gone when Python ends
                return
