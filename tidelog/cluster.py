"""Makes this package importable in Python workers, wherever the driver's copy lies."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        where = Path(tempfile.mkdtemp(prefix="tidelog-src-")) / "tidelog.zip"
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        context.addPyFile(str(where))
        _shipped.add(context.applicationId)
    return spark
