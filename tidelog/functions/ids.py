"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(name: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256, for generated group names."""
    return F.substring(F.sha2(name.cast("string"), 256), 1, 12)


def static_id(*parts: Column) -> Column:
    """Parts joined by underscores; missing ones are left out."""
    return F.concat_ws("_", *(p.cast("string") for p in parts))
