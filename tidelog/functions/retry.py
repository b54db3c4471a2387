"""Retry, backoff and dead-letter decisions as column expressions, shared by batch and streaming code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error classes after which a message is never dead-lettered.
CRITICAL = ("SystemExit", "SignalException", "NoMemoryError")


@dataclass(frozen=True)
class Pause:
    """How long to wait before another attempt, in milliseconds."""

    timeout: int = 1_000
    max_timeout: int = 30_000
    exponential: bool = True

    def wait(self, attempt: Column) -> Column:
        """The attempt is counted before it runs, so the first failure waits twice the timeout."""
        if not self.exponential:
            return F.lit(self.timeout).cast("long")
        return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(40))) * self.timeout, F.lit(float(self.max_timeout))).cast("long")


@dataclass(frozen=True)
class DeadLetters:
    """Dead-letter settings of a topic. ``topic=False`` skips a message without writing it anywhere."""

    topic: str | bool | None = None
    max_retries: int = 3
    independent: bool = False
    mark_after_dispatch: bool | None = None

    @property
    def active(self) -> bool:
        return self.topic is not None

    def marks(self, manual: bool, jobs: bool = False) -> bool:
        """Whether a dead-lettered message is marked as consumed."""
        if jobs:
            return True
        return (not manual) if self.mark_after_dispatch is None else self.mark_after_dispatch


def decision(failed: Column, error_class: Column, attempt: Column, max_retries: Column) -> Column:
    """``mark`` after success; ``retry`` after a critical error or while retries are left; else ``dispatch``."""
    return F.when(~failed, "mark").when(error_class.isin(*CRITICAL), "retry").when(attempt <= max_retries, "retry").otherwise("dispatch")


def retrying(attempt: Column) -> Column:
    return attempt > 1
