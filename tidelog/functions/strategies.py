"""Which rules a consumer follows, by the features its topic has."""

from __future__ import annotations

from dataclasses import dataclass

FEATURES = frozenset(("active_job", "manual_offset_management", "dead_letter_queue"))


@dataclass(frozen=True)
class Strategy:
    """marks: after success the whole batch is marked. dispatches: failures end in dead letters. each: every job is marked by itself."""

    name: str
    marks: bool
    dispatches: bool
    each: bool = False


_KNOWN = {
    frozenset(): Strategy("default", True, False),
    frozenset(("dead_letter_queue",)): Strategy("dlq", True, True),
    frozenset(("manual_offset_management",)): Strategy("mom", False, False),
    frozenset(("dead_letter_queue", "manual_offset_management")): Strategy("dlq_mom", False, True),
    frozenset(("active_job", "manual_offset_management")): Strategy("aj_mom", False, False, True),
    frozenset(("active_job", "dead_letter_queue", "manual_offset_management")): Strategy("aj_dlq_mom", False, True, True),
}


def select(*features: str) -> Strategy:
    """The strategy for exactly these features; LookupError if there is none."""
    if unknown := set(features) - FEATURES:
        raise LookupError(f"unknown features: {sorted(unknown)}")
    if (found := _KNOWN.get(frozenset(features))) is None:
        raise LookupError(f"no strategy for: {sorted(features)}")
    return found
