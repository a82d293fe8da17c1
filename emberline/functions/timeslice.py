"""Time slices: a post belongs to slot ``floor(epoch / width)``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Output formats of times.
TIME_PATTERNS = {
    "long": "EEE MMM dd HH:mm:ss Z yyyy",
    "day_plain": "yyyy-M-d",
    "day_compact": "yyyyMMdd",
}


def slot_of(ts: Column, width: int) -> Column:
    """Slot number of a timestamp."""
    return F.floor(F.unix_seconds(ts) / F.lit(width)).cast("bigint")


def slot_start(slot: Column, width: int) -> Column:
    """First instant of a slot."""
    return F.timestamp_seconds(slot * F.lit(width))


def slice_of(ts: Column, width: int) -> Column:
    """Timestamp cut down to the start of its slice."""
    return slot_start(slot_of(ts, width), width)


def minor_slots(slot: Column, minor: int) -> Column:
    """The slots a post counts for: its own and the following ``minor - 1``."""
    return F.sequence(slot, slot + F.lit(minor - 1)) if minor > 1 else F.array(slot)


def format_time(ts: Column, style: str) -> Column:
    """Time as text (``long``, ``day_plain``, ``day_compact``) or number (``epoch_s``, ``epoch_ms``)."""
    if style == "epoch_s":
        return F.unix_seconds(ts)
    if style == "epoch_ms":
        return F.unix_millis(ts)
    return F.date_format(ts, TIME_PATTERNS[style])
