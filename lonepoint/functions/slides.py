"""Slides, windows and event time.

A point with id ``i`` belongs to slide ``i div S``.  The window whose newest
slide is ``e`` holds the slides ``e - m + 1 .. e`` with ``m = W / S``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event time of slide 0, in seconds; positive because Spark's first watermark
# is the epoch itself.
EVENT_BASE = 1_000_000_000


def slide_index(slide: int, id_col: str = "id") -> Column:
    return F.expr(f"cast({id_col} as bigint) div {int(slide)}L")


def slide_start(slide: int, id_col: str = "id") -> Column:
    """First id of the slide that holds a point."""
    return slide_index(slide, id_col) * F.lit(int(slide)).cast("bigint")


def event_time(sl: str = "sl") -> Column:
    """One second per slide, so that windows are whole numbers of seconds."""
    return F.timestamp_seconds(F.lit(EVENT_BASE) + F.col(sl))


def slide_of_time(ts: Column) -> Column:
    return F.unix_timestamp(ts) - F.lit(EVENT_BASE)


def in_window(sl: Column, e: Column, span: int) -> Column:
    return (sl > e - F.lit(span)) & (sl <= e)


def is_new(sl: Column, e: Column) -> Column:
    return sl == e


def is_expiring(sl: Column, e: Column, span: int) -> Column:
    return sl == e - F.lit(span - 1)


def windows_of(sl: Column, span: int) -> Column:
    """Array of the windows that hold a slide."""
    return F.sequence(sl, sl + F.lit(span - 1))
