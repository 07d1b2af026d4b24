"""Half-open evaluation windows and time arithmetic over timestamps without zone, dates and numbers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """``[start, stop)``."""

    start: Any
    stop: Any

    def __post_init__(self):
        if self.start > self.stop:
            raise ValueError("a span's start must not come after its stop")

    def widen(self, before: Any = None, after: Any = None) -> Span:
        return Span(self.start - before if before is not None else self.start, self.stop + after if after is not None else self.stop)

    def shift(self, offset: Any) -> Span:
        return Span(self.start + offset, self.stop + offset)

    def holds(self, other: Span) -> bool:
        return self.start <= other.start and other.stop <= self.stop

    def where(self, column: Column, closed: bool = False) -> Column:
        upper = column <= literal(self.stop) if closed else column < literal(self.stop)
        return (column >= literal(self.start)) & upper


def literal(value: Any) -> Column:
    """A constant of the time's own type, so that filters reach the scan uncast."""
    if isinstance(value, datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, date):
        return F.lit(value)
    return F.lit(value)


def number(column: Column, kind: str) -> Column:
    """Time as a number: microseconds of a timestamp, days of a date, else itself."""
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    if kind == "date":
        return F.unix_date(column)
    return column


def width(offset: Any, kind: str) -> int | float:
    """An offset in the unit of :func:`number`."""
    if isinstance(offset, timedelta):
        if kind.startswith("timestamp"):
            return offset // timedelta(microseconds=1)
        if kind == "date":
            return offset.days
        raise TypeError("a period needs a date or timestamp time")
    if kind.startswith("timestamp") or kind == "date":
        raise TypeError("a date or timestamp time needs a period")
    return offset


def shifted(column: Column, offset: Any, kind: str) -> Column:
    if kind == "date":
        return F.date_add(column, width(offset, kind))
    return (column + F.lit(offset)).cast(kind if kind != "string" else "long")


def time_kind(value: Any) -> str:
    if isinstance(value, datetime):
        return "timestamp_ntz"
    if isinstance(value, date):
        return "date"
    return "double" if isinstance(value, float) else "bigint"
