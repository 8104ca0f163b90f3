"""The report filter: optional client, URL and status class, and a time window that always applies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import in_status_class
from ..functions.times import (
    bucket_5_minutes,
    bucket_day,
    bucket_hour,
    bucket_month,
    hour_number,
    label_hour_minute,
    label_month_day,
    label_year_month,
    ntz,
    utc_now,
)


@dataclass(frozen=True)
class TimeRange:
    length: timedelta
    label: str
    bucket: Callable[[Column], Column]
    bucket_label: Callable[[Column], Column]


# Range keys, lengths, labels and timeline buckets.
RANGES = {
    "1h": TimeRange(timedelta(hours=1), "last hour", bucket_5_minutes, label_hour_minute),
    "24h": TimeRange(timedelta(hours=24), "last 24 hours", bucket_hour, label_hour_minute),
    "7d": TimeRange(timedelta(days=7), "last 7 days", bucket_day, label_month_day),
    "30d": TimeRange(timedelta(days=30), "last 30 days", bucket_day, label_month_day),
    "1y": TimeRange(timedelta(days=365), "last year", bucket_month, label_year_month),
}
DEFAULT_RANGE = "24h"

# Unicode white space, as trimmed from typed text. `str.strip()` alone would also take U+001C..U+001F.
_WHITE_SPACE = (
    "\t\n\v\f\r "
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _clean(text: str | None) -> str | None:
    return (text or "").strip(_WHITE_SPACE) or None


@dataclass(frozen=True)
class Filter:
    """What a report covers. `status` is a class (4 for 4xx), not a code."""

    ip: str | None = None
    path: str | None = None
    status: int | None = None
    range: str | None = None

    def normalized(self) -> Filter:
        """Typed-in values trimmed; empty ones and an unknown range count as not given."""
        key = _clean(self.range)
        return Filter(
            _clean(self.ip), _clean(self.path), self.status, key if key in RANGES else None
        )

    def with_ip(self, ip: str) -> Filter:
        return replace(self, ip=ip)

    def with_path(self, path: str) -> Filter:
        return replace(self, path=path)

    def with_status(self, status: int) -> Filter:
        return replace(self, status=status)

    def with_range(self, range: str) -> Filter:
        return replace(self, range=range)

    def without_ip(self) -> Filter:
        return replace(self, ip=None)

    def without_path(self) -> Filter:
        return replace(self, path=None)

    def without_status(self) -> Filter:
        return replace(self, status=None)

    @property
    def time_range(self) -> TimeRange:
        return RANGES.get(self.range or DEFAULT_RANGE, RANGES[DEFAULT_RANGE])

    @property
    def range_label(self) -> str:
        return self.time_range.label

    def cutoff(self, as_of: datetime | None = None) -> str:
        """Start of the window, in whole seconds. There is no end: later rows count."""
        start = (as_of or utc_now()) - self.time_range.length
        return start.strftime("%Y-%m-%d %H:%M:%S")

    def condition(self, as_of: datetime | None = None, status_mode: str = "rounded") -> Column:
        return reduce(and_, self._conditions(self.cutoff(as_of), status_mode))

    def _conditions(self, cutoff: str, status_mode: str) -> list[Column]:
        # `ts` stays bare; rows without an event time fail the comparison.
        conditions = [F.col("ts") >= ntz(cutoff)]
        if self.ip is not None:
            conditions.append(F.col("remote_host") == F.lit(self.ip))
        if self.path is not None:
            conditions.append(F.col("path") == F.lit(self.path))
        if self.status is not None:
            conditions.append(in_status_class(F.col("status"), self.status, status_mode))
        return conditions

    def apply(
        self, rows: DataFrame, as_of: datetime | None = None, status_mode: str = "rounded"
    ) -> DataFrame:
        """Rows this filter covers. On a stored table, also prune partitions and row groups.

        A row inside the window has its own date and hour there, so both extra conditions are
        implied by the window; they only spare reading.
        """
        cutoff = self.cutoff(as_of)
        conditions = self._conditions(cutoff, status_mode)
        if "event_date" in rows.columns:
            conditions.append(F.col("event_date") >= F.lit(cutoff[:10]).cast("date"))
        if "event_hour" in rows.columns:
            conditions.append(F.col("event_hour") >= hour_number(ntz(cutoff)))
        return rows.where(reduce(and_, conditions))
