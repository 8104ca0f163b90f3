"""Time expressions that keep to TIMESTAMP_NTZ, so the session zone has no part in them.

`date_trunc` and `date_format` go through the session zone and move wall-clock times that
fall in its daylight-saving gap; `window`, `trunc` on dates and the field functions do not.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal; folded to a constant before execution."""
    return F.lit(text).cast("timestamp_ntz")


def utc_ntz(instant: Column) -> Column:
    """Wall-clock UTC of a TIMESTAMP."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ntz(_EPOCH))


def instant_of(time: Column) -> Column:
    """TIMESTAMP of a wall-clock time in UTC, in whole seconds: what watermarks are kept on."""
    seconds = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.timestamp_seconds(F.unix_date(time.cast("date")).cast("bigint") * 86400 + seconds)


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def hour_number(time: Column) -> Column:
    """Whole hours since 1970 as INT: parquet keeps min/max of it per row group and skips by them."""
    return (F.unix_date(time.cast("date")) * 24 + F.hour(time)).cast("int")


def bucket_5_minutes(time: Column) -> Column:
    return F.window(time, "5 minutes")["start"]


def bucket_hour(time: Column) -> Column:
    return F.window(time, "1 hour")["start"]


def bucket_day(time: Column) -> Column:
    return time.cast("date").cast("timestamp_ntz")


def bucket_month(time: Column) -> Column:
    return F.trunc(time.cast("date"), "MM").cast("timestamp_ntz")


def label_hour_minute(time: Column) -> Column:
    return F.format_string("%02d:%02d", F.hour(time), F.minute(time))


def label_month_day(time: Column) -> Column:
    return F.format_string("%02d-%02d", F.month(time), F.dayofmonth(time))


def label_year_month(time: Column) -> Column:
    return F.format_string("%04d-%02d", F.year(time), F.month(time))
