"""HTTP status classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_class(status: Column, mode: str = "rounded") -> Column:
    """First digit of the class as INT.

    'rounded' (the default) divides as floating point and rounds half to even, which existing
    dashboards show: 450 -> 4, but 451 and 499 -> 5 and 550 -> 6. 'floor' is the class proper.
    """
    if mode == "rounded":
        return F.rint(status / F.lit(100)).cast("int")
    if mode == "floor":
        return F.floor(status / F.lit(100)).cast("int")
    raise ValueError(f"unknown status class mode {mode!r}")


def in_status_class(status: Column, klass: int, mode: str = "rounded") -> Column:
    """`status_class(status) == klass` as a range on the bare column, which reaches the scan."""
    first = 100 * klass
    if mode == "floor":
        return (status >= first) & (status <= first + 99)
    if mode != "rounded":
        raise ValueError(f"unknown status class mode {mode!r}")
    if klass % 2 == 0:  # both halves round to the even class
        return (status >= first - 50) & (status <= first + 50)
    return (status > first - 50) & (status < first + 50)


def class_label(klass: Column) -> Column:
    return F.concat(klass.cast("string"), F.lit("xx"))


def is_error(status: Column) -> Column:
    """4xx and up; a missing status is no error."""
    return status >= 400
