"""Small text helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size steps shown to people.
BYTE_STEP = 1024
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def decode_utf8(payload: Column) -> Column:
    """Bytes to text; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


def trim_whitespace(text: Column) -> Column:
    """Trim all Unicode white space; `F.trim` strips spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_decimal(number: Column) -> Column:
    """Text with one decimal, ties on the exact binary value going to even (0.25 -> 0.2).

    `format_string('%.1f')` would round the shortest decimal text half up instead.
    """
    return F.call_function("format_number", number.cast("double"), F.lit("0.0"))


def readable_bytes(count: Column) -> Column:
    """1024-step size: whole number for B, one decimal from KB on, TB is the last unit."""
    text = F.concat(count.cast("string"), F.lit(" " + BYTE_UNITS[0]))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        scale = float(BYTE_STEP**power)
        text = F.when(
            count >= F.lit(BYTE_STEP**power),
            F.concat(one_decimal(count / F.lit(scale)), F.lit(" " + unit)),
        ).otherwise(text)
    return text


def percent_text(number: Column) -> Column:
    return F.concat(one_decimal(number), F.lit("%"))
