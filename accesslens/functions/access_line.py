"""Common and Combined access-log lines to typed fields.

A line costs ONE regular-expression pass. The expression always matches: the grammar is an
optional group, and the rest of the line is swallowed either way. The replacement lays the
captures out again so that splitting finds them exactly, for any input:

- first all captures that cannot contain a quote, each closed by one (a single-character
  separator also spares the splitter a regular expression of its own);
- then the three that may contain quotes but no white space, parted by spaces.

A line that is no access line leaves all captures empty, so its last part starts with a space;
that of an access line starts with the client address, which has at least one character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the time field.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# The line grammar. (?U) makes \s, \S and \d Unicode-wide.
_TIME = (
    r"\s*(\d{1,2})/((?i:" + "|".join(MONTHS) + r"))/\s*\+?(\d{1,4}):\s*(\d{1,2}):\s*(\d{1,2}):\s*(\d{1,2})"
    r"\s*([-+\x{2212}])(\d{2})[:\s]*([0-5]\d)"
)
_REQUEST = r'"([^" ]*+)(?: ([^" ]*+)(?: ([^"]*+))?+)?+"'
_GRAMMAR = (
    r"\s*+(\S++) (\S++) (\S++) \[(?:" + _TIME + r"|[^\]]++)\] " + _REQUEST + r" (\d{3}|-) (\d++|-)"
    r'(?: "([^"]*+)" "([^"]*+)")?+'
)
ACCESS_LINE = "(?U)^(?:" + _GRAMMAR + ")?(?s:.*)$"

# The grammar's captures in order. The first three are the unquoted ones.
_UNQUOTED = ("remote_host", "ident", "auth_user")
_QUOTELESS = (
    "day",
    "month",
    "year",
    "hour",
    "minute",
    "second",
    "offset_sign",
    "offset_hours",
    "offset_minutes",
    "method",
    "path",
    "protocol",
    "status",
    "bytes",
    "referer",
    "user_agent",
)
_LAYOUT = (
    "".join(f'${n}"' for n in range(len(_UNQUOTED) + 1, len(_UNQUOTED) + len(_QUOTELESS) + 1))
    + "$1 $2 $3"
)


def access_tokens(raw: Column) -> Column:
    """ARRAY of the line's parts, all as text.

    Select it as a column of its own: read many times from within one expression, Catalyst
    would run the regular expression once per field.
    """
    return F.split(F.regexp_replace(raw, ACCESS_LINE, _LAYOUT), '"', len(_QUOTELESS) + 1)


def _unquoted(tokens: Column) -> Column:
    return F.get(tokens, F.lit(len(_QUOTELESS)))


def part(tokens: Column, name: str) -> Column:
    if name in _QUOTELESS:
        return F.get(tokens, F.lit(_QUOTELESS.index(name)))
    upto = F.substring_index(_unquoted(tokens), " ", _UNQUOTED.index(name) + 1)
    return F.substring_index(upto, " ", -1)


def is_access_line(tokens: Column) -> Column:
    return ~F.startswith(_unquoted(tokens), F.lit(" "))


def access_time(tokens: Column) -> Column:
    """Event time in UTC; NULL when the time field does not parse.

    Built from numbers rather than with a pattern-based parser: the result does not pass
    through the session zone, and one-digit fields, `+05:30` and second 60 are understood.
    """

    def number(name: str) -> Column:
        return part(tokens, name).try_cast("int")

    month = (F.instr(F.lit("".join(MONTHS).lower()), F.lower(part(tokens, "month"))) + 2) / 3
    local = F.try_make_timestamp_ntz(
        number("year"),
        month.cast("int"),
        number("day"),
        number("hour"),
        number("minute"),
        number("second"),
    )
    minutes = number("offset_hours") * 60 + number("offset_minutes")
    east = F.when(part(tokens, "offset_sign") == "+", minutes).otherwise(-minutes)
    return F.when(number("offset_hours") < 24, F.timestamp_add("MINUTE", -east, local))


def access_entry(tokens: Column) -> Column:
    """STRUCT of the parsed fields, or NULL for a line that is no access line."""
    text = {
        name: part(tokens, name).alias(name)
        for name in (
            "remote_host", "ident", "auth_user", "method", "path", "protocol", "referer", "user_agent",
        )
    }
    return F.when(
        is_access_line(tokens),
        F.struct(
            text["remote_host"],
            text["ident"],
            text["auth_user"],
            access_time(tokens).alias("ts"),
            text["method"],
            text["path"],
            text["protocol"],
            part(tokens, "status").try_cast("int").alias("status"),
            part(tokens, "bytes").try_cast("bigint").alias("bytes"),
            text["referer"],
            text["user_agent"],
        ),
    )
