"""Syslog envelope: RFC 5424, RFC 3164 and its RFC 3339-stamped forwarding form.

One regular expression removes whatever header is there and puts the host name in front of
the message, parted by a space (a host name holds none). A line without a header keeps its
whole text as the message. Repetitions over groups are possessive: the matcher then loops
instead of recursing, so 64 KiB of structured data cannot exhaust an executor's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRI = r"<\d{1,3}>"
_SD_ELEMENT = r'\[[^"\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"\]]*+)*+\]'
_RFC5424 = (
    _PRI + r"\d{1,2} \S++ (\S++) \S++ \S++ \S++ (?:-|(?:" + _SD_ELEMENT + r")++) ?\x{FEFF}?"
)
# Zone names that senders put behind a BSD stamp.
_ZONES = "UTC|GMT|WET|WEST|CET|CEST|EET|EEST|BST|MSK|EST|EDT|CST|CDT|MST|MDT|PST|PDT|JST|IST"
_BSD_TIME = r"[A-Z][a-z]{2} [ \d]?\d (?:\d{4} )?\d{2}:\d{2}:\d{2}(?:\.\d+)? (?:(?:" + _ZONES + ") )?+"
_ISO_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}) "
# A word that ends in ':' is the tag of a sender that leaves the host name out.
_HOST = r"(?:(\S++)(?<!:) )?+"
# An IPv6 client address opening the message must not be cut at its first ':' as if it were a tag;
# nor a client with its port, which two more words and '[' follow.
_NOT_IPV6 = r"(?!(?:[0-9A-Fa-f]*+:){2,}+[0-9A-Fa-f.:]*+(?:\s|$))"
_TAG = _NOT_IPV6 + r"[A-Za-z0-9_./-]++(?:\[[^\]]*+\])?+:(?!\d{1,5} \S++ \S++ \[) ?"
# With a process number a word is a tag without its ':' too.
_PID_TAG = r"[A-Za-z][A-Za-z0-9_./-]*+\[\d++\] "
# Forwarders with RFC 3339 stamps always send a tag, sometimes without its ':'. A word that opens an
# access line itself (two words and '[' follow) is a client.
_BARE_TAG = r"[A-Za-z][A-Za-z0-9_.-]*+ (?!\S++ \S++ \[)"
# A BSD stamp is told from a message without its priority, too.
_RFC3164 = (
    "(?:" + _PRI + " ?)?+" + _BSD_TIME + _HOST + "(?:" + _TAG + "|" + _PID_TAG + ")?"
    "|" + _PRI + " ?" + _ISO_TIME + _HOST + "(?:" + _TAG + "|" + _PID_TAG + "|" + _BARE_TAG + ")?"
)
ENVELOPE = "(?Us)^(?:" + _RFC5424 + "|" + _RFC3164 + ")?"


def split_envelope(line: Column) -> Column:
    """ARRAY(host name or '', message). Select it as a column of its own before taking both parts."""
    return F.split(F.regexp_replace(line, ENVELOPE, "$1$2$3 "), " ", 2)


def envelope_host(parts: Column) -> Column:
    """Host name, NULL where the header has none ('-' is RFC 5424's nil)."""
    host = F.get(parts, F.lit(0))
    return F.when(~host.isin("", "-"), host)


def envelope_message(parts: Column) -> Column:
    return F.get(parts, F.lit(1))


# --- header fields --------------------------------------------------------------------------

_START = r"(?U)^(?:" + _PRI + " ?)?+"
_STAMP = "(" + _BSD_TIME + "|" + _ISO_TIME + ")"
# Another stamp is matched too, with nothing captured.
_RFC3339 = r"(?s)^(?:(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\d*(?:Z|([+-])(\d{2}):?(\d{2}))$.*|.*)"
#: Priority is 8 x facility + severity, with facilities up to 23.
_SEVERITIES, _PRIORITIES = 8, 192


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group matched, NULL where nothing or an empty text."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _nil(word: Column) -> Column:
    return F.when(word != "-", word)


def envelope_header(line: Column, message: Column) -> Column:
    """What stands before the message: '' where the line has no header."""
    return F.left(line, F.char_length(line) - F.char_length(message))


def header_form(header: Column) -> Column:
    """'rfc5424', 'rfc3339' (a forwarder's stamp), 'bsd', or NULL for no header."""
    return (
        F.when(header.rlike(r"(?U)^<\d{1,3}>\d{1,2} "), "rfc5424")
        .when(header.rlike(r"(?U)^<\d{1,3}> ?\d{4}-"), "rfc3339")
        .when(header != "", "bsd")
    )


def header_words(header: Column) -> Column:
    """ARRAY(priority and version, stamp, host, app, process, message kind, data) of an RFC 5424 header, '-' as NULL.

    Spark leaves a higher-order function out of its generated code, so that the steps below and above
    this one become two methods. As one they pass the 8,000 bytes of bytecode that HotSpot compiles.
    """
    return F.transform(F.split(header, " ", 7), _nil)


def header_stamp(header: Column, form: Column, words: Column) -> Column:
    """The sender's time as it was sent."""
    short = F.rtrim(F.regexp_extract(header, _START + _STAMP, 1))
    return F.when(form == "rfc5424", F.get(words, F.lit(1))).when(form.isNotNull(), short)


def header_tag(header: Column, host: Column) -> Column:
    """What stands between host and message in the short forms; `host` is '' where there is none."""
    rest = F.regexp_replace(header, _START + _STAMP, "")
    return F.when(host == "", rest).otherwise(F.substring(rest, F.char_length(host) + 2, F.char_length(rest)))


def header_priority(header: Column) -> Column:
    return F.regexp_extract(header, r"^<(\d{1,3})>", 1).try_cast("int")


def stamp_clock(stamp: Column) -> Column:
    """Local time, a space and the offset's sign, hours and minutes of an RFC 3339 stamp; a space for another."""
    return F.regexp_replace(stamp, _RFC3339, "$1 $2$3$4")


def minutes_east(clock: Column) -> Column:
    """By how many minutes this clock is ahead of UTC."""
    offset = F.substring_index(clock, " ", -1)
    hours, minutes = (F.substring(offset, place, 2).try_cast("int") for place in (2, 4))
    ahead = F.coalesce(hours * 60 + minutes, F.lit(0))
    return F.when(offset.startswith("-"), -ahead).otherwise(ahead)


def sent_time(clock: Column, east: Column) -> Column:
    """UTC time of an RFC 3339 stamp to the microsecond; NULL for stamps without a year or a zone."""
    local = F.substring_index(clock, " ", 1).try_cast("timestamp_ntz")
    return F.when(F.abs(east) < 24 * 60, F.timestamp_add("MINUTE", -east, local))


def header_fields(
    header: Column, form: Column, words: Column, priority: Column, stamp: Column, sent_at: Column, tag: Column
) -> list[Column]:
    """The fields of a header as columns; a nil ('-') or missing field is NULL.

    Facility and severity are NULL for priorities above 191. Structured data keeps its text.
    """
    long = form == "rfc5424"
    valid = priority < _PRIORITIES
    data = F.regexp_replace(F.get(words, F.lit(6)), r" ?\x{FEFF}?\z", "")

    def either(place: int, pattern: str) -> Column:
        return F.when(long, F.get(words, F.lit(place))).otherwise(_found(tag, pattern))

    return [
        form.alias("form"),
        priority.alias("priority"),
        F.when(valid, F.floor(priority / _SEVERITIES).cast("int")).alias("facility"),
        F.when(valid, priority % _SEVERITIES).alias("severity"),
        F.when(long, F.regexp_extract(header, r"^<\d{1,3}>(\d{1,2}) ", 1).try_cast("int")).alias("version"),
        stamp.alias("stamp"),
        sent_at.alias("sent_at"),
        either(3, r"^([A-Za-z0-9_./-]+)").alias("app"),
        either(4, r"\[([^\]]*)\]").alias("process"),
        F.when(long, F.get(words, F.lit(5))).alias("message_kind"),
        F.when(long, _nil(data)).alias("structured_data"),
    ]
