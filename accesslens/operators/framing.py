"""From captured payloads to single syslog messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.envelope import (
    envelope_header,
    envelope_host,
    envelope_message,
    header_fields,
    header_form,
    header_priority,
    header_stamp,
    header_tag,
    header_words,
    minutes_east,
    sent_time,
    split_envelope,
    stamp_clock,
)
from ..functions.text import decode_utf8


def decode_datagrams(capture: DataFrame) -> DataFrame:
    """Each payload is one message; line breaks inside it stay."""
    return capture.select("peer_ip", "received_at", decode_utf8(F.col("payload")).alias("line"))


def frame_lines(capture: DataFrame) -> DataFrame:
    """Each payload is a run of lines ending in LF or CRLF; what follows the last one counts if not empty.

    A NULL payload is one NULL line, so that it is rejected and counted like a NULL datagram.
    """
    lines = F.split(decode_utf8(F.col("payload")), r"\r?\n", -1)
    kept = F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.size(lines) - 1))
    # Not explode_outer, which would turn an empty payload into a NULL line as well.
    told = F.coalesce(kept.otherwise(lines), F.array(F.lit(None).cast("string")))
    return capture.select("peer_ip", "received_at", F.explode(told).alias("line"))


def open_envelopes(lines: DataFrame) -> DataFrame:
    """Replace `line` by host name and message text."""
    parted = lines.withColumn("parts", split_envelope(F.col("line")))
    return parted.select(
        F.col("peer_ip").alias("source_ip"),
        envelope_host(F.col("parts")).alias("hostname"),
        "received_at",
        envelope_message(F.col("parts")).alias("raw"),
    )


def read_headers(lines: DataFrame) -> DataFrame:
    """(source_ip, hostname, received_at, the header's fields, raw): the message with its envelope read.

    The line is matched once, as in `open_envelopes`; fields are taken from the header alone, each
    step a column of its own so that none is computed twice. A NULL line has NULL fields.
    """
    message = envelope_message(F.col("parts"))
    parted = lines.withColumn("parts", split_envelope(F.col("line"))).select(
        F.col("peer_ip").alias("source_ip"),
        "received_at",
        "parts",
        envelope_header(F.col("line"), message).alias("header"),
    )
    formed = parted.select(
        "*", header_form(F.col("header")).alias("form"), header_words(F.col("header")).alias("words")
    )
    header, form, words = F.col("header"), F.col("form"), F.col("words")
    told = formed.select(
        "*",
        header_stamp(header, form, words).alias("stamp"),
        header_tag(header, F.get("parts", F.lit(0))).alias("tag"),
        header_priority(header).alias("priority"),
    )
    timed = told.withColumn("clock", stamp_clock(F.col("stamp"))).withColumn("east", minutes_east(F.col("clock")))
    sent_at = sent_time(F.col("clock"), F.col("east"))
    return timed.select(
        "source_ip",
        envelope_host(F.col("parts")).alias("hostname"),
        "received_at",
        *header_fields(header, form, words, F.col("priority"), F.col("stamp"), sent_at, F.col("tag")),
        message.alias("raw"),
    )


FRAMINGS = {"datagrams": decode_datagrams, "lines": frame_lines}


def to_messages(capture: DataFrame, framing: str = "datagrams") -> DataFrame:
    """Capture rows to (source_ip, hostname, received_at, raw)."""
    return open_envelopes(FRAMINGS[framing](capture))


def to_headed_messages(capture: DataFrame, framing: str = "datagrams") -> DataFrame:
    """Capture rows to messages with every field of their header."""
    return read_headers(FRAMINGS[framing](capture))
