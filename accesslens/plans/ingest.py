"""Messages to tables: route, parse by log type, and account for what is left over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.framing import to_messages
from ..operators.routing import route
from .registry import LogType, Registry

# Why a message reached no table.
UNROUTED = "unrouted"
UNKNOWN_TYPE = "unknown_type"
UNPARSED = "unparsed"


def parse_messages(messages: DataFrame, log_type: LogType) -> DataFrame:
    """Messages of one type to its stored columns; messages that do not parse are left out.

    `inline` over a NULL or one-element array drops those rows itself. A filter on the parsed
    struct would mean the same, but Catalyst pushes such a filter below the projection and
    runs the whole parser a second time inside it.
    """
    entry = log_type.entry(F.col("tokens"))
    return (
        messages.select("source_ip", "received_at", "raw", log_type.tokens(F.col("raw")).alias("tokens"))
        .select("source_ip", F.inline(F.when(entry.isNotNull(), F.array(entry))), "received_at", "raw")
    )


def _entry_column(log_type: LogType) -> str:
    return f"entry {log_type.name}"


def _tokens_column(log_type: LogType) -> str:
    return f"tokens {log_type.name}"


def _column(name: str) -> Column:
    """A column of this very name, whatever characters a log type's name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def classify(routed: DataFrame, registry: Registry) -> DataFrame:
    """One row per message: its entry under the type it was routed to, or the reason it has none.

    Only the parser of the row's own type runs on a row. Entries and reason come out of `inline`,
    below which Catalyst moves no filter: whatever is asked of the result, each parser runs once.
    """
    types = list(registry)
    tokens = {
        _tokens_column(t): F.when(F.col("log_type") == t.name, t.tokens(F.col("raw"))) for t in types
    }
    entries = {_entry_column(t): t.entry(_column(_tokens_column(t))) for t in types}
    parsed = reduce(Column.__or__, [_column(c).isNotNull() for c in entries], F.lit(False))
    reason = (
        F.when(F.col("log_type").isNull(), UNROUTED)
        .when(~F.col("log_type").isin(registry.names()), UNKNOWN_TYPE)
        .when(~parsed, UNPARSED)
    )
    tagged = F.struct(*map(_column, entries), reason.alias("reason"))
    return (
        routed.withColumns(tokens)
        .withColumns(entries)
        .select("source_ip", "received_at", "raw", F.inline(F.array(tagged)))
    )


def accepted(classified: DataFrame, log_type: LogType) -> DataFrame:
    entry = _column(_entry_column(log_type))
    fields = [entry[name].alias(name) for name in log_type.entry_schema.names]
    return classified.where(entry.isNotNull()).select("source_ip", *fields, "received_at", "raw")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).select(
        "source_ip", "received_at", "raw", "reason"
    )


def rejected_as(routed: DataFrame, registry: Registry, reason: str) -> DataFrame:
    """The rejects of one reason; nothing is parsed to find those that routing alone decides."""
    known = F.col("log_type").isin(registry.names())
    if reason == UNPARSED:
        return rejected(classify(routed.where(known), registry))
    chosen = {UNROUTED: F.col("log_type").isNull(), UNKNOWN_TYPE: ~known}[reason]
    return routed.where(chosen).select("source_ip", "received_at", "raw", F.lit(reason).alias("reason"))


def ingest(
    capture: DataFrame, sources: DataFrame, log_type: LogType, framing: str = "datagrams"
) -> DataFrame:
    """Captured payloads to the stored rows of one log type, lazily and in one pass.

    Only senders of that type are joined, so the table of senders is an inner, filtering side.
    """
    routed = route(to_messages(capture, framing), sources.where(F.col("log_type") == log_type.name))
    return parse_messages(routed.where(F.col("log_type").isNotNull()), log_type)


def reject_report(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))
