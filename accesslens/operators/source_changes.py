"""Changes to the table that maps senders to log types, as DataFrame operators.

Each takes the current table and a DataFrame of changes and returns the next table. They
cost one shuffle by address with map-side combining, whatever number of changes one address has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_whitespace

# Why a change is refused, in the order the checks are made.
UNKNOWN_LOG_TYPE = "unknown_log_type"
NAME_REQUIRED = "name_required"
INVALID_IP = "invalid_ip"


def _address_parser() -> Callable[[str | None], str | None]:
    # Nested, so that executors get it by value and need not have this package installed.
    import ipaddress

    def canonical(text: str | None) -> str | None:
        if text is None or "%" in text:
            return None
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    return canonical


def canonical_ip(text: Column) -> Column:
    """The form in which a receiver reports this address, NULL if it is no address.

    IPv6 zero compression has no built-in Column, hence the (Arrow-batched) Python step; it
    runs over changes to the table of senders, never over messages.
    """
    canonical = _address_parser()

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(canonical)

    return F.pandas_udf(convert, T.StringType())(text)


def check_changes(changes: DataFrame, log_types: Iterable[str]) -> DataFrame:
    """Trim name and ip, put ip in canonical form and add `reason`, NULL where the change is valid."""
    name = trim_whitespace(F.col("name"))
    typed_ip = trim_whitespace(F.col("ip"))
    checked = changes.withColumns(
        {"name": name, "typed_ip": typed_ip, "ip": canonical_ip(typed_ip)}
    )
    known = F.coalesce(F.col("log_type").isin(sorted(log_types)), F.lit(False))
    reason = (
        F.when(~known, UNKNOWN_LOG_TYPE)
        .when(F.coalesce("name", F.lit("")) == "", NAME_REQUIRED)
        .when(F.col("ip").isNull(), INVALID_IP)
    )
    return (
        checked.withColumn("reason", reason)
        .withColumn("ip", F.coalesce("ip", "typed_ip"))
        .drop("typed_ip")
    )


def _in_turn(rows: DataFrame, created_at: Column, step: int, at: Column, seq: Column) -> DataFrame:
    turn = F.struct(
        F.lit(step).alias("step"),
        at.cast("timestamp_ntz").alias("at"),
        seq.cast("bigint").alias("seq"),
    )
    return rows.select("ip", "name", "log_type", created_at.alias("created_at"), turn.alias("turn"))


def upsert_sources(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert new senders; on a known address take over name and log type, keep created_at.

    `changes` has ip, name, log_type, requested_at and, to order changes of one instant,
    optionally seq. Applied in that order, so the last change of an address wins.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    before = _in_turn(current, F.col("created_at"), 0, F.lit(None), F.lit(0))
    after = _in_turn(changes, F.col("requested_at"), 1, F.col("requested_at"), seq)
    latest = F.max_by(F.struct("name", "log_type"), "turn").alias("latest")
    first = F.min_by("created_at", "turn").alias("created_at")
    return (
        before.unionByName(after)
        .groupBy("ip")
        .agg(latest, first)
        .select("ip", "latest.name", "latest.log_type", "created_at")
    )


def delete_sources(current: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the addresses listed in `removed.ip`; an address that is not there changes nothing."""
    typed = removed.select(trim_whitespace(F.col("ip")).alias("ip")).distinct()
    gone = typed.select(F.coalesce(canonical_ip(F.col("ip")), "ip").alias("ip"))
    return current.join(gone, "ip", "left_anti")


def list_sources(sources: DataFrame) -> DataFrame:
    """For display: by name in byte order, then by address."""
    return sources.select("name", "ip", "log_type").orderBy("name", "ip")


def count_sources(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count(F.lit(1)).alias("sources"))
