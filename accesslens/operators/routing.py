"""Routing: which log type a sender's messages belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A routing table up to this size is copied to every executor; it is measured, never assumed.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Above it, a frequent sender's messages are spread over this many shuffle keys; frequent is a sender
# with more than one in so many of all messages, so that there are never more of them than that.
SALTS = 64
FREQUENT = 64
# Rough in-memory cost of a hashed row besides its text.
_ROW_OVERHEAD = 64


def routing_table(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("ip").alias("source_ip"), "log_type")


def fits_broadcast(routes: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure the routing table: one small aggregation."""
    text = F.octet_length("source_ip") + F.octet_length("log_type") + _ROW_OVERHEAD
    size = routes.agg(F.sum(text).alias("bytes")).first()["bytes"]
    return (size or 0) <= max_bytes


def frequent_senders(messages: DataFrame, one_in: int = FREQUENT) -> list[str]:
    """Senders of more than that share of the messages: at most `one_in` of them, with any input.

    Reads the senders' column alone, counted within tasks first.
    """
    counts = messages.groupBy("source_ip").agg(F.count(F.lit(1)).alias("messages"))
    total = counts.agg(F.sum("messages")).scalar()
    hot = counts.where((F.col("messages") * one_in > total) & F.col("source_ip").isNotNull())
    return sorted(row["source_ip"] for row in hot.select("source_ip").collect())


def route(
    messages: DataFrame, sources: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Add `log_type`, NULL for a sender that is not in `sources`. Every message is kept.

    A small routing table is broadcast and messages do not move. With a larger one they are joined
    by sender, the frequent senders' over several keys each: of a sender with a third of all
    messages the table then has one copy per salt, of any other just its row.
    """
    routes = routing_table(sources)
    if fits_broadcast(routes, max_broadcast_bytes):
        return messages.join(F.broadcast(routes), "source_ip", "left")
    hot = F.col("source_ip").isin(frequent_senders(messages))
    by_message = F.pmod(F.xxhash64("received_at", "raw"), F.lit(SALTS)).cast("int")
    salted = messages.withColumn("salt", F.when(hot, by_message).otherwise(0))
    copies = routes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    return salted.join(copies.hint("merge"), ["source_ip", "salt"], "left").drop("salt")
