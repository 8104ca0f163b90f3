"""Table schemas. Every time is TIMESTAMP_NTZ holding UTC, so no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# One row per datagram, or per received chunk of newline-framed lines.
CAPTURE = T.StructType(
    [
        T.StructField("peer_ip", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

# Sender -> log type. `ip` is unique.
SOURCES = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

# Fields parsed out of one access line.
ACCESS_ENTRY = T.StructType(
    [
        T.StructField("remote_host", T.StringType()),
        T.StructField("ident", T.StringType()),
        T.StructField("auth_user", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
    ]
)

# Stored access rows: sender, parsed fields, arrival time, original message.
ACCESS_LOG = T.StructType(
    [T.StructField("source_ip", T.StringType())]
    + ACCESS_ENTRY.fields
    + [
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("raw", T.StringType()),
    ]
)

# Messages that reached no table, and why.
REJECTS = T.StructType(
    [
        T.StructField("source_ip", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("raw", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def stored_schema(entry: T.StructType) -> T.StructType:
    """Columns of the table kept for a log type whose parser yields `entry`."""
    return T.StructType(
        [ACCESS_LOG["source_ip"]] + entry.fields + [ACCESS_LOG["received_at"], ACCESS_LOG["raw"]]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
