"""Small inputs for tests."""

from datetime import datetime

from accesslens.plans.ingest import parse_messages
from accesslens.plans.registry import AccessLogType

RECEIVED = datetime(2026, 6, 12, 9, 30)


def messages(spark, lines):
    return spark.createDataFrame(
        [("10.0.0.1", RECEIVED, line) for line in lines],
        "source_ip STRING, received_at TIMESTAMP_NTZ, raw STRING",
    )


def parse(spark, *lines):
    """Stored rows of these messages as dicts, in order of their text."""
    rows = parse_messages(messages(spark, lines), AccessLogType()).collect()
    return {row["raw"]: row.asDict() for row in rows}


def parse_one(spark, line):
    return parse(spark, line).get(line)


def captures(spark, payloads):
    """(peer, payload) pairs, one second apart."""
    return spark.createDataFrame(
        [
            (peer, RECEIVED.replace(second=n % 60, minute=n // 60 % 60), None if payload is None else bytearray(payload))
            for n, (peer, payload) in enumerate(payloads)
        ],
        "peer_ip STRING, received_at TIMESTAMP_NTZ, payload BINARY",
    )


def access_rows(spark, rows):
    """(ts, remote_host, path, status, bytes) tuples as access rows."""
    return spark.createDataFrame(
        rows, "ts TIMESTAMP_NTZ, remote_host STRING, path STRING, status INT, bytes BIGINT"
    )
