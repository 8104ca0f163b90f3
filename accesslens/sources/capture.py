"""Reading what the syslog collectors land: files (batch or stream) or a message bus.

A capture row is (peer_ip, received_at, payload). Batch and streaming readers return the same
columns, so everything downstream is shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import utc_ntz
from ..schema import CAPTURE

#: Files, and offsets of a bus, that one micro-batch takes unless told otherwise; the rest waits.
FILES_PER_BATCH = 1_000
OFFSETS_PER_BATCH = 50_000_000


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows landed as parquet."""
    return spark.read.schema(CAPTURE).parquet(path)


def stream_capture(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """The same as a stream. `max_files` bounds a micro-batch; the backlog waits, none is shed."""
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", max_files).parquet(path)


def _from_text(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("peer_ip").cast("string").alias("peer_ip"),
        utc_ntz(F.col("_metadata.file_modification_time")).alias("received_at"),
        # lineSep is '\n', so a CRLF sender leaves its '\r' behind.
        F.regexp_replace("value", r"\r\z", "").cast("binary").alias("payload"),
    )


_TEXT_SCHEMA = "value STRING, peer_ip STRING"


def read_text_capture(spark: SparkSession, path: str) -> DataFrame:
    """Plain line files under `peer_ip=<address>/` folders, one message per line.

    Large files split across tasks. The file's modification time stands in for the arrival
    time, which stays the same however often the file is read.
    """
    return _from_text(spark.read.schema(_TEXT_SCHEMA).option("lineSep", "\n").text(path))


def stream_text_capture(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    reader = spark.readStream.schema(_TEXT_SCHEMA).option("lineSep", "\n").option("maxFilesPerTrigger", max_files)
    return _from_text(reader.text(path))


def from_bus(records: DataFrame) -> DataFrame:
    """Capture rows from Kafka-shaped records: key = peer address, value = payload."""
    return records.select(
        F.col("key").cast("string").alias("peer_ip"),
        utc_ntz(F.col("timestamp")).alias("received_at"),
        F.col("value").cast("binary").alias("payload"),
    )


def stream_bus_capture(
    spark: SparkSession, servers: str, topic: str, max_offsets: int = OFFSETS_PER_BATCH
) -> DataFrame:
    """A Kafka topic as a capture stream. Needs Spark's Kafka package on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
    )
    return from_bus(reader.load())
