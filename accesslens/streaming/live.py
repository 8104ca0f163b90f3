"""A timeline that is kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import instant_of, utc_ntz


def live_counts(rows: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(bucket, requests) over a stream of access rows, for update mode.

    The state holds the buckets of the last `late` of event time only. Rows older than that no
    longer count (the stored table has them); rows without an event time are in no bucket.
    """
    timed = rows.where("ts IS NOT NULL").select(instant_of(F.col("ts")).alias("at"))
    counted = (
        timed.withWatermark("at", late)
        .groupBy(F.window("at", width).alias("span"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.select(utc_ntz(F.col("span.start")).alias("bucket"), "requests")


def start_live_timeline(
    rows: DataFrame,
    folder: str,
    checkpoint: str,
    width: str = "5 minutes",
    late: str = "1 hour",
    trigger: dict | None = None,
    after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Keep the counts of `live_counts` under `folder`: each micro-batch writes the buckets it changed.

    A batch that is run again replaces its first attempt. `read_live_counts` gives the newest count
    of each bucket.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
        if after is not None:
            after(batch_id)

    return (
        live_counts(rows, width, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def read_live_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, requests) as of the newest batch that changed each bucket."""
    rows = spark.read.schema("bucket TIMESTAMP_NTZ, requests BIGINT, batch_id BIGINT").parquet(folder)
    return rows.groupBy("bucket").agg(F.max_by("requests", "batch_id").alias("requests"))
