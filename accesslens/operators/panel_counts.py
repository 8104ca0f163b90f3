"""All counts a dashboard needs, from one pass over the rows.

Panel by panel, a dashboard scans the window once per panel. Grouping sets scan it once and
send each row's four aspects through one partial aggregation; what is left to shuffle is one
row per task and distinct bucket and class, path or client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import is_error, status_class
from .filters import TimeRange

TIMES_AND_STATUSES = "times_and_statuses"
PATHS = "paths"
CLIENTS = "clients"

TOTALS = "totals"
MOST_FREQUENT = "most_frequent"

_KEYS = ("bucket", "class", "path", "remote_host")


def count_panels(
    rows: DataFrame, time_range: TimeRange, status_mode: str = "rounded"
) -> DataFrame:
    """(aspect, bucket, class, path, remote_host, requests, bytes, errors).

    `aspect` names the keys a row is grouped by; the others are NULL.
    """
    keyed = rows.select(
        time_range.bucket(F.col("ts")).alias("bucket"),
        status_class(F.col("status"), status_mode).alias("class"),
        "path",
        "remote_host",
        "bytes",
        is_error(F.col("status")).alias("is_error"),
    )
    counted = keyed.groupingSets([["bucket", "class"], ["path"], ["remote_host"]], *_KEYS).agg(
        F.grouping("bucket").alias("no_bucket"),
        F.grouping("path").alias("no_path"),
        F.count(F.lit(1)).alias("requests"),
        F.sum("bytes").alias("bytes"),
        F.count_if("is_error").alias("errors"),
    )
    aspect = (
        F.when(F.col("no_bucket") == 0, TIMES_AND_STATUSES)
        .when(F.col("no_path") == 0, PATHS)
        .otherwise(CLIENTS)
    )
    return counted.select(aspect.alias("aspect"), *_KEYS, "requests", "bytes", "errors")


def bounded_counts(counts: DataFrame, n: int) -> DataFrame:
    """What panels need of `count_panels`: (figure, aspect, bucket, class, label, requests, bytes, errors, clients).

    The totals have a row per bucket and class and one each for all paths and all clients; the most
    frequent are n paths and n clients, of which each task hands on n at most. Both read the same
    shuffle: every column of `counts` is used on either side, so that their plans are equal below it.
    """

    def total(column: str) -> Column:
        return F.sum(column).cast("bigint").alias(column)

    label = F.coalesce("path", "remote_host")
    totals = counts.groupBy("aspect", "bucket", "class").agg(
        *map(total, ("requests", "bytes", "errors")),
        F.count("remote_host").alias("clients"),
        F.max(label).alias("label"),
    )
    order = Window.partitionBy("aspect").orderBy(F.desc("requests"), F.asc_nulls_last("label"))
    first = (
        counts.withColumn("label", label)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("clients", F.lit(None).cast("bigint"))
    )
    columns = ("aspect", "bucket", "class", "label", "requests", "bytes", "errors", "clients")
    totals = totals.select(F.lit(TOTALS).alias("figure"), *columns)
    first = first.select(F.lit(MOST_FREQUENT).alias("figure"), *columns)
    # Of plans that read one relation Spark gives all but the first new column ids, and compares them
    # by these: with a first one that the optimizer removes, the two others stay equal.
    return totals.limit(0).unionByName(totals).unionByName(first)


def _figure(bounded: DataFrame, figure: str, aspect: str) -> DataFrame:
    return bounded.where((F.col("figure") == figure) & (F.col("aspect") == aspect))


def key_figures_of(bounded: DataFrame) -> DataFrame:
    """Same as `reports.key_figures`, from the totals of all clients."""

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    return _figure(bounded, TOTALS, CLIENTS).agg(
        total("requests").alias("requests"),
        total("clients").alias("unique_clients"),
        total("bytes").alias("total_bytes"),
        total("errors").alias("errors"),
    )


def bucket_counts(bounded: DataFrame) -> DataFrame:
    times = _figure(bounded, TOTALS, TIMES_AND_STATUSES)
    return times.groupBy("bucket").agg(F.sum("requests").alias("requests"))


def class_counts(bounded: DataFrame) -> DataFrame:
    statuses = _figure(bounded, TOTALS, TIMES_AND_STATUSES).where(F.col("class").isNotNull())
    return statuses.groupBy("class").agg(F.sum("requests").alias("requests"))


def path_counts(bounded: DataFrame) -> DataFrame:
    return _figure(bounded, MOST_FREQUENT, PATHS).select("label", "requests")


def client_counts(bounded: DataFrame) -> DataFrame:
    return _figure(bounded, MOST_FREQUENT, CLIENTS).select("label", "requests")
