"""Reports over access rows. Each takes rows already narrowed by a `Filter`.

Every aggregation here combines on the map side, so a path or client with a third of all
requests reaches its reducer as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.status import class_label, is_error, status_class
from ..functions.text import percent_text, readable_bytes
from .filters import TimeRange

# Sizes of the top-N and latest-rows reports.
TOP_N = 10
RECENT_ROWS = 50

RECENT_COLUMNS = (
    "source_ip",
    "remote_host",
    "auth_user",
    "ts",
    "method",
    "path",
    "protocol",
    "status",
    "bytes",
    "user_agent",
    "received_at",
)


def scan_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"))


def _key_figures(approximate_clients: bool) -> list[Column]:
    clients = F.approx_count_distinct if approximate_clients else F.count_distinct
    return [
        F.count(F.lit(1)).alias("requests"),
        clients("remote_host").alias("unique_clients"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(is_error(F.col("status"))).alias("errors"),
    ]


def key_figures(rows: DataFrame, approximate_clients: bool = False) -> DataFrame:
    """Requests, distinct clients, bytes served and errors: one row, also over no rows at all."""
    return rows.agg(*_key_figures(approximate_clients))


#: Sketches of 2^12 registers: a standard error of 1.6 % of the count, within 5 % almost always.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def client_sketches(rows: DataFrame) -> DataFrame:
    """(hour, clients SKETCH) of a few KB at most per hour: kept, they count the clients of any span of hours."""
    hour = F.window("ts", "1 hour")["start"]
    return rows.where("ts IS NOT NULL").groupBy(hour.alias("hour")).agg(
        F.hll_sketch_agg("remote_host", SKETCH_BITS).alias("clients")
    )


def unique_clients_of(sketches: DataFrame) -> DataFrame:
    """About how many distinct clients these hours had together: one row, also over no hours.

    For long windows over billions of clients; `key_figures` counts exactly. The relative error has
    a standard deviation of `SKETCH_ERROR`.
    """
    estimate = F.hll_sketch_estimate(F.hll_union_agg("clients"))
    return sketches.agg(F.coalesce(estimate, F.lit(0)).cast("bigint").alias("unique_clients"))


def key_figure_texts(figures: DataFrame) -> DataFrame:
    """Add the error rate in percent and both figures that are shown as text."""
    return figures.withColumn("error_rate", error_rate(F.col("errors"), F.col("requests"))).select(
        "*",
        percent_text(F.col("error_rate")).alias("error_rate_text"),
        readable_bytes(F.col("total_bytes")).alias("total_bytes_text"),
    )


def error_rate(errors: Column, requests: Column) -> Column:
    return F.when(requests > 0, errors * F.lit(100.0) / requests).otherwise(F.lit(0.0))


def share_of(count: Column, peak: Column) -> Column:
    """Whole percent of the largest count, within 0..100; 0 when there is none."""
    percent = F.call_function("div", count * 100, peak)
    return F.when(peak > 0, F.greatest(F.least(percent, F.lit(100)), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def timeline(rows: DataFrame, time_range: TimeRange) -> DataFrame:
    """Requests per time bucket, empty buckets left out, oldest first."""
    counts = rows.groupBy(time_range.bucket(F.col("ts")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return show_timeline(counts, time_range).orderBy("bucket")


def show_timeline(counts: DataFrame, time_range: TimeRange) -> DataFrame:
    """Label (bucket, requests) and add each bucket's share of the peak.

    Rows stay apart by bucket, never by label: 24 hours touch 25 clock hours, so a label can
    repeat. The peak is a scalar subquery that reuses the shuffle of `counts`; the buckets,
    whose number has no bound when senders' clocks are wrong, never gather in one task.
    """
    peak = counts.agg(F.max("requests")).scalar()
    return counts.select(
        "bucket",
        time_range.bucket_label(F.col("bucket")).alias("label"),
        "requests",
        share_of(F.col("requests"), peak).alias("pct"),
    )


def _with_share(few_rows: DataFrame) -> DataFrame:
    # One window over everything: only for results of a fixed small size.
    peak = F.max("requests").over(W.partitionBy())
    return few_rows.withColumn("pct", share_of(F.col("requests"), peak))


def status_breakdown(rows: DataFrame, mode: str = "rounded") -> DataFrame:
    """Requests per status class, rows without a status left out."""
    counts = (
        rows.where(F.col("status").isNotNull())
        .groupBy(status_class(F.col("status"), mode).alias("class"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return show_statuses(counts)


def show_statuses(counts: DataFrame) -> DataFrame:
    """Label (class, requests) and add shares, by class. A three-digit status has at most 11 classes."""
    label = class_label(F.col("class")).alias("label")
    return _with_share(counts).select("class", label, "requests", "pct").orderBy("class")


def top_n(rows: DataFrame, column: str, n: int = TOP_N) -> DataFrame:
    """The n most frequent values, equal counts in the values' byte order."""
    counts = rows.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("requests"))
    return show_top(counts, n)


def show_top(counts: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first n of (label, requests), with shares."""
    return _with_share(counts.orderBy(F.desc("requests"), F.asc_nulls_last("label")).limit(n))


def top_urls(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    return top_n(rows, "path", n)


def top_clients(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    return top_n(rows, "remote_host", n)


def _newest_dates(rows: DataFrame, n: int) -> DataFrame:
    """Keep the newest arrival dates that together hold at least n rows.

    Counting by a partition column reads file footers only, and its result has one row per
    date, so at 100 TB the wide read that follows covers a day instead of the whole table.
    """
    per_date = rows.groupBy("received_date").agg(F.count(F.lit(1)).alias("rows"))
    newer = F.sum("rows").over(W.orderBy(F.desc("received_date")))
    enough = per_date.select("received_date", (newer >= n).alias("enough"))
    first = enough.where("enough").agg(F.max("received_date").alias("date")).first()["date"]
    return rows if first is None else rows.where(F.col("received_date") >= F.lit(first))


def recent(rows: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The n rows received last, times as text. Ties go by sender and message text."""
    if "received_date" in rows.columns:
        rows = _newest_dates(rows, n)
    times = {name: F.col(name).cast("string").alias(name) for name in ("ts", "received_at")}
    newest = rows.orderBy(F.desc("received_at"), "source_ip", "raw").limit(n)
    return newest.select(*[times.get(name, F.col(name)) for name in RECENT_COLUMNS])


def recent_json(rows: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """`recent` as JSON objects."""
    return as_json(recent(rows, n))


def as_json(latest: DataFrame) -> DataFrame:
    """Rows of `recent` as JSON objects; a missing value is an explicit null."""
    return latest.select(
        F.to_json(F.struct(*RECENT_COLUMNS), {"ignoreNullFields": "false"}).alias("json")
    )


# What a view of the reports can be in.
NO_LOGS = "no_logs"
NO_MATCH = "no_match"
OK = "ok"


def report_state(
    rows: DataFrame, covered: DataFrame, stored: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """Whether anything is stored at all, and whether the filter covers any of it.

    The first question is answered here, by a look at the first file that has a row; the second
    when the result is read, each task stopping at its first row. Where `rows` is only a part
    of the table, `stored` gives all of it, and is asked only if that part is empty.
    """
    if rows.isEmpty() and (stored is None or stored().isEmpty()):
        return rows.sparkSession.range(1).select(F.lit(NO_LOGS).alias("state"))
    found = covered.select(F.lit(1).alias("found")).limit(1).agg(F.count("found").alias("found"))
    return found.select(F.when(F.col("found") > 0, OK).otherwise(NO_MATCH).alias("state"))
