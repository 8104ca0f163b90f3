"""Parsed rows and rejects as partitioned parquet.

Layout: `event_date=/received_date=/query_id=/batch_id=`, rejects without the event date.

- Dates come first, so a report over a window lists only the folders it needs; with a batch a
  minute, a year is half a million folders.
- A micro-batch overwrites its own partitions (dynamic overwrite), so one that is run again
  replaces its first attempt. That needs the same rows to come out again: the capture is
  replayed by the checkpoint, and routing is pinned per batch (`SourceTable.read_for_batch`).
- `query_id` identifies the checkpoint: a job started on a new one counts batches from 0 again
  and must not replace another job's partitions.

A small table of arrivals says, per batch and date folder, how many rows it holds and when the first
and the last of them were received. The latest rows are found through it: no other file is opened
than those of the newest folders.

Columns that single rows are looked up by have Bloom filters, which leave out the row groups that do
not hold a value even where every row group's min/max does.

Parquet keeps no usable min/max for a TIMESTAMP_NTZ filter in Spark 4.1 (the scan reads every
row), so the table carries pruning columns: the dates as partitions and the hour number, whose
min/max do skip row groups.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import hour_number
from ..schema import REJECTS, empty
from .files import Folder

_EVENT_DATE = T.StructField("event_date", T.DateType())
_ARRIVAL = [
    T.StructField("received_date", T.DateType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
]
_EVENT_HOUR = T.StructField("event_hour", T.IntegerType())
_ARRIVALS = T.StructType(
    [
        _EVENT_DATE,
        T.StructField("rows", T.LongType()),
        T.StructField("oldest", T.TimestampNTZType()),
        T.StructField("newest", T.TimestampNTZType()),
        *_ARRIVAL,
    ]
)


def with_pruning_columns(rows: DataFrame) -> DataFrame:
    """Add event_hour, event_date and received_date; rows without an event time go by arrival."""
    event = F.coalesce("ts", "received_at")
    return rows.select(
        "*",
        hour_number(event).alias("event_hour"),
        event.cast("date").alias("event_date"),
        F.col("received_at").cast("date").alias("received_date"),
    )


def _write(
    rows: DataFrame, dates: list[str], root: str, query_id: str, batch_id: int, regroup: bool,
    lookups: Iterable[str] = (),
) -> None:
    # Without adaptive execution the hint would send a whole date to one task.
    if regroup and rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        rows = rows.hint("rebalance", *dates)
    filters = {f"parquet.bloom.filter.enabled#{column}": "true" for column in lookups}
    if filters:  # sized by the values that a row group turns out to have
        filters |= {"parquet.bloom.filter.adaptive.enabled": "true"}
    (
        rows.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **filters)
        .partitionBy(*dates, "query_id", "batch_id")
        .parquet(root)
    )


def write_log_batch(
    rows: DataFrame, root: str, query_id: str, batch_id: int, regroup: bool = True,
    lookups: Iterable[str] = (),
) -> None:
    """Store one batch of parsed rows.

    Rows are first gathered by date into files of the advisory partition size: a batch read by
    a thousand tasks would otherwise leave a thousand small files per date, every minute.
    The rebalance hint lets adaptive execution split a date too big for one task, so a batch
    of a single day still writes in parallel. Without `regroup` each task writes its own files
    and nothing is shuffled, which suits input that is already large and by date.
    """
    dates = ["event_date", "received_date"]
    _write(with_pruning_columns(rows), dates, root, query_id, batch_id, regroup, lookups)


def write_arrivals(rows: DataFrame, root: str, query_id: str, batch_id: int) -> None:
    """Say what a stored batch has put where; written after the batch, and replaced with it."""
    told = (
        with_pruning_columns(rows)
        .groupBy("event_date", "received_date")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("received_at").alias("oldest"),
            F.max("received_at").alias("newest"),
        )
    )
    _write(told, ["received_date"], root, query_id, batch_id, regroup=False)


def _folder_of(arrival: Row) -> str:
    def part(name: str) -> str:
        value = arrival[name]
        return f"{name}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"

    return "/".join(map(part, ("event_date", "received_date", "query_id", "batch_id")))


def newest_folders(spark: SparkSession, root: str, n: int) -> list[str] | None:
    """Folders of a log table that hold its n rows received last, by the arrivals under `root`.

    Goes back date by date until there are rows enough; None if there never are. A folder is left
    out only where n rows are newer than its newest.
    """
    days = [name for name in Folder(spark, root).names() if name.startswith("received_date=")]
    arrivals, held = [], 0
    # Rows without a time of arrival come last; years beyond 9999 have a sign.
    for day in sorted(days, key=lambda name: ("__HIVE" not in name, "+" in name, name), reverse=True):
        found = _read(spark, root, f"{root}/{day}", _ARRIVALS).select(
            F.col("event_date").cast("string"), "rows", "oldest", "newest",
            F.col("received_date").cast("string"), "query_id", "batch_id",
        ).collect()
        arrivals += found
        held += sum(row["rows"] for row in found)
        if held >= n:
            break
    else:
        return None

    arrivals.sort(key=lambda row: (row["oldest"] is not None, row["oldest"]), reverse=True)
    held = 0
    for since in arrivals:
        held += since["rows"]
        if held >= n:
            break
    if since["oldest"] is None:
        return [_folder_of(row) for row in arrivals]
    return [_folder_of(row) for row in arrivals if row["newest"] is not None and row["newest"] >= since["oldest"]]


def write_reject_batch(
    rows: DataFrame, root: str, query_id: str, batch_id: int, regroup: bool = True
) -> None:
    dated = rows.withColumn("received_date", F.col("received_at").cast("date"))
    _write(dated, ["received_date"], root, query_id, batch_id, regroup)


def dates_since(first: date) -> str:
    """Glob for ISO dates from `first` on: per digit, all larger ones after the same prefix."""
    text = first.isoformat()
    later = [
        f"{text[:n]}[{int(digit) + 1}-9]*" for n, digit in enumerate(text) if digit in "012345678"
    ]
    return "{" + ",".join([text, *later, "+*"]) + "}"


def _read(spark: SparkSession, root: str, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise


def read_log(
    spark: SparkSession, root: str, schema: T.StructType, since: date | None = None
) -> DataFrame:
    """The stored rows with their pruning columns; empty before the first batch.

    The files are listed once, here: reports built on one returned DataFrame see one snapshot.
    With `since`, only folders of event dates from then on are listed, and rows before it are
    not part of the result.
    """
    path = root if since is None else f"{root}/event_date={dates_since(since)}"
    return _read(spark, root, path, _stored(schema))


def read_folders(spark: SparkSession, root: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    """The stored rows of some folders only."""
    paths = [f"{root}/{folder}" for folder in folders]
    return spark.read.schema(_stored(schema)).option("basePath", root).parquet(*paths)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [_EVENT_HOUR, _EVENT_DATE] + _ARRIVAL)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, root, T.StructType(REJECTS.fields + _ARRIVAL))
