"""The continuous ingest job: captured payloads in, one table per log type and rejects out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import utc_now
from ..operators.filters import Filter
from ..operators.framing import to_messages
from ..operators.reports import RECENT_ROWS, recent
from ..operators.routing import route
from ..plans.dashboard import dashboard_in_one_pass
from ..plans.ingest import UNKNOWN_TYPE, UNPARSED, UNROUTED, accepted, classify, rejected
from ..plans.registry import Registry
from ..sources.log_table import (
    newest_folders,
    read_folders,
    read_log,
    read_rejects,
    write_arrivals,
    write_log_batch,
    write_reject_batch,
)
from ..sources.source_table import SourceTable


@dataclass(frozen=True)
class BatchCounts:
    """What became of a batch's messages; `captured` is the sum of the others."""

    captured: int
    stored: int
    unrouted: int
    unknown_type: int
    unparsed: int


@dataclass(frozen=True)
class LogStore:
    """Where the tables live: `<root>/tables/<log type>`, `<root>/arrivals/<log type>` and `<root>/rejects`."""

    root: str
    registry: Registry = field(default_factory=Registry.with_defaults)

    def table_path(self, log_type: str) -> str:
        return f"{self.root}/tables/{log_type}"

    def arrivals_path(self, log_type: str) -> str:
        return f"{self.root}/arrivals/{log_type}"

    @property
    def rejects_path(self) -> str:
        return f"{self.root}/rejects"

    def read(
        self, spark: SparkSession, log_type: str = "apache", since: date | None = None
    ) -> DataFrame:
        schema = self.registry.schemas()[log_type]
        return read_log(spark, self.table_path(log_type), schema, since)

    def dashboard(
        self,
        spark: SparkSession,
        filter: Filter = Filter(),
        as_of: datetime | None = None,
        status_mode: str = "rounded",
    ) -> dict[str, DataFrame]:
        """The access-log view in one pass, listing no folders from before its window."""
        filter, as_of = filter.normalized(), as_of or utc_now()
        since = date.fromisoformat(filter.cutoff(as_of)[:10])
        rows = self.read(spark, since=since)
        return dashboard_in_one_pass(
            rows, filter, as_of, stored=lambda: self.read(spark), status_mode=status_mode
        )

    def recent(self, spark: SparkSession, log_type: str = "apache", n: int = RECENT_ROWS) -> DataFrame:
        """The n rows received last, out of the newest folders only (see `reports.recent`)."""
        folders = newest_folders(spark, self.arrivals_path(log_type), n)
        if folders is None:  # fewer rows are listed than asked for: the table itself says
            return recent(self.read(spark, log_type), n)
        schema = self.registry.schemas()[log_type]
        rows = read_folders(spark, self.table_path(log_type), schema, folders)
        return recent(rows.drop("received_date"), n)

    def read_rejects(self, spark: SparkSession) -> DataFrame:
        return read_rejects(spark, self.rejects_path)

    def write_batch(
        self,
        capture: DataFrame,
        sources: DataFrame,
        query_id: str,
        batch_id: int,
        framing: str = "datagrams",
        regroup: bool = True,
    ) -> BatchCounts:
        """Store one batch. Running it again with the same input and ids replaces it.

        The classified batch is kept on executors' disks for its several writes, so parsing
        runs once and a large batch takes no memory from other work; a lost executor's share
        is computed again from the capture.
        """
        routed = route(to_messages(capture, framing), sources)
        classified = classify(routed, self.registry).persist(StorageLevel.DISK_ONLY)
        try:
            # The job that parses and keeps the batch counts it, too. (Observed metrics would be lost
            # where a write turns out empty, and doubled where an executor is.)
            reason = F.col("reason")
            counts = classified.agg(
                F.count(F.lit(1)).alias("captured"),
                F.count_if(reason.isNull()).alias("stored"),
                *[F.count_if(reason == name).alias(name) for name in (UNROUTED, UNKNOWN_TYPE, UNPARSED)],
            ).first()
            for log_type in self.registry:
                rows = accepted(classified, log_type)
                lookups = getattr(log_type, "lookups", ())
                write_log_batch(rows, self.table_path(log_type.name), query_id, batch_id, regroup, lookups)
                write_arrivals(rows, self.arrivals_path(log_type.name), query_id, batch_id)
            write_reject_batch(
                rejected(classified), self.rejects_path, query_id, batch_id, regroup
            )
        finally:
            classified.unpersist()
        return BatchCounts(**counts.asDict())


def start_ingest(
    capture: DataFrame,
    sources: SourceTable,
    store: LogStore,
    checkpoint: str,
    framing: str = "datagrams",
    regroup: bool = True,
    trigger: dict | None = None,
    report: Callable[[int, BatchCounts], None] | None = None,
) -> StreamingQuery:
    """Run the ingest over a capture stream until stopped.

    The source table is looked up again for every micro-batch, so an edit takes effect with
    the next one. A failed batch is run again from the checkpoint, with the routing it had;
    nothing is lost or doubled. `report` is told each stored batch's number and counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query_id is None:
            raise RuntimeError("no query id: foreachBatch needs pinned threads (PYSPARK_PIN_THREAD)")
        routing = sources.read_for_batch(query_id, batch_id)
        counts = store.write_batch(batch, routing, query_id, batch_id, framing, regroup)
        if report is not None:
            report(batch_id, counts)

    return (
        capture.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
