"""Jobs for spark-submit: `python -m accesslens --store <folder> <command> ...`."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .functions.times import utc_now
from .operators.filters import DEFAULT_RANGE, RANGES, Filter
from .operators.framing import FRAMINGS
from .operators.reports import as_json
from .operators.source_changes import list_sources
from .session import configure
from .sources.capture import stream_bus_capture, stream_capture, stream_text_capture
from .sources.source_table import SourceTable
from .streaming.ingest import LogStore, start_ingest

_READERS = {"parquet": stream_capture, "text": stream_text_capture}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="accesslens")
    parser.add_argument("--store", required=True, help="root folder of tables, senders and checkpoint")
    commands = parser.add_subparsers(dest="command", required=True)

    ingest = commands.add_parser("ingest", help="stream captures into the store")
    ingest.add_argument("capture", help="folder of captures, or broker list for --format kafka")
    ingest.add_argument("--format", choices=[*_READERS, "kafka"], default="parquet")
    ingest.add_argument("--topic", help="topic for --format kafka")
    ingest.add_argument("--framing", choices=sorted(FRAMINGS), default="datagrams")
    ingest.add_argument("--max-per-batch", type=int, help="files, or offsets, per micro-batch (bounded by default)")
    ingest.add_argument("--every", default="1 minute", help="trigger interval")
    ingest.add_argument("--once", action="store_true", help="take in what is there and stop")

    view = commands.add_parser("dashboard", help="print all panels")
    view.add_argument("--ip")
    view.add_argument("--path")
    view.add_argument("--status", type=int, help="status class, 4 for 4xx")
    view.add_argument("--range", choices=list(RANGES), default=DEFAULT_RANGE)
    view.add_argument("--as-of", type=datetime.fromisoformat, help="end of the window, UTC (default now)")

    commands.add_parser("recent", help="print the latest rows as JSON")
    commands.add_parser("sources", help="list the senders")
    add = commands.add_parser("add-source", help="add or change a sender")
    add.add_argument("name")
    add.add_argument("ip")
    add.add_argument("log_type")
    commands.add_parser("remove-source", help="remove a sender").add_argument("ip")
    return parser.parse_args(argv)


def _print(frame: DataFrame) -> None:
    """Every row, tab-separated, fetched one partition at a time."""
    print(*frame.columns, sep="\t")
    for row in frame.toLocalIterator():
        print(*row, sep="\t")


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    store = LogStore(options.store.rstrip("/"))
    sources = SourceTable(spark, f"{store.root}/sources", store.registry.names())
    if options.command == "ingest":
        limit = () if options.max_per_batch is None else (options.max_per_batch,)
        if options.format == "kafka":
            capture = stream_bus_capture(spark, options.capture, options.topic, *limit)
        else:
            capture = _READERS[options.format](spark, options.capture, *limit)
        trigger = {"availableNow": True} if options.once else {"processingTime": options.every}
        start_ingest(
            capture, sources, store, f"{store.root}/checkpoint", options.framing, trigger=trigger
        ).awaitTermination()
    elif options.command == "dashboard":
        filter = Filter(options.ip, options.path, options.status, options.range).normalized()
        panels = store.dashboard(spark, filter, options.as_of or utc_now())
        for name, panel in panels.items():
            print(f"{name} ({filter.range_label})")
            _print(panel)
    elif options.command == "recent":
        for row in as_json(store.recent(spark)).collect():
            print(row["json"])
    elif options.command == "sources":
        _print(list_sources(sources.read()))
    elif options.command == "add-source":
        sources.add(options.name, options.ip, options.log_type)
    elif options.command == "remove-source":
        sources.remove(options.ip)


def main() -> None:
    options = arguments()
    run(configure(SparkSession.builder.appName("accesslens")).getOrCreate(), options)


if __name__ == "__main__":
    main()
