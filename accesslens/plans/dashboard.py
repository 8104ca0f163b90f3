"""All reports of one view under one filter, over one set of rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import utc_now
from ..operators import panel_counts as counted
from ..operators.filters import Filter
from ..operators.reports import (
    TOP_N,
    key_figure_texts,
    key_figures,
    report_state,
    show_statuses,
    show_timeline,
    show_top,
    status_breakdown,
    timeline,
    top_clients,
    top_urls,
)
from ..session import shared_folder

# The panels of a view.
PANELS = ("state", "key_figures", "timeline", "statuses", "top_urls", "top_clients")


def dashboard(
    rows: DataFrame,
    filter: Filter = Filter(),
    as_of: datetime | None = None,
    stored: Callable[[], DataFrame] | None = None,
    status_mode: str = "rounded",
) -> dict[str, DataFrame]:
    """One lazy DataFrame per panel, each with a scan of its own once it is asked for.

    Only whether anything is stored is looked up here (see `report_state`).

    All share one cutoff and, through `rows`, one file listing. If `rows` was read for recent
    dates only, `stored` reads the whole table. `status_mode` says how
    status classes are formed (see `status_class`), in the filter as in the breakdown.
    """
    filter = filter.normalized()
    covered = filter.apply(rows, as_of or utc_now(), status_mode)
    return {
        "state": report_state(rows, covered, stored),
        "key_figures": key_figure_texts(key_figures(covered)),
        "timeline": timeline(covered, filter.time_range),
        "statuses": status_breakdown(covered, status_mode),
        "top_urls": top_urls(covered),
        "top_clients": top_clients(covered),
    }


def dashboard_in_one_pass(
    rows: DataFrame,
    filter: Filter = Filter(),
    as_of: datetime | None = None,
    folder: str | None = None,
    stored: Callable[[], DataFrame] | None = None,
    status_mode: str = "rounded",
) -> dict[str, DataFrame]:
    """The same panels after one scan of the window, which runs at once.

    What the panels show of its counts (a row per bucket and class, and the first of the paths and
    clients) is written to `folder` (by default a new one in the cluster's shared checkpoint
    folder), and the panels read it from there: a lost executor costs no second scan, and nothing
    stays cached. Prefer this for a whole view, and
    `dashboard` for a panel or two.
    """
    filter = filter.normalized()
    covered = filter.apply(rows, as_of or utc_now(), status_mode)
    folder = folder or shared_folder(rows.sparkSession, "panel-counts")
    plan = counted.bounded_counts(counted.count_panels(covered, filter.time_range, status_mode), TOP_N)
    plan.write.partitionBy("figure", "aspect").parquet(folder)
    counts = rows.sparkSession.read.schema(plan.schema).parquet(folder)
    return {
        "state": _state_by_counts(rows, counts, stored),
        "key_figures": key_figure_texts(counted.key_figures_of(counts)),
        "timeline": show_timeline(counted.bucket_counts(counts), filter.time_range).orderBy("bucket"),
        "statuses": show_statuses(counted.class_counts(counts)),
        "top_urls": show_top(counted.path_counts(counts)),
        "top_clients": show_top(counted.client_counts(counts)),
    }


def _state_by_counts(
    rows: DataFrame, counts: DataFrame, stored: Callable[[], DataFrame] | None
) -> DataFrame:
    # Any count means there are rows, so the table need not be looked at.
    return report_state(rows, counts, stored) if counts.isEmpty() else report_state(counts, counts)


def in_one_frame(panels: dict[str, DataFrame]) -> DataFrame:
    """The counted panels in one frame: (panel, key, label, requests, pct).

    `key` is what a drill-down filters by: a bucket's start, a status class, a path, a client;
    for the key figures it is the figure's name and `requests` its value.
    """

    def panel(name: str, key: str) -> DataFrame:
        return panels[name].select(
            F.lit(name).alias("panel"),
            F.col(key).cast("string").alias("key"),
            F.col("label"),
            F.col("requests"),
            F.col("pct"),
        )

    names = ("requests", "unique_clients", "total_bytes", "errors")
    figures = panels["key_figures"].select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("key_figures").alias("panel"),
                        F.lit(name).alias("key"),
                        F.lit(name).alias("label"),
                        F.col(name).alias("requests"),
                        F.lit(None).cast("bigint").alias("pct"),
                    )
                    for name in names
                ]
            )
        )
    )
    parts = [
        figures,
        panel("timeline", "bucket"),
        panel("statuses", "class"),
        panel("top_urls", "label"),
        panel("top_clients", "label"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dashboard_long(
    rows: DataFrame, filter: Filter = Filter(), as_of: datetime | None = None
) -> DataFrame:
    """`dashboard` as one lazy frame."""
    return in_one_frame(dashboard(rows, filter, as_of))
