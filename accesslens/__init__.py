"""Access-log analytics on Spark: syslog capture to typed tables, and reports over them."""

from .operators.filters import RANGES, Filter
from .plans.dashboard import dashboard, dashboard_in_one_pass, dashboard_long, in_one_frame
from .plans.ingest import ingest, parse_messages
from .plans.registry import AccessLogType, LogType, Registry
from .sources.log_table import read_log, read_rejects
from .sources.source_table import SourceTable
from .streaming.ingest import LogStore, start_ingest

__all__ = [
    "RANGES",
    "AccessLogType",
    "Filter",
    "LogStore",
    "LogType",
    "Registry",
    "SourceTable",
    "dashboard",
    "dashboard_in_one_pass",
    "dashboard_long",
    "in_one_frame",
    "ingest",
    "parse_messages",
    "read_log",
    "read_rejects",
    "start_ingest",
]
