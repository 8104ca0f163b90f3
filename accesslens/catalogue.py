"""The operators of this package as named queries over the test tables, each with its check in SQL.

A query derives syslog captures from a table (see `samples`) and runs the real path: decode,
envelope, parse, report. Its SQL computes the expected result from the table's columns without
building or parsing a line, so the two sides share no parser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .functions.status import status_class
from .functions.text import one_decimal, readable_bytes
from .operators import reports
from .operators.filters import Filter
from .operators.framing import decode_datagrams, frame_lines, to_headed_messages, to_messages
from .operators.routing import route
from .operators.source_changes import (
    check_changes,
    count_sources,
    delete_sources,
    list_sources,
    upsert_sources,
)
from .plans.dashboard import dashboard_in_one_pass, dashboard_long, in_one_frame
from .plans.ingest import classify, ingest, parse_messages, reject_report, rejected, rejected_as
from .plans.registry import AccessLogType, Registry
from .session import shared_folder
from .sources.capture import from_bus, read_capture, read_text_capture, stream_capture
from .sources.source_table import SourceTable
from .streaming.ingest import LogStore, start_ingest
from .streaming.live import read_live_counts, start_live_timeline

AS_OF = datetime(2024, 1, 15, 12)
ORDERS_AS_OF = datetime(2000, 6, 15)
# The longer windows begin inside the data too, so that each leaves out rows that the next one has.
LONG_AS_OF = {"30d": datetime(2024, 2, 4), "1y": datetime(2025, 1, 2)}
#: For a stream that takes whatever has landed as one micro-batch.
ALL_FILES = 2**31 - 1

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    CATALOGUE[name] = Entry(query, sql)


# --- common inputs -------------------------------------------------------------------------


def access_rows(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """Every message of the table, parsed as an access line."""
    messages = to_messages(samples.capture(samples.traffic(spark, sf_dir, table)))
    return parse_messages(messages, AccessLogType())


def routed_messages(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    traffic = samples.traffic(spark, sf_dir)
    return route(to_messages(samples.capture(traffic)), samples.senders(traffic), **options)


def ingested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of known access-log senders only, parsed."""
    traffic = samples.traffic(spark, sf_dir)
    return ingest(samples.capture(traffic), samples.senders(traffic), AccessLogType())


def streamed_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """Land the table's captures as files, stream them in and return the filled store."""
    folder = shared_folder(spark, "stream")
    traffic = samples.traffic(spark, sf_dir)
    samples.capture(traffic).write.parquet(f"{folder}/capture")
    store = LogStore(f"{folder}/store")
    sources = SourceTable(spark, f"{folder}/sources", store.registry.names())
    sources.write(samples.senders(traffic))
    query = start_ingest(
        stream_capture(spark, f"{folder}/capture"),
        sources,
        store,
        checkpoint=f"{folder}/checkpoint",
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return store


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    folder = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after one batch with all of the table's messages."""
    traffic = samples.traffic(spark, sf_dir)
    store = LogStore(shared_folder(spark, "store"))
    store.write_batch(samples.capture(traffic), samples.senders(traffic), "batch", 0)
    return store.read(spark)


ACCESS_COLUMNS = (
    "peer_ip AS source_ip, remote_host, ident, auth_user, ts, method, path, protocol,"
    " CAST(status AS INTEGER) AS status, bytes, referer, user_agent, received_at, msg AS raw"
)


def access_sql(table: str = "events") -> str:
    return f"SELECT {ACCESS_COLUMNS} FROM ({samples.traffic_sql(table)}) WHERE NOT is_bad"


def ingested_sql() -> str:
    known = ", ".join(f"'{ip}'" for ip, kind in samples.SENDERS.items() if kind == "apache")
    return f"SELECT * FROM ({access_sql()}) WHERE source_ip IN ({known})"


def window_sql(range_key: str, as_of: datetime = AS_OF, rows: str | None = None) -> str:
    cutoff = Filter(range=range_key).cutoff(as_of)
    return f"SELECT * FROM ({rows or access_sql()}) WHERE ts >= TIMESTAMP '{cutoff}'"


def covered(spark: SparkSession, sf_dir: str, filter: Filter, as_of: datetime = AS_OF) -> DataFrame:
    return filter.apply(access_rows(spark, sf_dir), as_of)


# --- sources and framing -------------------------------------------------------------------


def _landed_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "capture")
    samples.capture(samples.traffic(spark, sf_dir)).write.parquet(folder)
    return decode_datagrams(read_capture(spark, folder))


register(
    "read_capture",
    _landed_capture,
    f"SELECT peer_ip, received_at, line FROM ({samples.traffic_sql()})",
)


def _landed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "text")
    lines = samples.traffic(spark, sf_dir).select("peer_ip", "line")
    lines.write.partitionBy("peer_ip").text(folder)
    return decode_datagrams(read_text_capture(spark, folder)).select("peer_ip", "line")


register("read_text_capture", _landed_text, f"SELECT peer_ip, line FROM ({samples.traffic_sql()})")


def _bus_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = samples.traffic(spark, sf_dir).selectExpr(
        "CAST(peer_ip AS BINARY) AS key",
        "CAST(line AS BINARY) AS value",
        "CAST(convert_timezone('UTC', current_timezone(), received_at) AS TIMESTAMP) AS timestamp",
    )
    return decode_datagrams(from_bus(records))


register(
    "bus_capture",
    _bus_capture,
    f"SELECT peer_ip, received_at, line FROM ({samples.traffic_sql()})",
)


def _damaged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stray byte, a cut-off three-byte character, an overlong pair.
    damaged = samples.traffic(spark, sf_dir).selectExpr(
        "peer_ip", "received_at",
        "concat(X'FF', CAST(line AS BINARY), X'E282', CAST('|' AS BINARY), X'C0AF') AS payload",
    )
    return decode_datagrams(damaged)


register(
    "decode_payload",
    _damaged_payloads,
    "SELECT peer_ip, received_at, '\ufffd' || line || '\ufffd|\ufffd\ufffd' AS line"
    f" FROM ({samples.traffic_sql()})",
)


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Line, CRLF, empty line, LF, a line of its own; the last one ends in LF on even ids only.
    chunks = samples.traffic(spark, sf_dir).selectExpr(
        "peer_ip", "received_at",
        "CAST(concat(line, '\\r\\n', '\\n', 'tail ', id, IF(id % 2 = 0, '\\n', '')) AS BINARY) AS payload",
    )
    return frame_lines(chunks)


register(
    "frame_lines",
    _framed,
    f"WITH t AS ({samples.traffic_sql()})"
    " SELECT peer_ip, received_at, line FROM t"
    " UNION ALL SELECT peer_ip, received_at, '' FROM t"
    " UNION ALL SELECT peer_ip, received_at, 'tail ' || CAST(id AS VARCHAR) FROM t",
)


# --- parsing -------------------------------------------------------------------------------

register(
    "parse_envelope",
    lambda spark, sf_dir: to_messages(samples.capture(samples.traffic(spark, sf_dir))),
    f"SELECT peer_ip AS source_ip, hostname, received_at, msg AS raw FROM ({samples.traffic_sql()})",
)

# Headers as they come from forwarders and devices, by id; all name the host web-1.
_HEADERS = (
    "<134>2024-01-01T00:06:29+00:00 web-1 apache-access ", "<134>2024-01-01T00:06:29.5Z web-1 apache.access[7] ",
    "<134>2024-01-01T00:06:29Z web-1 apache: ", "<134>Jan  1 00:06:29.123 web-1 apache: ",
    "<134>Jan  1 00:06:29 UTC web-1 apache[7]: ", "<134>Jan  1 2024 00:06:29 web-1 apache[7] ",
    "Jan  1 00:06:29 web-1 apache: ", "<134>1 2024-01-01T00:06:29Z web-1 apache 77 ID [a b=\"]\"] ",
)


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(*map(F.lit, _HEADERS))
    line = F.concat(F.get(headers, (F.col("id") % len(_HEADERS)).cast("int")), "msg")
    traffic = samples.traffic(spark, sf_dir)
    return traffic.select("peer_ip", "received_at", line.cast("binary").alias("payload"))


register(
    "parse_envelope_forms",
    lambda spark, sf_dir: to_messages(_headed(spark, sf_dir)),
    f"SELECT peer_ip AS source_ip, 'web-1' AS hostname, received_at, msg AS raw FROM ({samples.traffic_sql()})",
)

register(
    "envelope_fields",
    lambda spark, sf_dir: to_headed_messages(samples.capture(samples.traffic(spark, sf_dir))),
    "SELECT peer_ip AS source_ip, hostname, received_at,"
    " CASE id % 3 WHEN 2 THEN 'rfc5424' WHEN 1 THEN 'bsd' END AS form,"
    " CASE WHEN id % 3 > 0 THEN 134 END AS priority, CASE WHEN id % 3 > 0 THEN 16 END AS facility,"
    " CASE WHEN id % 3 > 0 THEN 6 END AS severity, CASE WHEN id % 3 = 2 THEN 1 END AS version,"
    " CASE id % 3 WHEN 2 THEN substring(utc_text, 1, 10) || 'T' || substring(utc_text, 12, 8) || 'Z'"
    f" WHEN 1 THEN {samples.bsd_stamp('utc_text')} END AS stamp,"
    " CASE WHEN id % 3 = 2 THEN ts0 END AS sent_at, CASE WHEN id % 3 > 0 THEN 'apache' END AS app,"
    " CASE WHEN id % 3 = 2 OR id % 3 = 1 AND id % 2 = 0 THEN '77' END AS process,"
    " CAST(NULL AS VARCHAR) AS message_kind, CAST(NULL AS VARCHAR) AS structured_data, msg AS raw"
    f" FROM ({samples.traffic_sql()})",
)

# What the fields of `_HEADERS` are: place, form, priority, version, stamp, sent_text, app, process, kind, data.
_HEADER_FIELDS_SQL = """(VALUES
    (0, 'rfc3339', 134, NULL, '2024-01-01T00:06:29+00:00', '2024-01-01 00:06:29', 'apache-access', NULL, NULL, NULL),
    (1, 'rfc3339', 134, NULL, '2024-01-01T00:06:29.5Z', '2024-01-01 00:06:29.5', 'apache.access', '7', NULL, NULL),
    (2, 'rfc3339', 134, NULL, '2024-01-01T00:06:29Z', '2024-01-01 00:06:29', 'apache', NULL, NULL, NULL),
    (3, 'bsd', 134, NULL, 'Jan  1 00:06:29.123', NULL, 'apache', NULL, NULL, NULL),
    (4, 'bsd', 134, NULL, 'Jan  1 00:06:29 UTC', NULL, 'apache', '7', NULL, NULL),
    (5, 'bsd', 134, NULL, 'Jan  1 2024 00:06:29', NULL, 'apache', '7', NULL, NULL),
    (6, 'bsd', NULL, NULL, 'Jan  1 00:06:29', NULL, 'apache', NULL, NULL, NULL),
    (7, 'rfc5424', 134, 1, '2024-01-01T00:06:29Z', '2024-01-01 00:06:29', 'apache', '77', 'ID', '[a b="]"]')
) AS headers(place, form, priority, version, stamp, sent_text, app, process, message_kind, structured_data)"""

register(
    "envelope_fields_forms",
    lambda spark, sf_dir: to_headed_messages(_headed(spark, sf_dir)),
    "SELECT peer_ip AS source_ip, 'web-1' AS hostname, received_at, form, priority,"
    " CAST(floor(priority / 8) AS INTEGER) AS facility, priority % 8 AS severity, version, stamp,"
    " CAST(sent_text AS TIMESTAMP) AS sent_at, app, process, message_kind, structured_data, msg AS raw"
    f" FROM ({samples.traffic_sql()}) JOIN {_HEADER_FIELDS_SQL} ON id % 8 = place",
)
register("parse_access", access_rows, access_sql())
register(
    "parse_access_orders",
    lambda spark, sf_dir: access_rows(spark, sf_dir, "orders"),
    access_sql("orders"),
)
register(
    "parse_access_lineitem",
    lambda spark, sf_dir: access_rows(spark, sf_dir, "lineitem"),
    access_sql("lineitem"),
)
register(
    "parse_request",
    lambda spark, sf_dir: access_rows(spark, sf_dir).select("raw", "method", "path", "protocol"),
    f"SELECT raw, method, path, protocol FROM ({access_sql()})",
)
register(
    "parse_time_utc",
    lambda spark, sf_dir: access_rows(spark, sf_dir).select("raw", "ts"),
    f"SELECT raw, ts FROM ({access_sql()})",
)
register(
    "common_vs_combined",
    lambda spark, sf_dir: access_rows(spark, sf_dir)
    .groupBy("referer", "user_agent")
    .agg(F.count(F.lit(1)).alias("requests")),
    "SELECT referer, user_agent, CAST(count(*) AS BIGINT) AS requests"
    f" FROM ({access_sql()}) GROUP BY referer, user_agent",
)

# --- routing and rejects -------------------------------------------------------------------

_ROUTE_CASES = " ".join(f"WHEN '{ip}' THEN '{kind}'" for ip, kind in samples.SENDERS.items())
_ROUTED_SQL = (
    "SELECT peer_ip AS source_ip, hostname, received_at, msg AS raw,"
    f" CASE peer_ip {_ROUTE_CASES} END AS log_type, is_bad FROM ({samples.traffic_sql()})"
)
_ROUTED_COLUMNS = "source_ip, hostname, received_at, raw, log_type"

register("route", routed_messages, f"SELECT {_ROUTED_COLUMNS} FROM ({_ROUTED_SQL})")
register(
    "route_large_table",
    lambda spark, sf_dir: routed_messages(spark, sf_dir, max_broadcast_bytes=0),
    f"SELECT {_ROUTED_COLUMNS} FROM ({_ROUTED_SQL})",
)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(classify(routed_messages(spark, sf_dir), Registry.with_defaults()))


_REJECTS_SQL = (
    "SELECT source_ip, received_at, raw, CASE WHEN log_type IS NULL THEN 'unrouted'"
    " WHEN log_type <> 'apache' THEN 'unknown_type' WHEN is_bad THEN 'unparsed' END AS reason"
    f" FROM ({_ROUTED_SQL}) WHERE log_type IS NULL OR log_type <> 'apache' OR is_bad"
)


def _rejects_with(reason: str) -> Query:
    return lambda spark, sf_dir: rejected_as(routed_messages(spark, sf_dir), Registry.with_defaults(), reason)


for _reason in ("unrouted", "unknown_type", "unparsed"):
    register(_reason, _rejects_with(_reason), f"SELECT * FROM ({_REJECTS_SQL}) WHERE reason = '{_reason}'")
register(
    "rejects_by_reason",
    lambda spark, sf_dir: reject_report(_rejects(spark, sf_dir)),
    f"SELECT reason, CAST(count(*) AS BIGINT) AS messages FROM ({_REJECTS_SQL}) GROUP BY reason",
)
register("dispatch", ingested_rows, ingested_sql())


def _two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two log types behind one router: what each of them stored, and the rejects."""
    registry = Registry(AccessLogType(), samples.NoteType(name="mailer"))
    store = LogStore(shared_folder(spark, "types"), registry)
    traffic = samples.traffic(spark, sf_dir)
    store.write_batch(samples.capture(traffic), samples.senders(traffic), "batch", 0)
    access = store.read(spark).select(F.lit("apache").alias("log_type"), "source_ip", "raw", F.col("path").alias("found"))
    notes = store.read(spark, "mailer").select(F.lit("mailer").alias("log_type"), "source_ip", "raw", F.col("note").alias("found"))
    rejects = store.read_rejects(spark).select(F.lit(None).alias("log_type"), "source_ip", "raw", F.col("reason").alias("found"))
    return access.unionByName(notes).unionByName(rejects)


register(
    "dispatch_two_types",
    _two_types,
    "SELECT CASE WHEN log_type = 'apache' AND NOT is_bad THEN 'apache' WHEN log_type = 'mailer' AND is_bad THEN 'mailer' END"
    " AS log_type, peer_ip AS source_ip, msg AS raw, CASE WHEN log_type IS NULL THEN 'unrouted'"
    " WHEN log_type = 'apache' THEN CASE WHEN is_bad THEN 'unparsed' ELSE path END"
    " WHEN is_bad THEN CAST(id AS VARCHAR) ELSE 'unparsed' END AS found"
    f" FROM (SELECT *, CASE peer_ip {_ROUTE_CASES} END AS log_type FROM ({samples.traffic_sql()}))",
)

# --- source table --------------------------------------------------------------------------


def _senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.senders(samples.traffic(spark, sf_dir))


register(
    "sources_list",
    lambda spark, sf_dir: list_sources(_senders(spark, sf_dir)),
    f"SELECT name, ip, log_type FROM ({samples.senders_sql()}) ORDER BY name, ip",
)
register(
    "sources_count",
    lambda spark, sf_dir: count_sources(_senders(spark, sf_dir)),
    f"SELECT CAST(count(*) AS BIGINT) AS sources FROM ({samples.senders_sql()})",
)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every row asks for a change: of a known sender or of one of a second, new network.
    changes = samples.traffic(spark, sf_dir).selectExpr(
        "concat('10.0.', user_id % 2, '.', user_id % 8) AS ip",
        "concat('site ', kind, ' ', id % 5) AS name",
        "'apache' AS log_type",
        "received_at AS requested_at",
        "id AS seq",
    )
    return upsert_sources(_senders(spark, sf_dir), changes)


register(
    "sources_upsert",
    _upserted,
    f"WITH t AS ({samples.traffic_sql()}), old AS ({samples.senders_sql()}),"
    " changes AS (SELECT '10.0.' || CAST(user_id % 2 AS VARCHAR) || '.' || CAST(user_id % 8 AS VARCHAR) AS ip,"
    " 'site ' || kind || ' ' || CAST(id % 5 AS VARCHAR) AS name, 'apache' AS log_type, received_at, id FROM t),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY received_at DESC, id DESC) AS n,"
    " min(received_at) OVER (PARTITION BY ip) AS first_at FROM changes),"
    " latest AS (SELECT ip, name, log_type, first_at FROM ranked WHERE n = 1)"
    " SELECT coalesce(latest.ip, old.ip) AS ip, coalesce(latest.name, old.name) AS name,"
    " coalesce(latest.log_type, old.log_type) AS log_type,"
    " coalesce(old.created_at, latest.first_at) AS created_at"
    " FROM old FULL OUTER JOIN latest ON old.ip = latest.ip",
)
register(
    "sources_delete",
    lambda spark, sf_dir: delete_sources(
        _senders(spark, sf_dir),
        samples.traffic(spark, sf_dir).selectExpr("concat(' 10.0.0.', user_id % 4, ' ') AS ip"),
    ),
    f"SELECT * FROM ({samples.senders_sql()}) WHERE ip NOT IN"
    f" (SELECT '10.0.0.' || CAST(user_id % 4 AS VARCHAR) FROM ({samples.traffic_sql()}))",
)


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = samples.traffic(spark, sf_dir).selectExpr(
        "CASE id % 8 WHEN 0 THEN '2001:DB8:0:0:0:0:0:1' WHEN 1 THEN '256.1.1.1' WHEN 2 THEN '10.0.0'"
        " WHEN 3 THEN '010.0.0.1' WHEN 4 THEN 'fe80::1%eth0' WHEN 5 THEN '\\t10.0.0.5 '"
        " WHEN 6 THEN '' ELSE '::FFFF:10.0.0.7' END AS ip",
        "IF(id % 6 = 0, ' \\n', concat(' ', kind, ' ')) AS name",
        "IF(id % 5 = 0, 'mailer', 'apache') AS log_type",
    )
    return check_changes(changes, ["apache"]).select("ip", "name", "log_type", "reason")


register(
    "sources_validate",
    _validated,
    "SELECT CASE id % 8 WHEN 0 THEN '2001:db8::1' WHEN 1 THEN '256.1.1.1' WHEN 2 THEN '10.0.0'"
    " WHEN 3 THEN '010.0.0.1' WHEN 4 THEN 'fe80::1%eth0' WHEN 5 THEN '10.0.0.5'"
    " WHEN 6 THEN '' ELSE '::ffff:10.0.0.7' END AS ip,"
    " CASE WHEN id % 6 = 0 THEN '' ELSE kind END AS name,"
    " CASE WHEN id % 5 = 0 THEN 'mailer' ELSE 'apache' END AS log_type,"
    " CASE WHEN id % 5 = 0 THEN 'unknown_log_type' WHEN id % 6 = 0 THEN 'name_required'"
    " WHEN id % 8 IN (1, 2, 3, 4, 6) THEN 'invalid_ip' END AS reason"
    f" FROM ({samples.traffic_sql()})",
)


def _stored_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = SourceTable(spark, shared_folder(spark, "sources"), ["apache"])
    table.write(_senders(spark, sf_dir))
    return table.read()


register("sources_table", _stored_senders, samples.senders_sql())

# --- filters -------------------------------------------------------------------------------

_FILTERED = ("source_ip", "remote_host", "ts", "path", "status", "bytes")
_FILTERED_SQL = ", ".join(_FILTERED)


def _filtered(filter: Filter, as_of: datetime | None = None) -> Query:
    as_of = as_of or LONG_AS_OF.get(filter.range, AS_OF)
    return lambda spark, sf_dir: covered(spark, sf_dir, filter, as_of).select(*_FILTERED)


def _filter_sql(
    range_key: str, condition: str = "TRUE", rows: str | None = None, as_of: datetime | None = None
) -> str:
    window = window_sql(range_key, as_of or LONG_AS_OF.get(range_key, AS_OF), rows)
    return f"SELECT {_FILTERED_SQL} FROM ({window}) WHERE {condition}"


for _key in ("1h", "24h", "7d", "30d", "1y"):
    register(f"window_{_key}", _filtered(Filter(range=_key)), _filter_sql(_key))
register("window_default", _filtered(Filter(range="fortnight").normalized()), _filter_sql("24h"))
# As of the middle of the data, a window of 30 days has no row outside.
register(
    "filter_ip",
    _filtered(Filter(ip=" 192.168.2.42 ", range="30d").normalized(), AS_OF),
    _filter_sql("30d", "remote_host = '192.168.2.42'", as_of=AS_OF),
)
register(
    "filter_path",
    _filtered(Filter(path="/click/2", range="30d"), AS_OF),
    _filter_sql("30d", "path = '/click/2'", as_of=AS_OF),
)
for _class in (2, 4, 5, 6):
    register(
        f"filter_status_class_{_class}",
        _filtered(Filter(status=_class, range="30d")),
        _filter_sql("30d", f"CAST(status / 100 AS INTEGER) = {_class}"),
    )
register(
    "filter_stacked",
    _filtered(Filter(range="7d").with_path("/error/11").with_status(5).with_ip("192.168.2.26")),
    _filter_sql(
        "7d",
        "path = '/error/11' AND CAST(status / 100 AS INTEGER) = 5 AND remote_host = '192.168.2.26'",
    ),
)



def _looked_up(**columns: str) -> Query:
    """Over the stored table, whose Bloom filters leave out row groups without the value."""
    filter = Filter(range="1y", **columns)
    return lambda spark, sf_dir: filter.apply(stored_rows(spark, sf_dir), LONG_AS_OF["1y"]).select(*_FILTERED)


register(
    "stored_filter_ip",
    _looked_up(ip="192.168.2.42"),
    _filter_sql("1y", "remote_host = '192.168.2.42'", ingested_sql()),
)
register(
    "stored_filter_path",
    _looked_up(path="/click/2"),
    _filter_sql("1y", "path = '/click/2'", ingested_sql()),
)

# --- reports -------------------------------------------------------------------------------

register(
    "scan_count",
    lambda spark, sf_dir: reports.scan_count(access_rows(spark, sf_dir)),
    f'SELECT CAST(count(*) AS BIGINT) AS "rows" FROM ({access_sql()})',
)

_FIGURES_SQL = (
    "CAST(count(*) AS BIGINT) AS requests, CAST(count(DISTINCT remote_host) AS BIGINT) AS unique_clients,"
    " CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes,"
    " CAST(count(*) FILTER (WHERE status >= 400) AS BIGINT) AS errors"
)
_RATE_SQL = "CASE WHEN requests > 0 THEN errors * 100.0::DOUBLE / requests ELSE 0.0::DOUBLE END"


def _size_sql(count: str) -> str:
    return (
        f"CASE WHEN {count} >= 1099511627776 THEN printf('%.1f TB', {count} / 1099511627776.0::DOUBLE)"
        f" WHEN {count} >= 1073741824 THEN printf('%.1f GB', {count} / 1073741824.0::DOUBLE)"
        f" WHEN {count} >= 1048576 THEN printf('%.1f MB', {count} / 1048576.0::DOUBLE)"
        f" WHEN {count} >= 1024 THEN printf('%.1f KB', {count} / 1024.0::DOUBLE)"
        f" ELSE CAST({count} AS VARCHAR) || ' B' END"
    )


for _key in ("1h", "24h", "7d", "30d", "1y"):
    register(
        f"kpis_{_key}",
        lambda spark, sf_dir, key=_key: reports.key_figures(
            covered(spark, sf_dir, Filter(range=key), LONG_AS_OF.get(key, AS_OF))
        ),
        f"SELECT {_FIGURES_SQL} FROM ({window_sql(_key, LONG_AS_OF.get(_key, AS_OF))})",
    )
register(
    "kpis_empty",
    lambda spark, sf_dir: reports.key_figures(
        covered(spark, sf_dir, Filter(), datetime(2030, 1, 1))
    ),
    f"SELECT {_FIGURES_SQL} FROM ({window_sql('24h', datetime(2030, 1, 1))})",
)


def _sketched_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole hours, so that the exact count of the same rows can be told beside the estimate.
    rows = access_rows(spark, sf_dir).where("ts IS NOT NULL")
    sketches = settled(reports.client_sketches(rows), "sketches")
    days = [("day", "2024-01-15"), ("fortnight", "2024-01-10"), ("all", "1970-01-01")]

    def view(name: str, since: str) -> DataFrame:
        start = f"TIMESTAMP_NTZ'{since} 00:00:00'"
        exact = reports.key_figures(rows.where(f"ts >= {start}")).select("unique_clients")
        about = reports.unique_clients_of(sketches.where(f"hour >= {start}"))
        return exact.crossJoin(about.select(F.col("unique_clients").alias("estimate"))).select(
            F.lit(name).alias("view"),
            "unique_clients",
            (F.abs(F.col("estimate") - F.col("unique_clients")) <= 3 * reports.SKETCH_ERROR * F.col("unique_clients"))
            .alias("within_error"),
        )

    return reduce(DataFrame.unionByName, [view(*day) for day in days])


register(
    "unique_clients_sketched",
    _sketched_clients,
    " UNION ALL ".join(
        f"SELECT '{name}' AS view, CAST(count(DISTINCT remote_host) AS BIGINT) AS unique_clients, TRUE AS within_error"
        f" FROM ({access_sql()}) WHERE ts >= TIMESTAMP '{since}'"
        for name, since in (("day", "2024-01-15"), ("fortnight", "2024-01-10"), ("all", "1970-01-01"))
    ),
)
register(
    "kpi_texts",
    lambda spark, sf_dir: reports.key_figure_texts(
        reports.key_figures(covered(spark, sf_dir, Filter(range="7d")))
    ),
    f"SELECT *, {_RATE_SQL} AS error_rate, printf('%.1f%%', {_RATE_SQL}) AS error_rate_text,"
    f" {_size_sql('total_bytes')} AS total_bytes_text"
    f" FROM (SELECT {_FIGURES_SQL} FROM ({window_sql('7d')}))",
)
register(
    "error_rate",
    lambda spark, sf_dir: access_rows(spark, sf_dir)
    .groupBy("path")
    .agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")
    )
    .select("path", reports.error_rate(F.col("errors"), F.col("requests")).alias("error_rate")),
    f"SELECT path, {_RATE_SQL} AS error_rate FROM (SELECT path, count(*) AS requests,"
    f" count(*) FILTER (WHERE status >= 400) AS errors FROM ({access_sql()}) GROUP BY path)",
)

# Range -> bucket and label, as DuckDB has them.
_BUCKETS_SQL = {
    "1h": ("time_bucket(INTERVAL '5 minutes', ts)", "%H:%M"),
    "24h": ("date_trunc('hour', ts)", "%H:%M"),
    "7d": ("date_trunc('day', ts)", "%m-%d"),
    "30d": ("date_trunc('day', ts)", "%m-%d"),
    "1y": ("date_trunc('month', ts)", "%Y-%m"),
}


def _share_sql(counts: str) -> str:
    return f"SELECT *, CAST(requests * 100 // max(requests) OVER () AS BIGINT) AS pct FROM ({counts})"


def timeline_sql(range_key: str, rows: str) -> str:
    bucket, label = _BUCKETS_SQL[range_key]
    return _share_sql(
        f"SELECT CAST({bucket} AS TIMESTAMP) AS bucket, strftime({bucket}, '{label}') AS label,"
        f" CAST(count(*) AS BIGINT) AS requests FROM ({rows}) GROUP BY {bucket}"
    )


def _timeline(range_key: str) -> Query:
    filter = Filter(range=range_key)
    return lambda spark, sf_dir: reports.timeline(covered(spark, sf_dir, filter), filter.time_range)


for _key in ("1h", "24h", "7d", "30d"):
    register(f"timeline_{_key}", _timeline(_key), timeline_sql(_key, window_sql(_key)))


def _timeline_1y(table: str) -> Query:
    filter = Filter(range="1y")
    return lambda spark, sf_dir: reports.timeline(
        filter.apply(access_rows(spark, sf_dir, table), ORDERS_AS_OF), filter.time_range
    )


for _name, _table in (("timeline_1y", "orders"), ("timeline_1y_lineitem", "lineitem")):
    register(
        _name,
        _timeline_1y(_table),
        timeline_sql("1y", window_sql("1y", ORDERS_AS_OF, access_sql(_table))),
    )


def breakdown_sql(rows: str, klass: str = "CAST(status / 100 AS INTEGER)") -> str:
    return _share_sql(
        f"SELECT {klass} AS class, CAST({klass} AS VARCHAR) || 'xx' AS label,"
        f" CAST(count(*) AS BIGINT) AS requests FROM ({rows}) WHERE status IS NOT NULL GROUP BY 1, 2"
    )


register(
    "status_breakdown",
    lambda spark, sf_dir: reports.status_breakdown(covered(spark, sf_dir, Filter(range="30d"))),
    breakdown_sql(window_sql("30d")),
)
register(
    "status_breakdown_floor",
    lambda spark, sf_dir: reports.status_breakdown(
        covered(spark, sf_dir, Filter(range="30d")), mode="floor"
    ),
    breakdown_sql(window_sql("30d"), "CAST(status // 100 AS INTEGER)"),
)


def top_sql(column: str, rows: str, n: int = 10) -> str:
    return _share_sql(
        f"SELECT {column} AS label, CAST(count(*) AS BIGINT) AS requests FROM ({rows})"
        f" GROUP BY {column} ORDER BY requests DESC, label LIMIT {n}"
    )


for _name, _column in (
    ("top_urls", "path"), ("top_ips", "remote_host"), ("top_user_agents", "user_agent"),
):
    register(
        _name,
        lambda spark, sf_dir, column=_column: reports.top_n(
            covered(spark, sf_dir, Filter(range="30d")), column
        ),
        top_sql(_column, window_sql("30d")),
    )

_RECENT_SQL = (
    "SELECT source_ip, remote_host, auth_user, CAST(ts AS VARCHAR) AS ts, method, path, protocol, status,"
    " bytes, user_agent, CAST(received_at AS VARCHAR) AS received_at FROM (SELECT * FROM ({rows})"
    " ORDER BY received_at DESC, source_ip, raw LIMIT 50)"
)
register(
    "recent",
    lambda spark, sf_dir: reports.recent(access_rows(spark, sf_dir)),
    _RECENT_SQL.format(rows=access_sql()),
)
register(
    "recent_json",
    lambda spark, sf_dir: reports.recent_json(access_rows(spark, sf_dir)),
    "SELECT CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in reports.RECENT_COLUMNS)
    + "}) AS VARCHAR) AS json FROM (" + _RECENT_SQL.format(rows=access_sql()) + ")",
)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access_rows(spark, sf_dir)
    later = Filter().apply(rows, datetime(2030, 1, 1))
    known = Filter(range="30d").apply(rows, AS_OF)
    nothing = rows.where("status < 0")

    def named(name: str, stored: DataFrame, shown: DataFrame) -> DataFrame:
        return reports.report_state(stored, shown).select(F.lit(name).alias("view"), "state")

    return (
        named("thirty days", rows, known)
        .unionAll(named("after the end", rows, later))
        .unionAll(named("empty table", nothing, nothing))
    )


register(
    "report_state",
    _states,
    f"WITH a AS ({access_sql()}), views AS (SELECT 'thirty days' AS view, (SELECT count(*) FROM a) AS n,"
    f" (SELECT count(*) FROM ({window_sql('30d', rows='SELECT * FROM a')})) AS m"
    " UNION ALL SELECT 'after the end', (SELECT count(*) FROM a),"
    f" (SELECT count(*) FROM ({window_sql('24h', datetime(2030, 1, 1), 'SELECT * FROM a')}))"
    " UNION ALL SELECT 'empty table', (SELECT count(*) FROM a WHERE status < 0), 0)"
    " SELECT view, CASE WHEN n = 0 THEN 'no_logs' WHEN m = 0 THEN 'no_match' ELSE 'ok' END AS state FROM views",
)

# --- scalar functions ----------------------------------------------------------------------

register(
    "status_class",
    lambda spark, sf_dir: samples.traffic(spark, sf_dir)
    .selectExpr("id", "CAST(100 + id % 900 AS INT) AS status")
    .select(
        "id", "status",
        status_class(F.col("status")).alias("rounded"),
        status_class(F.col("status"), "floor").alias("floored"),
    ),
    "SELECT id, status, CAST(status / 100 AS INTEGER) AS rounded, CAST(status // 100 AS INTEGER) AS floored"
    f" FROM (SELECT id, CAST(100 + id % 900 AS INTEGER) AS status FROM ({samples.traffic_sql()}))",
)
# Sizes from bytes to beyond the last unit.
_SIZES = "coalesce(bytes, 0) * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 40 WHEN 2 THEN 70000 WHEN 3 THEN 90000000 ELSE 700000000000 END"
register(
    "readable_bytes",
    lambda spark, sf_dir: samples.traffic(spark, sf_dir)
    .selectExpr("id", f"{_SIZES} AS size")
    .select("id", "size", readable_bytes(F.col("size")).alias("text")),
    f"SELECT id, size, {_size_sql('size')} AS text"
    f" FROM (SELECT id, CAST({_SIZES} AS BIGINT) AS size FROM ({samples.traffic_sql()}))",
)
register(
    "one_decimal",
    lambda spark, sf_dir: samples.traffic(spark, sf_dir).select(
        "id",
        "value",
        one_decimal(F.col("value")).alias("text"),
        one_decimal(F.col("id") / F.lit(4.0)).alias("quarters"),
    ),
    "SELECT id, value, printf('%.1f', value) AS text, printf('%.1f', id / 4.0::DOUBLE) AS quarters"
    f" FROM ({samples.traffic_sql()})",
)

# --- dashboard and streaming ---------------------------------------------------------------


def dashboard_sql(range_key: str, rows: str) -> str:
    figures = ", ".join(
        f"('{name}', {name})" for name in ("requests", "unique_clients", "total_bytes", "errors")
    )

    def panel(name: str, key: str, query: str) -> str:
        return (
            f"SELECT '{name}' AS panel, CAST({key} AS VARCHAR) AS key, label, requests, pct FROM ({query})"
        )

    return " UNION ALL ".join(
        [
            "SELECT 'key_figures' AS panel, v.name AS key, v.name AS label, v.amount AS requests,"
            f" CAST(NULL AS BIGINT) AS pct FROM (SELECT {_FIGURES_SQL} FROM ({rows})) f,"
            f" LATERAL (VALUES {figures}) AS v(name, amount)",
            panel("timeline", "bucket", timeline_sql(range_key, rows)),
            panel("statuses", "class", breakdown_sql(rows)),
            panel("top_urls", "label", top_sql("path", rows)),
            panel("top_clients", "label", top_sql("remote_host", rows)),
        ]
    )


register(
    "dashboard_long",
    lambda spark, sf_dir: dashboard_long(stored_rows(spark, sf_dir), Filter(range="7d"), AS_OF),
    dashboard_sql("7d", window_sql("7d", rows=ingested_sql())),
)
register(
    "dashboard_one_pass",
    lambda spark, sf_dir: in_one_frame(
        dashboard_in_one_pass(ingested_rows(spark, sf_dir), Filter(range="7d"), AS_OF)
    ),
    dashboard_sql("7d", window_sql("7d", rows=ingested_sql())),
)
register(
    "dashboard_drilled_down",
    lambda spark, sf_dir: in_one_frame(
        dashboard_in_one_pass(
            access_rows(spark, sf_dir), Filter(range="30d").with_status(5).with_path("/error/3"), AS_OF
        )
    ),
    dashboard_sql(
        "30d",
        f"SELECT * FROM ({window_sql('30d')}) WHERE path = '/error/3' AND CAST(status / 100 AS INTEGER) = 5",
    ),
)
register(
    "stream_ingest",
    lambda spark, sf_dir: streamed_store(spark, sf_dir)
    .read(spark)
    .select(*[f.name for f in Registry.with_defaults().schemas()["apache"].fields]),
    ingested_sql(),
)
register(
    "stream_rejects",
    lambda spark, sf_dir: streamed_store(spark, sf_dir)
    .read_rejects(spark)
    .select("source_ip", "received_at", "raw", "reason"),
    _REJECTS_SQL,
)


def _edited_stream(spark: SparkSession, sf_dir: str) -> LogStore:
    """Two micro-batches with an edit of the senders between them; the second one is run twice.

    Odd ids come after 10.0.0.5 was removed and 10.0.0.7 added.
    """
    folder = shared_folder(spark, "edited")
    traffic = samples.traffic(spark, sf_dir)
    store = LogStore(f"{folder}/store")
    sources = SourceTable(spark, f"{folder}/sources", store.registry.names())
    sources.write(samples.senders(traffic))

    def take_in(turn: int) -> None:
        landed = traffic.where(f"id % 2 = {turn}")
        samples.capture(landed).write.parquet(f"{folder}/capture/{turn}")
        start_ingest(
            stream_capture(spark, f"{folder}/capture/*", ALL_FILES), sources, store,
            checkpoint=f"{folder}/checkpoint", trigger={"availableNow": True},
        ).awaitTermination()

    take_in(0)
    sources.remove("10.0.0.5")
    sources.add("new", "10.0.0.7", "apache")
    take_in(1)
    query_id = store.read_rejects(spark).first()["query_id"]
    pinned = sources.read_for_batch(query_id, 1)
    store.write_batch(read_capture(spark, f"{folder}/capture/1"), pinned, query_id, 1)
    return store


register(
    "stream_with_edit",
    lambda spark, sf_dir: _edited_stream(spark, sf_dir)
    .read(spark)
    .select("batch_id", *[f.name for f in Registry.with_defaults().schemas()["apache"].fields]),
    f"SELECT CAST(id % 2 AS BIGINT) AS batch_id, {ACCESS_COLUMNS} FROM ({samples.traffic_sql()}) WHERE NOT is_bad"
    " AND CASE WHEN id % 2 = 0 THEN peer_ip <= '10.0.0.5' ELSE peer_ip <= '10.0.0.4' OR peer_ip = '10.0.0.7' END",
)


def _stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "live")
    samples.capture(samples.traffic(spark, sf_dir)).write.parquet(f"{folder}/capture")
    rows = parse_messages(to_messages(stream_capture(spark, f"{folder}/capture", 2)), AccessLogType())
    cutoff = Filter(range="1h").cutoff(AS_OF)
    start_live_timeline(
        # Files of the sample cover all times each, so nothing may count as late.
        rows.where(f"ts >= TIMESTAMP_NTZ'{cutoff}'"), f"{folder}/counts", f"{folder}/checkpoint", late="365 days",
        trigger={"availableNow": True},
    ).awaitTermination()
    return reports.show_timeline(read_live_counts(spark, f"{folder}/counts"), Filter(range="1h").time_range)


register("stream_timeline_1h", _stream_timeline, timeline_sql("1h", window_sql("1h")))
register(
    "stored_dashboard",
    lambda spark, sf_dir: in_one_frame(
        streamed_store(spark, sf_dir).dashboard(spark, Filter(range="24h"), AS_OF)
    ),
    dashboard_sql("24h", window_sql("24h", rows=ingested_sql())),
)
register(
    "stored_recent",
    lambda spark, sf_dir: streamed_store(spark, sf_dir).recent(spark),
    _RECENT_SQL.format(rows=ingested_sql()),
)
