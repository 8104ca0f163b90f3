"""Access-log traffic derived from the test tables.

`STEPS` states, once, what each row's request was. The expressions use only SQL that Spark and
DuckDB share, so a check can compute expected columns straight from a table, while Spark
builds the raw syslog line from them and has to get the same columns back by parsing it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# table -> its columns as (id, sent, user_id, kind, value)
BASES = {
    "events": "event_id AS id, ts AS sent, user_id, event_type AS kind, value",
    "orders": (
        "o_orderkey AS id, o_orderdate AS sent, o_custkey AS user_id,"
        " CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'P' THEN 'view' ELSE 'click' END AS kind,"
        " o_totalprice AS value"
    ),
    "lineitem": (
        "l_orderkey * 8 + l_linenumber AS id, l_shipdate AS sent, l_suppkey AS user_id,"
        " CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'view' ELSE 'click' END AS kind,"
        " l_extendedprice AS value"
    ),
}

_MONTHS = "'JanFebMarAprMayJunJulAugSepOctNovDec'"


def _month(stamp: str) -> str:
    return f"substring({_MONTHS}, 3 * CAST(substring({stamp}, 6, 2) AS INT) - 2, 3)"


def _bsd_day(stamp: str) -> str:
    day = f"substring({stamp}, 9, 2)"
    return f"CASE WHEN {day} < '10' THEN ' ' || substring({day}, 2, 1) ELSE {day} END"


def _access_time(stamp: str) -> str:
    return (
        f"substring({stamp}, 9, 2) || '/' || {_month(stamp)} || '/' || substring({stamp}, 1, 4)"
        f" || ':' || substring({stamp}, 12, 8)"
    )


def bsd_stamp(stamp: str) -> str:
    """SQL of a time's text ('2024-01-01 00:06:29') as a BSD stamp."""
    return f"{_month(stamp)} || ' ' || {_bsd_day(stamp)} || ' ' || substring({stamp}, 12, 8)"


# Each step may use the columns of the ones before it. {S} is the engine's text type, {T} its
# timestamp type without a zone.
STEPS: list[dict[str, str]] = [
    {
        "ts0": "CAST(substring(CAST(sent AS {S}), 1, 19) AS {T})",
        "received_at": "sent",
        "peer_ip": "'10.0.0.' || CAST(user_id % 8 AS {S})",
        "hostname": "CASE WHEN id % 3 = 0 THEN NULL ELSE 'web-' || CAST(user_id % 8 AS {S}) END",
        "remote_host": "'192.168.' || CAST(user_id % 4 AS {S}) || '.' || CAST(user_id % 250 AS {S})",
        "ident": "'-'",
        "auth_user": "CASE WHEN id % 5 = 0 THEN 'u' || CAST(user_id AS {S}) ELSE '-' END",
        "path": "CASE WHEN id % 50 = 7 THEN '' ELSE '/' || kind || '/' || CAST(id % 13 AS {S}) END",
        "status": (
            "CASE WHEN id % 40 = 0 THEN NULL WHEN id % 40 = 1 THEN 451 WHEN id % 40 = 2 THEN 499"
            " WHEN id % 40 = 3 THEN 550 WHEN kind = 'error' THEN 500 WHEN kind = 'view' THEN 304"
            " WHEN id % 9 = 0 THEN 404 ELSE 200 END"
        ),
        "bytes": "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END",
        "is_common": "id % 4 = 0",
        "is_bad": "id % 50 = 13",
        "bad_time": "id % 60 = 17",
    },
    {
        "ts": "CASE WHEN bad_time THEN NULL ELSE ts0 END",
        "method": "CASE WHEN path = '' THEN '-' ELSE 'GET' END",
        "protocol": "CASE WHEN path = '' THEN '' ELSE 'HTTP/1.1' END",
        "referer": "CASE WHEN is_common THEN '' ELSE '-' END",
        "user_agent": "CASE WHEN is_common THEN '' ELSE 'agent/' || CAST(id % 4 AS {S}) END",
        "utc_text": "CAST(ts0 AS {S})",
        "west_text": "CAST(ts0 - INTERVAL '7' HOUR AS {S})",
    },
    {
        "time_text": (
            "CASE WHEN bad_time THEN 'no time'"
            f" WHEN id % 2 = 0 THEN {_access_time('west_text')} || ' -0700'"
            f" ELSE {_access_time('utc_text')} || ' +0000' END"
        ),
        "request": "CASE WHEN path = '' THEN '-' ELSE 'GET ' || path || ' HTTP/1.1' END",
    },
    {
        "msg": (
            "CASE WHEN is_bad THEN 'not an access line ' || CAST(id AS {S}) ELSE"
            " remote_host || ' - ' || auth_user || ' [' || time_text || '] \"' || request || '\" '"
            " || coalesce(CAST(status AS {S}), '-') || ' ' || coalesce(CAST(bytes AS {S}), '-')"
            " || CASE WHEN is_common THEN '' ELSE ' \"-\" \"' || user_agent || '\"' END END"
        ),
    },
    {
        "line": (
            "CASE id % 3"
            " WHEN 2 THEN '<134>1 ' || substring(utc_text, 1, 10) || 'T' || substring(utc_text, 12, 8)"
            " || 'Z ' || hostname || ' apache 77 - - ' || msg"
            f" WHEN 1 THEN '<134>' || {_month('utc_text')} || ' ' || {_bsd_day('utc_text')}"
            " || ' ' || substring(utc_text, 12, 8) || ' ' || hostname || ' apache'"
            " || CASE WHEN id % 2 = 0 THEN '[77]' ELSE '' END || ': ' || msg"
            " ELSE msg END"
        ),
    },
]

#: Rows of a table that one task makes lines of at most: seconds to a minute, however large the table is.
ROWS_PER_TASK = 1_000_000

# Senders: 10.0.0.0 to 10.0.0.5 known, 10.0.0.6 of a type nobody registered, 10.0.0.7 unknown.
SENDERS = {f"10.0.0.{n}": "apache" for n in range(6)} | {"10.0.0.6": "mailer"}


@dataclass(frozen=True)
class NoteType:
    """A second log type: the messages that are no access lines, with the number they end in."""

    name: str
    entry_schema: T.StructType = T.StructType(
        [T.StructField("ts", T.TimestampNTZType()), T.StructField("note", T.StringType())]
    )

    def tokens(self, raw: Column) -> Column:
        return F.regexp_extract(raw, r"^not an access line (\d+)$", 1)

    def entry(self, tokens: Column) -> Column:
        return F.when(tokens != "", F.struct(F.lit(None).cast("timestamp_ntz").alias("ts"), tokens.alias("note")))


def _typed(expression: str, text: str, timestamp: str) -> str:
    return expression.replace("{S}", text).replace("{T}", timestamp)


def traffic(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """Every row of the table with the request it stands for and its raw syslog line."""
    rows = _spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_columns(BASES[table])))
    for step in STEPS:
        rows = rows.selectExpr(
            "*", *[f"{_typed(e, 'STRING', 'TIMESTAMP_NTZ')} AS {name}" for name, e in step.items()]
        )
    return rows


def _spread(rows: DataFrame) -> DataFrame:
    """Deal the rows to all cores, ROWS_PER_TASK at most to a task, unless the table's splits do so already.

    Splits are cut by bytes, but a row group goes whole to one of them, and its few bytes are many
    lines. Rows of each split are counted from the files' footers; no column is read for that.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    splits, largest, total = held.agg(F.count("rows"), F.max("rows"), F.sum("rows")).first()
    if splits >= cores and largest <= ROWS_PER_TASK:
        return rows
    return rows.repartition(max(cores, ceil((total or 0) / ROWS_PER_TASK)), "id")


def _columns(base: str) -> list[str]:
    # No column expression of a base holds a comma.
    return [c.strip() for c in base.split(",")]


def traffic_sql(table: str = "events") -> str:
    """The same as `traffic`, as a DuckDB query."""
    query = f"SELECT {BASES[table]} FROM {table}"
    for step in STEPS:
        added = ", ".join(f"{_typed(e, 'VARCHAR', 'TIMESTAMP')} AS {n}" for n, e in step.items())
        query = f"SELECT *, {added} FROM ({query})"
    return query


def capture(rows: DataFrame) -> DataFrame:
    """Traffic as capture rows, one datagram each."""
    return rows.selectExpr("peer_ip", "received_at", "CAST(line AS BINARY) AS payload")


def senders(rows: DataFrame) -> DataFrame:
    """The source table that fits `traffic`: each known sender since its first message."""
    cases = " ".join(f"WHEN '{ip}' THEN '{kind}'" for ip, kind in SENDERS.items())
    return (
        rows.selectExpr("peer_ip AS ip", f"CASE peer_ip {cases} END AS log_type", "received_at")
        .where("log_type IS NOT NULL")
        .groupBy("ip", "log_type")
        .agg({"received_at": "min"})
        .selectExpr("ip", "'web ' || substring(ip, 8) AS name", "log_type", "`min(received_at)` AS created_at")
    )


def senders_sql(table: str = "events") -> str:
    cases = " ".join(f"WHEN '{ip}' THEN '{kind}'" for ip, kind in SENDERS.items())
    return (
        "SELECT ip, 'web ' || substring(ip, 8) AS name, log_type, min(received_at) AS created_at"
        f" FROM (SELECT peer_ip AS ip, CASE peer_ip {cases} END AS log_type, received_at"
        f" FROM ({traffic_sql(table)})) WHERE log_type IS NOT NULL GROUP BY ip, log_type"
    )
