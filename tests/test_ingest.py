from dataclasses import dataclass
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens import Filter, LogStore, Registry, SourceTable, start_ingest
from accesslens.operators import routing
from accesslens.operators.framing import to_messages
from accesslens.operators.reports import recent
from accesslens.operators.panel_counts import count_panels
from accesslens.plans.ingest import accepted, classify, ingest, parse_messages, reject_report, rejected, rejected_as
from accesslens.plans.registry import AccessLogType
from accesslens.sources.capture import read_text_capture, stream_capture, stream_text_capture
from accesslens.sources.log_table import (
    dates_since,
    newest_folders,
    read_folders,
    read_log,
    write_arrivals,
    write_log_batch,
)
from accesslens.streaming.live import read_live_counts, start_live_timeline
from tests.helpers import captures

ACCESS = b'h - - [12/Jun/2026:09:00:00 +0000] "GET /%d HTTP/1.1" 200 1'


@dataclass(frozen=True)
class KeyValueType:
    """A second log type: `time key=value`."""

    name: str = "kv"
    entry_schema: T.StructType = T.StructType(
        [
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("key", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )

    def tokens(self, raw):
        return F.split(F.regexp_replace(raw, r"(?s)^(?:(\S+) (\w+)=)?", "$1 $2 "), " ", 3)

    def entry(self, tokens):
        def at(n):
            return F.get(tokens, F.lit(n))

        return F.when(
            at(0) != "",
            F.struct(
                at(0).try_cast("timestamp_ntz").alias("ts"), at(1).alias("key"), at(2).alias("value")
            ),
        )


def sources(spark, **types):
    """Sources by last byte of 10.0.0.x."""
    rows = [(f"10.0.0.{n[1:]}", n, kind, datetime(2026, 1, 1)) for n, kind in types.items()]
    return spark.createDataFrame(
        rows, "ip STRING, name STRING, log_type STRING, created_at TIMESTAMP_NTZ"
    )


MIXED = [
    ("10.0.0.1", ACCESS % 1),
    ("10.0.0.1", b"no access line"),
    ("10.0.0.2", b"2026-06-12T09:00:00 a=b=c d"),
    ("10.0.0.2", ACCESS % 2),
    ("10.0.0.3", ACCESS % 3),
    ("10.0.0.4", ACCESS % 4),
    ("::ffff:10.0.0.1", ACCESS % 5),
]


def mixed_sources(spark):
    return sources(spark, s1="apache", s2="kv", s3="mailer")


def test_registry():
    registry = Registry.with_defaults()
    assert registry.names() == ["apache"]
    registry.register(KeyValueType())
    assert registry.names() == ["apache", "kv"]
    assert registry.get("kv").name == "kv" and registry.get("none") is None
    assert registry.schemas()["kv"].names == ["source_ip", "ts", "key", "value", "received_at", "raw"]
    assert registry.schemas()["apache"].names[0] == "source_ip"
    assert len(registry.schemas()["apache"]) == 14


def test_dispatch_by_type_and_rejects(spark):
    registry = Registry(AccessLogType(), KeyValueType())
    routed = routing.route(to_messages(captures(spark, MIXED)), mixed_sources(spark))
    rows = classify(routed, registry).cache()
    assert [r["path"] for r in accepted(rows, registry.get("apache")).collect()] == ["/1"]
    kv = accepted(rows, registry.get("kv"))
    assert [tuple(r)[:4] for r in kv.collect()] == [("10.0.0.2", datetime(2026, 6, 12, 9), "a", "b=c d")]
    reasons = {r["raw"]: r["reason"] for r in rejected(rows).collect()}
    assert reasons == {
        "no access line": "unparsed",
        (ACCESS % 2).decode(): "unparsed",
        (ACCESS % 3).decode(): "unknown_type",
        (ACCESS % 4).decode(): "unrouted",
        (ACCESS % 5).decode(): "unrouted",
    }
    assert {r["reason"]: r["messages"] for r in reject_report(rejected(rows)).collect()} == {
        "unparsed": 2, "unknown_type": 1, "unrouted": 2,
    }
    rows.unpersist()


def test_log_type_names_may_hold_any_character(spark):
    named = KeyValueType(name="key-value `v1.2`")
    routed = routing.route(
        to_messages(captures(spark, MIXED)), sources(spark, s1="apache", s2=named.name)
    )
    rows = classify(routed, Registry(named, AccessLogType()))
    assert [r["key"] for r in accepted(rows, named).collect()] == ["a"]
    assert [r["path"] for r in accepted(rows, AccessLogType()).collect()] == ["/1"]
    assert rejected(rows).count() == 5


def test_missing_values_are_rejected_not_lost(spark):
    odd = captures(spark, MIXED[:1]).selectExpr("peer_ip", "received_at", "CAST(NULL AS BINARY) AS payload")
    odd = odd.unionAll(captures(spark, MIXED[:1]).selectExpr("CAST(NULL AS STRING)", "received_at", "payload"))
    for limit in (0, routing.MAX_BROADCAST_BYTES):
        routed = routing.route(to_messages(odd), mixed_sources(spark), max_broadcast_bytes=limit)
        rows = classify(routed, Registry.with_defaults())
        assert sorted(r["reason"] for r in rejected(rows).collect()) == ["unparsed", "unrouted"]
    assert ingest(odd, mixed_sources(spark), AccessLogType()).count() == 0


def test_ingest_one_type(spark):
    got = ingest(captures(spark, MIXED), mixed_sources(spark), AccessLogType())
    assert [r["path"] for r in got.collect()] == ["/1"]
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in Registry.with_defaults().schemas()["apache"]
    ]


def test_parsing_runs_its_expression_once(spark):
    got = ingest(captures(spark, MIXED), mixed_sources(spark), AccessLogType()).where("path = '/1'")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # envelope and line


@pytest.mark.parametrize("reason, passes", [("unparsed", 2), ("unrouted", 1), ("unknown_type", 1), (None, 2)])
def test_rejects_parse_once_or_not_at_all(spark, reason, passes):
    routed = routing.route(to_messages(captures(spark, MIXED)), mixed_sources(spark))
    registry = Registry.with_defaults()
    rows = reject_report(rejected(classify(routed, registry))) if reason is None else rejected_as(routed, registry, reason)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == passes  # one of them opens the envelope
    if reason:
        want = sorted(tuple(r) for r in rejected(classify(routed, registry)).where(F.col("reason") == reason).collect())
        assert sorted(map(tuple, rows.collect())) == want


def hot_messages(spark):
    """A third of all messages from one sender."""
    return spark.range(9_000).selectExpr(
        "IF(id % 3 = 0, '10.0.0.1', concat('10.9.', id % 250, '.', id % 7)) AS source_ip",
        "CAST(NULL AS STRING) AS hostname",
        "timestampadd(SECOND, id, timestamp_ntz'2026-06-12 00:00:00') AS received_at",
        "concat('m', id) AS raw",
    )


def many_sources(spark):
    listed = spark.range(250).selectExpr("concat('10.9.', id, '.', id % 7) AS ip", "'kv' AS log_type")
    return listed.unionAll(spark.range(1).selectExpr("'10.0.0.1' AS ip", "'apache' AS log_type"))


def test_large_routing_table_is_joined_with_salt(spark):
    messages, table = hot_messages(spark), many_sources(spark)
    small = routing.route(messages, table)
    large = routing.route(messages, table, max_broadcast_bytes=100)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, large.select(small.columns).collect()), key=repr)
    assert small.count() == 9_000


def test_only_frequent_senders_are_spread(spark):
    messages, table = hot_messages(spark), many_sources(spark)
    assert routing.frequent_senders(messages) == ["10.0.0.1"]
    assert routing.frequent_senders(messages.limit(0)) == []
    assert len(routing.frequent_senders(messages, one_in=2000)) <= 2000
    large = routing.route(messages, table, max_broadcast_bytes=100)
    assert "CASE WHEN (source_ip#" in (plan := large._jdf.queryExecution().optimizedPlan().toString()) and "explode" in plan
    odd = messages.limit(3).selectExpr("CAST(NULL AS STRING) AS source_ip", "hostname", "received_at", "raw")
    assert routing.route(odd, table, max_broadcast_bytes=0).where("log_type IS NULL").count() == 3


def test_routing_table_size_is_measured(spark):
    routes = routing.routing_table(many_sources(spark))
    assert routing.fits_broadcast(routes)
    assert not routing.fits_broadcast(routes, 251 * 64)
    assert routing.fits_broadcast(routes.where("log_type = 'x'"), 0)


# --- streaming -----------------------------------------------------------------------------


@pytest.fixture
def store(tmp_path):
    return LogStore(str(tmp_path / "store"), Registry(AccessLogType(), KeyValueType()))


@pytest.fixture
def source_table(spark, tmp_path, store):
    table = SourceTable(spark, str(tmp_path / "sources"), store.registry.names())
    table.write(mixed_sources(spark))
    return table


def land(spark, folder, payloads):
    captures(spark, payloads).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, source_table, store, checkpoint="checkpoint", max_files=1, **options):
    query = start_ingest(
        stream_capture(spark, str(tmp_path / "capture"), max_files),
        source_table,
        store,
        str(tmp_path / checkpoint),
        trigger={"availableNow": True},
        **options,
    )
    query.awaitTermination()
    assert query.exception() is None


def paths(spark, store):
    return sorted(r["path"] for r in store.read(spark).collect())


def test_tables_are_empty_before_the_first_batch(spark, store):
    assert store.read(spark).count() == 0
    assert store.read(spark, "kv").count() == 0
    assert store.read_rejects(spark).count() == 0
    assert store.read(spark).schema.names[:14] == store.registry.schemas()["apache"].names


@pytest.mark.parametrize("regroup", [False, True])
def test_stream_equals_batch(spark, tmp_path, source_table, store, regroup):
    payloads = [(f"10.0.0.{n % 5}", ACCESS % n if n % 7 else b"x") for n in range(60)]
    for start in range(0, 60, 20):
        land(spark, tmp_path / "capture", payloads[start : start + 20])
    run(spark, tmp_path, source_table, store, regroup=regroup)
    batch = ingest(captures(spark, payloads), mixed_sources(spark), AccessLogType())
    assert paths(spark, store) == sorted(r["path"] for r in batch.collect())
    assert {r["batch_id"] for r in store.read(spark).collect()} == {0, 1, 2}
    everything = store.read(spark).count() + store.read(spark, "kv").count()
    assert everything + store.read_rejects(spark).count() == 60


def test_source_edits_take_effect_with_the_next_batch(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", [("10.0.0.4", ACCESS % 1)])
    run(spark, tmp_path, source_table, store)
    assert paths(spark, store) == []
    source_table.add("late", "10.0.0.4", "apache")
    land(spark, tmp_path / "capture", [("10.0.0.4", ACCESS % 2)])
    run(spark, tmp_path, source_table, store)
    assert paths(spark, store) == ["/2"]
    source_table.remove(" 10.0.0.4 ")
    land(spark, tmp_path / "capture", [("10.0.0.4", ACCESS % 3)])
    run(spark, tmp_path, source_table, store)
    assert paths(spark, store) == ["/2"]
    assert {r["reason"] for r in store.read_rejects(spark).collect()} == {"unrouted"}


def test_a_repeated_batch_replaces_its_first_attempt(spark, store):
    rows = captures(spark, MIXED)
    for _ in range(2):
        store.write_batch(rows, mixed_sources(spark), "q", 3)
        assert paths(spark, store) == ["/1"]
        assert store.read_rejects(spark).count() == 5
    store.write_batch(rows, mixed_sources(spark), "q", 4)
    assert paths(spark, store) == ["/1", "/1"]


def test_a_batch_keeps_its_routing_when_run_again(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", MIXED)

    @dataclass(frozen=True)
    class FailsHalfway(LogStore):
        def write_batch(self, *arguments):
            super().write_batch(*arguments)
            source_table.remove("10.0.0.1")
            raise RuntimeError("lost after the write")

    failing = FailsHalfway(store.root, store.registry)
    with pytest.raises(Exception, match="lost after the write"):
        run(spark, tmp_path, source_table, failing)
    assert paths(spark, store) == ["/1"]
    land(spark, tmp_path / "capture", MIXED)
    run(spark, tmp_path, source_table, store)
    assert paths(spark, store) == ["/1"]
    assert {(r["batch_id"], r["reason"]) for r in store.read_rejects(spark).where("raw LIKE '%GET /1 %'").collect()} == {
        (1, "unrouted")
    }
    assert store.read_rejects(spark).count() == 5 + 6


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", [("10.0.0.1", ACCESS % 1)])
    run(spark, tmp_path, source_table, store)
    run(spark, tmp_path, source_table, store, checkpoint="other")
    assert paths(spark, store) == ["/1", "/1"]
    assert len({r["query_id"] for r in store.read(spark).collect()}) == 2


def test_a_failed_batch_is_run_again(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", [("10.0.0.1", ACCESS % 1)])

    class Failing:
        def read_for_batch(self, query_id, batch_id):
            raise RuntimeError("no sources today")

    query = start_ingest(
        stream_capture(spark, str(tmp_path / "capture")),
        Failing(),
        store,
        str(tmp_path / "checkpoint"),
        trigger={"availableNow": True},
    )
    with pytest.raises(Exception, match="no sources today"):
        query.awaitTermination()
    run(spark, tmp_path, source_table, store)
    assert paths(spark, store) == ["/1"]


def test_line_framed_stream(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", [("10.0.0.1", ACCESS % 1 + b"\r\n" + ACCESS % 2 + b"\n")])
    run(spark, tmp_path, source_table, store, framing="lines")
    assert paths(spark, store) == ["/1", "/2"]


def test_text_files(spark, tmp_path, source_table, store):
    folder = tmp_path / "text" / "peer_ip=10.0.0.1"
    folder.mkdir(parents=True)
    (folder / "a.log").write_bytes(ACCESS % 1 + b"\r\n" + ACCESS % 2 + b"\xff\n")
    rows = read_text_capture(spark, str(tmp_path / "text"))
    assert rows.where("received_at IS NULL").count() == 0
    assert [r["peer_ip"] for r in rows.collect()] == ["10.0.0.1"] * 2
    query = start_ingest(
        stream_text_capture(spark, str(tmp_path / "text"), 1),
        source_table,
        store,
        str(tmp_path / "checkpoint"),
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    assert paths(spark, store) == ["/1", "/2"]


def test_windows_prune_partitions_and_row_groups(spark, tmp_path, store):
    store.write_batch(captures(spark, MIXED), mixed_sources(spark), "q", 0)
    covered = Filter(range="1h").apply(store.read(spark), datetime(2026, 6, 12, 9, 30)).select("path")
    plan = covered._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "event_date" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "IsNotNull(event_hour)" in scan
    assert "ReadSchema: struct<ts:timestamp_ntz,path:string,event_hour:int>" in scan


def test_a_large_single_date_is_written_by_several_tasks(spark, store):
    rows = spark.range(0, 40_000, 1, 8).selectExpr(
        "'10.0.0.1' AS peer_ip", "timestamp_ntz'2026-06-12 09:30:00' AS received_at",
        """CAST(concat('h - - [12/Jun/2026:09:00:00 +0000] "GET /', uuid(), ' HTTP/1.1" 200 1') AS BINARY)
        AS payload""",
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1MB")
    try:
        store.write_batch(rows, mixed_sources(spark), "q", 0)
    finally:
        spark.conf.set(setting, before)
    stored = store.read(spark)
    assert stored.count() == 40_000
    assert 1 < len(stored.inputFiles()) <= 8


@pytest.mark.parametrize(
    "first", ["2026-06-12", "2026-06-13", "2025-12-31", "2019-09-09", "0999-01-01", "9999-12-31"]
)
def test_dates_since(first):
    import re
    from datetime import timedelta

    glob = dates_since(date.fromisoformat(first))
    pattern = re.compile("|".join(p.replace("+", "[+]").replace("*", ".*") for p in glob[1:-1].split(",")))
    start = date.fromisoformat(first)
    probes = {date(1, 1, 1), date(999, 12, 31), date(2000, 2, 29), date(2026, 6, 9), date(9999, 12, 31)}
    for days in range(-800, 800):
        try:
            probes.add(start + timedelta(days=days))
        except OverflowError:
            pass
    for day in probes:
        assert bool(pattern.fullmatch(day.isoformat())) == (day >= start), day
    assert pattern.fullmatch("+10000-01-01")


def test_reading_since_a_date_lists_later_folders_only(spark, store):
    lines = [
        b'h - - [%02d/Jun/2026:09:00:00 +0000] "GET /%d HTTP/1.1" 200 1' % (day, day)
        for day in (1, 9, 10, 11, 29)
    ]
    store.write_batch(captures(spark, [("10.0.0.1", line) for line in lines]), mixed_sources(spark), "q", 0)
    part = store.read(spark, since=date(2026, 6, 10))
    assert sorted(r["path"] for r in part.collect()) == ["/10", "/11", "/29"]
    assert {f.split("event_date=")[1][:10] for f in part.inputFiles()} == {
        "2026-06-10", "2026-06-11", "2026-06-29",
    }
    assert part.schema == store.read(spark).schema
    assert store.read(spark, since=date(2027, 1, 1)).count() == 0


def test_far_off_clocks_do_not_spoil_the_table(spark, store):
    times = [
        "31/Dec/9999:23:59:59 -2359", "01/Jan/0001:00:00:00 +2359", "01/Jan/0000:00:00:00 +0000",
        "12/Jun/2026:00:00:00 +0000", "01/Jan/99999:00:00:00 +0000",
    ]
    lines = [b'h - - [%s] "GET /%d HTTP/1.1" 200 1' % (t.encode(), n) for n, t in enumerate(times)]
    store.write_batch(captures(spark, [("10.0.0.1", line) for line in lines]), mixed_sources(spark), "q", 0)
    got = {r["path"]: r["ts"] for r in store.read(spark).selectExpr("path", "CAST(ts AS STRING) AS ts").collect()}
    assert got == {
        "/0": "+10000-01-01 23:58:59", "/1": "0000-12-31 00:01:00", "/2": "0000-01-01 00:00:00",
        "/3": "2026-06-12 00:00:00", "/4": None,
    }
    view = store.dashboard(spark, Filter(range="1y"), datetime(2026, 6, 12, 1))
    assert [r["label"] for r in view["timeline"].select("label").collect()] == ["2026-06", "10000-01"]
    assert view["key_figures"].first()["requests"] == 2


def test_dashboard_of_a_store(spark, store):
    as_of = datetime(2026, 6, 12, 10)
    assert store.dashboard(spark, as_of=as_of)["state"].first()["state"] == "no_logs"
    store.write_batch(captures(spark, MIXED), mixed_sources(spark), "q", 0)
    view = store.dashboard(spark, Filter(), as_of)
    assert view["state"].first()["state"] == "ok"
    assert view["key_figures"].first()["requests"] == 1
    later = store.dashboard(spark, Filter(), datetime(2027, 1, 1))
    assert later["state"].first()["state"] == "no_match"
    assert later["key_figures"].first()["requests"] == 0


def test_a_view_scans_its_columns_once(spark, store):
    store.write_batch(captures(spark, MIXED), mixed_sources(spark), "q", 0)
    filter = Filter(range="7d", ip="h")
    covered = filter.apply(store.read(spark), datetime(2026, 6, 12, 10))
    setting = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    plan = count_panels(covered, filter.time_range)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(setting, before)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "Expand" in plan and "partial_count" in plan
    assert "EqualTo(remote_host,h)" in scans[0]
    assert scans[0].split("ReadSchema: struct<")[1].rstrip(">") == (
        "remote_host:string,ts:timestamp_ntz,path:string,status:int,bytes:bigint,event_hour:int"
    )


def opened(frame):
    return {f.split("received_date=")[1] for f in frame.inputFiles()}


def test_latest_rows_open_the_newest_folders_only(spark, store):
    day = [datetime(2026, 6, 10 + n, 9) for n in range(4)]

    def batch(batch_id, times):
        rows = captures(spark, [("10.0.0.1", ACCESS % (100 * batch_id + n)) for n, _ in enumerate(times)])
        stamped = spark.createDataFrame(
            [(r["peer_ip"], t, r["payload"]) for r, t in zip(rows.collect(), times, strict=True)], rows.schema
        )
        store.write_batch(stamped, mixed_sources(spark), "q", batch_id)

    assert store.recent(spark).count() == 0
    batch(0, [day[0]] * 60)
    batch(1, [day[1]] * 3 + [day[0]])
    batch(2, [day[3], day[2]])
    root = store.arrivals_path("apache")
    newest = {n: newest_folders(spark, root, n) for n in (1, 2, 5, 50, 66, 67)}
    assert [len(newest[n] or ()) for n in (1, 2, 5)] == [1, 2, 3] and newest[67] is None
    assert len(newest[66]) == 5 and all("batch_id=2" in f for f in newest[2])
    schema = store.registry.schemas()["apache"]
    picked = read_folders(spark, store.table_path("apache"), schema, newest[5])
    assert {f[:10] for f in opened(picked)} == {"2026-06-11", "2026-06-12", "2026-06-13"}
    for n in (1, 2, 4, 5, 6, 50, 66, 80):
        got, want = store.recent(spark, n=n), recent(store.read(spark).drop("received_date"), n)
        assert got.collect() == want.collect() and got.count() == min(n, 66)
    batch(2, [day[3], day[2]])  # again
    assert store.recent(spark, n=80).count() == 66


def test_folders_that_overlap_in_time_are_all_read(spark, store, tmp_path):
    times = "received_at TIMESTAMP_NTZ, ts TIMESTAMP_NTZ"
    spans = {0: (1, 9), 1: (4, 5), 2: (2, 3), 3: (8, 8)}
    root = str(tmp_path / "arrivals")
    for batch_id, (first, last) in spans.items():
        rows = [(datetime(2026, 6, 12, hour), None) for hour in (first, last)]
        write_arrivals(spark.createDataFrame(rows, times), root, "q", batch_id)
    write_arrivals(spark.createDataFrame([(None, None)], times), root, "q", 9)

    def batches(n):
        return sorted(int(f.rsplit("=")[-1]) for f in newest_folders(spark, root, n))

    assert batches(1) == batches(2) == [0, 3]  # the newest row is in batch 0, which reaches far back
    assert batches(3) == batches(4) == [0, 1, 3]
    assert batches(5) == [0, 1, 2, 3] and batches(9) == [0, 1, 2, 3, 9]


def test_lookups_leave_out_row_groups_without_the_value(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 2).selectExpr(
        "'10.0.0.1' AS source_ip", "concat('10.', id % 250, '.', id div 800, '.', id % 251) AS remote_host",
        "concat('/page/', uuid()) AS path", "timestamp_ntz'2026-06-12 09:00:00' AS ts",
        "timestamp_ntz'2026-06-12 09:00:01' AS received_at",
    )
    schema = T.StructType([rows.schema[name] for name in ("source_ip", "remote_host", "path", "ts", "received_at")])

    def rows_read(root, condition):
        frame = read_log(spark, root, schema).where(condition).select("path")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        metrics = plan.collectLeaves().head().metrics()
        return metrics.apply("numOutputRows").value()

    plain, filtered = str(tmp_path / "plain"), str(tmp_path / "filtered")
    write_log_batch(rows, plain, "q", 0, regroup=False)
    write_log_batch(rows, filtered, "q", 0, regroup=False, lookups=("remote_host", "path"))
    for condition in ("remote_host = '10.100.100.none'", "path = '/page/8'"):
        assert rows_read(plain, condition) == 200_000
        assert rows_read(filtered, condition) == 0
    known = read_log(spark, filtered, schema).first()
    assert rows_read(filtered, f"path = '{known['path']}'") > 0


def test_every_message_of_a_batch_is_accounted_for(spark, tmp_path, source_table, store):
    told = {}
    land(spark, tmp_path / "capture", MIXED)
    land(spark, tmp_path / "capture", MIXED[:2])
    run(spark, tmp_path, source_table, store, report=told.__setitem__)
    assert sorted(c.captured for c in told.values()) == [2, 7]
    whole = next(c for c in told.values() if c.captured == 7)
    assert (whole.stored, whole.unrouted, whole.unknown_type, whole.unparsed) == (2, 2, 1, 2)
    for counts in told.values():
        assert counts.captured == counts.stored + counts.unrouted + counts.unknown_type + counts.unparsed
    stored = store.read(spark).count() + store.read(spark, "kv").count()
    assert stored == sum(c.stored for c in told.values())


def test_live_timeline_counts_late_rows_within_the_watermark(spark, tmp_path, zone):
    zone("Asia/Kathmandu")

    def land_at(*minutes):
        lines = [b'h - - [12/Jun/2026:%02d:%02d:30 +0000] "GET / HTTP/1.1" 200 1' % divmod(m, 60) for m in minutes]
        land(spark, tmp_path / "capture", [("10.0.0.1", line) for line in [*lines, b'h - - [?] "GET / HTTP/1.1" 200 1']])
        rows = parse_messages(to_messages(stream_capture(spark, str(tmp_path / "capture"), 1)), AccessLogType())
        query = start_live_timeline(
            rows, str(tmp_path / "live"), str(tmp_path / "checkpoint"), late="30 minutes", trigger={"availableNow": True}
        )
        query.awaitTermination()

    def counts():
        live = read_live_counts(spark, str(tmp_path / "live")).orderBy("bucket").collect()
        return {r["bucket"].hour * 60 + r["bucket"].minute: r["requests"] for r in live}

    land_at(0, 1, 7, 60)
    assert counts() == {0: 2, 5: 1, 60: 1}
    land_at(58, 61, 62)  # 58 is late, but within half an hour of 60
    assert counts() == {0: 2, 5: 1, 55: 1, 60: 3}
    land_at(2, 120)  # 2 is beyond: its bucket stays as it was
    assert counts() == {0: 2, 5: 1, 55: 1, 60: 3, 120: 1}


def test_a_burst_lands_whole(spark, tmp_path, source_table, store):
    land(spark, tmp_path / "capture", [("10.0.0.1", ACCESS % n) for n in range(500)])
    run(spark, tmp_path, source_table, store)
    assert store.read(spark).count() == 500 and store.read_rejects(spark).count() == 0


def test_rows_without_event_time_are_stored_under_arrival(spark, tmp_path, store):
    line = b'h - - [?] "GET /1 HTTP/1.1" 200 1'
    store.write_batch(captures(spark, [("10.0.0.1", line)]), mixed_sources(spark), "q", 0)
    row = store.read(spark).first()
    assert row["ts"] is None and str(row["event_date"]) == "2026-06-12"
    assert read_log(spark, store.table_path("apache"), store.registry.schemas()["apache"]).count() == 1
