import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accesslens import Filter, dashboard, dashboard_in_one_pass
from accesslens.catalogue import AS_OF, access_rows as events_rows
from accesslens.functions.status import in_status_class, status_class
from accesslens.functions.text import one_decimal, readable_bytes, trim_whitespace
from accesslens.functions.times import (
    bucket_5_minutes,
    bucket_day,
    bucket_hour,
    bucket_month,
    label_hour_minute,
    label_month_day,
    label_year_month,
)
from accesslens.operators import panel_counts, reports
from accesslens.operators.filters import RANGES
from accesslens.sources.log_table import with_pruning_columns
from tests.helpers import access_rows, parse

T0 = datetime(2026, 6, 12, 9)


def plain(frame):
    return [tuple(r) for r in frame.collect()]


def one(spark, value, kind, function):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "status, rounded, floored",
    [
        (199, 2, 1), (200, 2, 2), (249, 2, 2), (250, 2, 2), (251, 3, 2), (350, 4, 3), (404, 4, 4),
        (450, 4, 4), (451, 5, 4), (499, 5, 4), (500, 5, 5), (550, 6, 5), (999, 10, 9), (0, 0, 0),
    ],
)
def test_status_class(spark, status, rounded, floored):
    assert one(spark, status, "INT", status_class) == rounded
    assert one(spark, status, "INT", lambda c: status_class(c, "floor")) == floored


@pytest.mark.parametrize(
    "number, text",
    [(0.25, "0.2"), (0.35, "0.3"), (0.75, "0.8"), (6.35, "6.3"), (0.05, "0.1"), (100.0, "100.0"),
     (1234.56, "1234.6"), (0.0, "0.0"), (12.5, "12.5")],
)
def test_one_decimal(spark, number, text):
    assert one(spark, number, "DOUBLE", one_decimal) == text == f"{number:.1f}"


@pytest.mark.parametrize(
    "count, text",
    [
        (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048575, "1024.0 KB"),
        (1048576, "1.0 MB"), (5 * 2**30, "5.0 GB"), (2**40, "1.0 TB"), (3 * 2**50, "3072.0 TB"),
    ],
)
def test_readable_bytes(spark, count, text):
    assert one(spark, count, "BIGINT", readable_bytes) == text


def test_trim(spark):
    assert one(spark, " \u3000\t a b\n ", "STRING", trim_whitespace) == "a b"


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "time", [datetime(2024, 3, 10, 2, 33, 7, 5), datetime(1969, 12, 31, 23, 59, 59), datetime(2000, 2, 29)]
)
def test_buckets_and_labels_ignore_the_session_zone(spark, zone, session_zone, time):
    zone(session_zone)
    hour = time.replace(minute=0, second=0, microsecond=0)
    expected = {
        bucket_5_minutes: hour + timedelta(minutes=time.minute // 5 * 5),
        bucket_hour: hour,
        bucket_day: hour.replace(hour=0),
        bucket_month: hour.replace(hour=0, day=1),
        label_hour_minute: time.strftime("%H:%M"),
        label_month_day: time.strftime("%m-%d"),
        label_year_month: time.strftime("%Y-%m"),
    }
    for function, value in expected.items():
        assert one(spark, time, "TIMESTAMP_NTZ", function) == value


def test_key_figures(spark):
    rows = access_rows(
        spark,
        [(T0, "a", "/", 200, 10), (T0, "a", "/", 399, None), (T0, "b", "/", 400, 5), (T0, "c", "/", None, 1)],
    )
    assert plain(reports.key_figures(rows)) == [(4, 3, 16, 1)]
    assert plain(reports.key_figures(rows, approximate_clients=True)) == [(4, 3, 16, 1)]
    assert plain(reports.key_figure_texts(reports.key_figures(rows)))[0][4:] == (25.0, "25.0%", "16 B")
    nothing = rows.where("status < 0")
    assert plain(reports.key_figures(nothing)) == [(0, 0, 0, 0)]
    assert plain(reports.key_figure_texts(reports.key_figures(nothing)))[0][4:] == (0.0, "0.0%", "0 B")


def test_timeline_keeps_equal_labels_apart(spark):
    rows = access_rows(spark, [(T0, "a", "/", 200, 1)] * 3 + [(T0 + timedelta(hours=24), "a", "/", 200, 1)])
    assert plain(reports.timeline(rows, RANGES["24h"])) == [
        (T0, "09:00", 3, 100),
        (T0 + timedelta(hours=24), "09:00", 1, 33),
    ]
    assert plain(reports.timeline(rows.where("status < 0"), RANGES["1h"])) == []


def test_timeline_peak_reuses_the_shuffle(spark):
    rows = access_rows(spark, [(T0 + timedelta(minutes=n), "a", "/", 200, 1) for n in range(300)])
    frame = reports.timeline(rows, RANGES["1h"])
    frame.collect()
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


def test_statuses(spark):
    rows = access_rows(
        spark, [(T0, "a", "/", s, 1) for s in (200, 204, 301, 404, 451, 499, 500, 550, None, None)]
    )
    assert plain(reports.status_breakdown(rows)) == [
        (2, "2xx", 2, 66), (3, "3xx", 1, 33), (4, "4xx", 1, 33), (5, "5xx", 3, 100), (6, "6xx", 1, 33),
    ]
    assert plain(reports.status_breakdown(rows, mode="floor")) == [
        (2, "2xx", 2, 66), (3, "3xx", 1, 33), (4, "4xx", 3, 100), (5, "5xx", 2, 66),
    ]


def test_top_n_ties_go_by_bytes_of_the_value(spark):
    paths = ["/b", "/a", "/Z", "/é", "", "/b"] + [f"/p{n:02d}" for n in range(9)]
    rows = access_rows(spark, [(T0, "a", p, 200, 1) for p in paths])
    want = sorted(Counter(paths).items(), key=lambda item: (-item[1], item[0].encode()))
    got = plain(reports.top_urls(rows))
    assert [(label, count) for label, count, _ in got] == want[:10]
    assert [pct for _, _, pct in got] == [100] + [50] * 9
    assert len(plain(reports.top_n(rows, "path", n=3))) == 3
    assert plain(reports.top_clients(rows)) == [("a", 15, 100)]


def test_a_hot_key_reaches_the_shuffle_pre_aggregated(spark):
    frame = spark.range(30_000).selectExpr("IF(id % 3 = 0, '/hot', concat('/', id)) AS path")
    result = reports.top_urls(frame)
    assert plain(result)[0] == ("/hot", 10_000, 100)
    assert "partial_count" in result._jdf.queryExecution().executedPlan().toString()


def recent_input(spark, n):
    frame = spark.range(n).selectExpr(
        "id", "timestampadd(SECOND, id * 1000, timestamp_ntz'2026-06-12 00:00:00') AS received_at"
    )
    return frame.selectExpr(
        "concat('10.0.0.', id % 3) AS source_ip", "'h' AS remote_host", "'-' AS auth_user",
        "IF(id % 2 = 0, received_at, NULL) AS ts", "'GET' AS method", "'/' AS path", "'P' AS protocol",
        "200 AS status", "CAST(NULL AS BIGINT) AS bytes", "'ua' AS user_agent", "received_at",
        "CAST(id AS STRING) AS raw",
    )


@pytest.mark.parametrize("n", [0, 7, 300])
def test_recent(spark, n):
    rows = recent_input(spark, n)
    stored = with_pruning_columns(rows)
    got = plain(reports.recent(rows))
    assert got == plain(reports.recent(stored))
    assert len(got) == min(n, 50)
    assert [r[-1] for r in got] == sorted((r[-1] for r in got), reverse=True)
    if n:
        newest = json.loads(reports.recent_json(rows).first()["json"])
        assert tuple(newest) == reports.RECENT_COLUMNS
        assert newest["bytes"] is None
        assert newest["received_at"] == got[0][-1]


def test_states(spark):
    rows = access_rows(spark, [(T0, "a", "/", 200, 1)])
    nothing = rows.where("status < 0")
    assert plain(reports.report_state(rows, rows)) == [("ok",)]
    assert plain(reports.report_state(rows, nothing)) == [("no_match",)]
    assert plain(reports.report_state(nothing, nothing)) == [("no_logs",)]


@pytest.mark.parametrize(
    "filter",
    [Filter(range=key) for key in RANGES]
    + [Filter(range="30d", status=5), Filter(path="/view/1", range="30d"), Filter(ip="nobody")],
)
def test_one_pass_equals_panel_by_panel(spark, sf_dir, filter):
    rows = events_rows(spark, sf_dir)
    apart, together = dashboard(rows, filter, AS_OF), dashboard_in_one_pass(rows, filter, AS_OF)
    assert list(apart) == list(together)
    for panel in apart:
        assert plain(apart[panel]) == plain(together[panel]), panel
        assert apart[panel].dtypes == together[panel].dtypes, panel


def test_a_view_writes_what_its_panels_show(spark, tmp_path):
    """Totals and the first paths and clients; the rows are read once, whatever is taken from them."""
    rows = spark.range(0, 5_000, 1, 4).selectExpr(
        "timestampadd(MINUTE, id % 50, timestamp_ntz'2026-06-12 09:00:00') AS ts", "concat('c', id % 700) AS remote_host",
        "IF(id = 0, NULL, concat('/', id)) AS path", "CAST(200 + 100 * (id % 3) AS INT) AS status", "id AS bytes",
    )
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    bounded = panel_counts.bounded_counts(panel_counts.count_panels(rows, RANGES["1h"]), 10)
    assert bounded.count() == 10 * 3 + 2 + 10 * 3  # buckets by classes, all paths, all clients; three aspects' first
    bounded.collect()
    plan = bounded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    folder = str(tmp_path / "counts")
    view = dashboard_in_one_pass(rows, Filter(range="1h"), datetime(2026, 6, 12, 9, 30), folder)
    assert spark.read.parquet(folder).count() <= 62
    assert view["key_figures"].first()["unique_clients"] == 700
    apart = dashboard(rows, Filter(range="1h"), datetime(2026, 6, 12, 9, 30))
    for panel in apart:
        assert plain(apart[panel]) == plain(view[panel]), panel


def test_sketches_count_clients_about(spark):
    rows = spark.range(60_000).selectExpr(
        "timestampadd(MINUTE, id % 300, timestamp_ntz'2026-06-12 09:00:00') AS ts", "concat('c', id % 50000) AS remote_host"
    )
    sketches = reports.client_sketches(rows)
    assert sketches.count() == 5
    whole = reports.unique_clients_of(sketches).first()[0]
    assert abs(whole - 50_000) < 3 * reports.SKETCH_ERROR * 50_000
    hour = reports.unique_clients_of(sketches.where("hour = TIMESTAMP_NTZ'2026-06-12 10:00:00'")).first()[0]
    exact = rows.where("hour(ts) = 10").select("remote_host").distinct().count()
    assert abs(hour - exact) < 3 * reports.SKETCH_ERROR * exact
    assert reports.unique_clients_of(sketches.limit(0)).first()[0] == 0


@pytest.mark.parametrize("view", [dashboard, dashboard_in_one_pass])
def test_views_of_true_classes(spark, view):
    rows = access_rows(spark, [(T0, "a", "/", s, 1) for s in (404, 451, 499, 500, 550)])
    panels = view(rows, Filter(status=4), T0, status_mode="floor")
    assert plain(panels["statuses"]) == [(4, "4xx", 3, 100)]
    assert plain(view(rows, Filter(status=4), T0)["statuses"]) == [(4, "4xx", 1, 100)]


def test_breakdown_adds_up(spark, sf_dir):
    rows = Filter(range="1y").apply(events_rows(spark, sf_dir), AS_OF)
    total = sum(r["requests"] for r in reports.status_breakdown(rows).collect())
    assert total == rows.where("status IS NOT NULL").count()
    assert sum(r["requests"] for r in reports.timeline(rows, RANGES["1y"]).collect()) == rows.count()


def test_pinned_figures(spark):
    rows = events_rows(spark, "/root/testdata/sf0.01").cache()
    pinned = {
        "1h": (4993, 150, 22453699, 1576),
        "24h": (5290, 150, 24002559, 1674),
        "7d": (7219, 150, 32735720, 2277),
        "30d": (9633, 150, 43488856, 3024),
    }
    for key, figures in pinned.items():
        assert plain(reports.key_figures(Filter(range=key).apply(rows, AS_OF))) == [figures]
    rows.unpersist()


def test_rows_without_a_time_count_only_outside_windows(spark):
    text = 'h - - [no time] "GET / HTTP/1.1" 200 1'
    row = parse(spark, text)[text]
    assert row["ts"] is None and row["status"] == 200


@pytest.mark.parametrize("mode", ["rounded", "floor"])
def test_status_class_as_a_range(spark, mode):
    codes = spark.range(-60, 1000).select(F.col("id").cast("int").alias("status"))
    for klass in range(0, 10):
        same = in_status_class(F.col("status"), klass, mode) == (status_class(F.col("status"), mode) == klass)
        assert codes.where(~same).count() == 0
