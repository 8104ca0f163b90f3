from datetime import UTC, datetime, timedelta

import pytest

from accesslens import Filter
from accesslens.operators.filters import RANGES
from accesslens.sources.log_table import with_pruning_columns
from tests.helpers import access_rows

AS_OF = datetime(2026, 6, 12, 9, 30, 15, 999_999)


def test_normalized():
    assert Filter(" 1.2.3.4\t", "\u3000 ", 4, "7d ").normalized() == Filter("1.2.3.4", None, 4, "7d")
    assert Filter("", "", None, "2w").normalized() == Filter()
    assert Filter(path="\x1c").normalized().path == "\x1c"


def test_edits_keep_the_rest():
    full = Filter().with_ip("a").with_path("/p").with_status(5).with_range("30d")
    assert full == Filter("a", "/p", 5, "30d")
    assert full.without_ip() == Filter(None, "/p", 5, "30d")
    assert full.without_path() == Filter("a", None, 5, "30d")
    assert full.without_status() == Filter("a", "/p", None, "30d")


@pytest.mark.parametrize(
    "key, length, label",
    [
        ("1h", timedelta(hours=1), "last hour"),
        ("24h", timedelta(hours=24), "last 24 hours"),
        ("7d", timedelta(days=7), "last 7 days"),
        ("30d", timedelta(days=30), "last 30 days"),
        ("1y", timedelta(days=365), "last year"),
    ],
)
def test_ranges(key, length, label):
    filter = Filter(range=key)
    assert filter.range_label == label
    start = AS_OF.replace(microsecond=0) - length
    assert filter.cutoff(AS_OF) == start.strftime("%Y-%m-%d %H:%M:%S")


def test_default_range_and_now():
    assert Filter().range_label == Filter(range="nope").range_label == "last 24 hours"
    start = datetime.strptime(Filter().cutoff(), "%Y-%m-%d %H:%M:%S")
    assert abs(datetime.now(UTC).replace(tzinfo=None) - timedelta(hours=24) - start) < timedelta(minutes=1)
    assert set(RANGES) == {"1h", "24h", "7d", "30d", "1y"}


ROWS = [
    (datetime(2026, 6, 12, 8, 30, 15), "a", "/x", 200, 1),
    (datetime(2026, 6, 12, 8, 30, 14, 999_999), "a", "/x", 200, 2),
    (datetime(2027, 1, 1), "b", "/X", 450, 3),
    (datetime(2026, 6, 12, 9), "b", "/x?y", 451, 4),
    (datetime(2026, 6, 12, 9), "", "", None, 5),
    (None, "a", "/x", 200, 6),
]


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Kolkata"])
@pytest.mark.parametrize(
    "filter, kept",
    [
        (Filter(range="1h"), {1, 3, 4, 5}),
        (Filter(), {1, 2, 3, 4, 5}),
        (Filter(ip="a"), {1, 2}),
        (Filter(path="/x"), {1, 2}),
        (Filter(status=4), {3}),
        (Filter(status=5), {4}),
        (Filter(ip="b", status=5, range="7d"), {4}),
        (Filter(ip="b", path="/x"), set()),
        (Filter(ip="a' OR '1'='1"), set()),
    ],
)
def test_rows_kept(spark, zone, session_zone, filter, kept):
    zone(session_zone)
    rows = access_rows(spark, ROWS)
    assert {r["bytes"] for r in filter.apply(rows, AS_OF).collect()} == kept
    assert {r["bytes"] for r in rows.where(filter.condition(AS_OF)).collect()} == kept
    stored = with_pruning_columns(rows.selectExpr("*", "timestamp_ntz'2020-01-01 00:00:00' AS received_at"))
    assert {r["bytes"] for r in filter.apply(stored, AS_OF).collect()} == kept


def test_floor_mode_counts_true_classes(spark):
    rows = access_rows(spark, ROWS)
    kept = Filter(status=4).apply(rows, AS_OF, status_mode="floor").collect()
    assert {r["bytes"] for r in kept} == {3, 4}
