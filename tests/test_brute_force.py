"""Reports against plain Python over random small tables."""

from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from accesslens import Filter, dashboard, dashboard_in_one_pass
from tests.helpers import access_rows

AS_OF = datetime(2026, 3, 1, 12, 0, 0, 500_000)
LENGTHS = {"1h": 3600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000, "1y": 31_536_000}

_hosts = st.sampled_from(["a", "b", "c", "", "é"])
_paths = st.sampled_from(["/", "/x", "/X", "/x?y=1", ""])
_times = st.one_of(
    st.none(),
    st.integers(-3_000, 3_000).map(lambda m: AS_OF + timedelta(minutes=m)),
    st.sampled_from(sorted(LENGTHS)).flatmap(
        lambda k: st.integers(-2, 2).map(lambda s: AS_OF.replace(microsecond=0) - timedelta(seconds=LENGTHS[k] + s))
    ),
)
_rows = st.lists(
    st.tuples(
        _times, _hosts, _paths, st.one_of(st.none(), st.integers(0, 999)),
        st.one_of(st.none(), st.integers(0, 10**12)),
    ),
    min_size=1,
    max_size=60,
)
_filters = st.builds(
    Filter,
    st.one_of(st.none(), _hosts),
    st.one_of(st.none(), _paths),
    st.one_of(st.none(), st.integers(1, 6)),
    st.sampled_from([*LENGTHS, None]),
)


def bucket(time, key):
    if key == "1h":
        return time.replace(minute=time.minute // 5 * 5, second=0, microsecond=0), "%H:%M"
    if key == "24h":
        return time.replace(minute=0, second=0, microsecond=0), "%H:%M"
    day = time.replace(hour=0, minute=0, second=0, microsecond=0)
    return (day.replace(day=1), "%Y-%m") if key == "1y" else (day, "%m-%d")


def shares(counts):
    peak = max((c for *_, c in counts), default=0)
    return [(*row, row[-1] * 100 // peak) for row in counts]


def expected(rows, filter):
    filter = filter.normalized()
    key = filter.range or "24h"
    start = AS_OF.replace(microsecond=0) - timedelta(seconds=LENGTHS[key])
    kept = [
        r for r in rows
        if r[0] is not None and r[0] >= start
        and (filter.ip is None or r[1] == filter.ip)
        and (filter.path is None or r[2] == filter.path)
        and (filter.status is None or (r[3] is not None and round(r[3] / 100) == filter.status))
    ]
    times = sorted(Counter(bucket(r[0], key) for r in kept).items())
    classes = sorted(Counter(round(r[3] / 100) for r in kept if r[3] is not None).items())

    def top(column):
        counts = Counter(r[column] for r in kept).items()
        return shares(sorted(counts, key=lambda item: (-item[1], item[0].encode()))[:10])

    return {
        "state": [("ok" if kept else "no_match",)],
        "key_figures": [
            (
                len(kept),
                len({r[1] for r in kept}),
                sum(r[4] or 0 for r in kept),
                sum(r[3] is not None and r[3] >= 400 for r in kept),
            )
        ],
        "timeline": shares([(t, t.strftime(form), c) for (t, form), c in times]),
        "statuses": shares([(k, f"{k}xx", c) for k, c in classes]),
        "top_urls": top(2),
        "top_clients": top(1),
    }


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(_rows, _filters)
def test_panels(spark, rows, filter):
    frame = access_rows(spark, rows)
    want = expected(rows, filter)
    for panels in (dashboard(frame, filter, AS_OF), dashboard_in_one_pass(frame, filter, AS_OF)):
        for name, panel in panels.items():
            if name == "key_figures":
                panel = panel.select("requests", "unique_clients", "total_bytes", "errors")
            assert [tuple(r) for r in panel.collect()] == want[name], name
