import time
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from accesslens.functions.access_line import MONTHS
from tests.helpers import parse, parse_one


def line(time="12/Jun/2026:09:00:00 +0000", request="GET /x HTTP/1.1", tail="200 42", host="h"):
    return f'{host} - - [{time}] "{request}" {tail}'


def test_combined_line(spark):
    row = parse_one(
        spark,
        '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326'
        ' "http://www.example.com/start.html" "Mozilla/4.08 [en] (Win98; I ;Nav)"',
    )
    assert row["remote_host"] == "127.0.0.1"
    assert (row["ident"], row["auth_user"]) == ("-", "frank")
    assert (row["method"], row["path"], row["protocol"]) == ("GET", "/apache_pb.gif", "HTTP/1.0")
    assert (row["status"], row["bytes"]) == (200, 2326)
    assert row["referer"] == "http://www.example.com/start.html"
    assert row["user_agent"] == "Mozilla/4.08 [en] (Win98; I ;Nav)"
    assert row["ts"] == datetime(2000, 10, 10, 20, 55, 36)
    assert row["source_ip"] == "10.0.0.1"


def test_a_line_without_referer_and_agent(spark):
    row = parse_one(spark, 'intranet.example staff ana [29/Feb/2024:23:30:00 -0130] "HEAD /docs/a%20b.pdf HTTP/2.0" 206 0')
    want = {
        "remote_host": "intranet.example", "ident": "staff", "auth_user": "ana", "method": "HEAD", "path": "/docs/a%20b.pdf",
        "protocol": "HTTP/2.0", "status": 206, "bytes": 0, "referer": "", "user_agent": "", "ts": datetime(2024, 3, 1, 1),
    }
    assert {name: row[name] for name in want} == want


def test_what_a_dash_stands_for(spark):
    """No size is NULL; a user, referer or agent that is a dash stays one."""
    row = parse_one(spark, line(request="DELETE /cart/7 HTTP/1.1", tail='503 - "-" "-"', host="2001:db8::9"))
    assert row["bytes"] is None and row["status"] == 503 and row["remote_host"] == "2001:db8::9"
    assert {row[name] for name in ("ident", "auth_user", "referer", "user_agent")} == {"-"}


@pytest.mark.parametrize(
    "text",
    [
        "this is not an apache log line",
        "",
        " ",
        '" " " " " " " " " " " " " " " " " " " ',
        line(request='GET /a"b HTTP/1.1'),
        line(tail="20 42"),
        line(tail="2000 42"),
        line(tail="200 x"),
        line(tail="200"),
        line(host="two words"),
        "h  - - [12/Jun/2026:09:00:00 +0000] \"GET / HTTP/1.1\" 200 1",
        "h - - [] \"GET / HTTP/1.1\" 200 1",
    ],
)
def test_no_access_line(spark, text):
    assert parse_one(spark, text) is None


@pytest.mark.parametrize(
    "request_text, expected",
    [
        ("-", ("-", "", "")),
        ("", ("", "", "")),
        ("GET", ("GET", "", "")),
        ("GET /a", ("GET", "/a", "")),
        ("GET /a HTTP/1.1 and more", ("GET", "/a", "HTTP/1.1 and more")),
        ("GET  HTTP/1.1", ("GET", "", "HTTP/1.1")),
        (" GET /a", ("", "GET", "/a")),
        ("GET /ä?x=1&y=\u0001 HTTP/2", ("GET", "/ä?x=1&y=\u0001", "HTTP/2")),
    ],
)
def test_request_parts(spark, request_text, expected):
    row = parse_one(spark, line(request=request_text))
    assert (row["method"], row["path"], row["protocol"]) == expected


@pytest.mark.parametrize(
    "time, expected",
    [
        ("12/Jun/2026:09:00:00 +0530", datetime(2026, 6, 12, 3, 30)),
        ("12/Jun/2026:09:00:00 +05:30", datetime(2026, 6, 12, 3, 30)),
        ("12/Jun/2026:09:00:00 -0030", datetime(2026, 6, 12, 9, 30)),
        ("2/jun/2026:9:5:3 +0000", datetime(2026, 6, 2, 9, 5, 3)),
        ("31/Dec/2025:23:59:60 +0000", datetime(2026, 1, 1)),
        ("29/Feb/2024:00:00:00 +0000", datetime(2024, 2, 29)),
        ("10/Mar/2024:02:30:00 +0000", datetime(2024, 3, 10, 2, 30)),
        ("29/Feb/2023:00:00:00 +0000", None),
        ("12/Jun/2026:24:00:00 +0000", None),
        ("12/Jun/2026:09:60:00 +0000", None),
        ("12/Jun/2026:09:00:61 +0000", None),
        ("12/Jun/2026:09:00:00 +2400", None),
        ("12/Jun/2026:09:00:00 +0060", None),
        ("12/Jun/2026:09:00:00", None),
        ("12/anf/2026:09:00:00 +0000", None),
        ("12/06/2026:09:00:00 +0000", None),
        ("12/Jun/2026:09:00:00 +0000 x", None),
        ("no time", None),
        ("-", None),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_time(spark, zone, session_zone, time, expected):
    zone(session_zone)
    assert parse_one(spark, line(time=time))["ts"] == expected


def test_numbers(spark):
    rows = parse(
        spark,
        line(tail="- -", host="a"),
        line(tail="200 " + "9" * 20, host="b"),
        line(tail="200 9223372036854775807", host="c"),
        line(tail="٢٠٠ ٤٢", host="d"),
    )
    got = {r["remote_host"]: (r["status"], r["bytes"]) for r in rows.values()}
    assert got == {
        "a": (None, None),
        "b": (200, None),
        "c": (200, 9223372036854775807),
        "d": (None, None),
    }


@pytest.mark.parametrize(
    "tail, expected",
    [
        ('200 1 "ref" "ua" extra "fields"', ("ref", "ua")),
        ('200 1 "ref" "ua', ("", "")),
        ('200 1 "ref', ("", "")),
        ('200 1 "" ""', ("", "")),
        ('200 1 "r" "say \\"hi\\""', ("r", "say \\")),
        ('200 1  "ref" "ua"', ("", "")),
        ('200 1 " a " " b "', (" a ", " b ")),
    ],
)
def test_optional_tail(spark, tail, expected):
    row = parse_one(spark, line(tail=tail))
    assert (row["referer"], row["user_agent"]) == expected


def test_white_space_around_the_line_and_raw_kept(spark):
    text = " \t\u00a0" + line(tail='200 1 "r" "u"') + "\u3000\n"
    row = parse_one(spark, text)
    assert (row["remote_host"], row["user_agent"], row["raw"]) == ("h", "u", text)


def test_separators_inside_fields(spark):
    row = parse_one(spark, '"h" i"" "u [12/Jun/2026:09:00:00 +0000] "- \u0001 x" 200 1 "" "\u0001"')
    assert (row["remote_host"], row["ident"], row["auth_user"]) == ('"h"', 'i""', '"u')
    assert (row["method"], row["path"], row["protocol"]) == ("-", "\u0001", "x")
    assert (row["referer"], row["user_agent"]) == ("", "\u0001")


def test_unicode_space_parts_no_fields(spark):
    assert parse_one(spark, line(host="a\u2003b")) is None


@pytest.mark.parametrize("filler", ["a", " ", "a ", "[", "]", '"', '" ', "1", "-", "\\", "/", ":", "[1/Jan/", '"a'])
@pytest.mark.parametrize("start", ["", "h - - ", "h - - [", 'h - - [x] "', 'h - - [x] "r" 200 1 "'])
def test_long_hostile_lines_take_linear_time(spark, start, filler):
    begin = time.monotonic()
    parse_one(spark, start + filler * (64_000 // len(filler)))
    assert time.monotonic() - begin < 5


def test_long_lines(spark):
    path = "/" + "a" * 64_000
    row = parse_one(spark, line(request=f"GET {path} HTTP/1.1", tail='200 1 "r" "' + "u" * 64_000 + '"'))
    assert row["path"] == path and len(row["user_agent"]) == 64_000
    assert parse_one(spark, "x " * 32_000) is None


_word = st.text(
    st.characters(codec="utf-8", exclude_categories=("Z", "Cc", "Cs")), min_size=1, max_size=8
)
_quoted = st.text(st.characters(codec="utf-8", exclude_characters='"', exclude_categories=("Cs",)), max_size=12)
_request = st.builds(
    lambda words: " ".join(words), st.lists(_quoted.map(lambda t: t.replace(" ", "")), min_size=1, max_size=3)
)


@st.composite
def _lines(draw):
    host, ident, user = draw(_word), draw(_word), draw(_word)
    local = draw(st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1))).replace(microsecond=0)
    offset = draw(st.integers(-23 * 60 - 59, 23 * 60 + 59))
    sign, minutes = ("-" if offset < 0 else "+"), abs(offset)
    request = draw(_request)
    status = draw(st.one_of(st.none(), st.integers(100, 999)))
    size = draw(st.one_of(st.none(), st.integers(0, 2**63 - 1)))
    tail = draw(st.one_of(st.none(), st.tuples(_quoted, _quoted)))
    text = (
        f"{host} {ident} {user} [{local.day:02d}/{MONTHS[local.month - 1]}/{local.year}:{local:%H:%M:%S}"
        f" {sign}{minutes // 60:02d}{minutes % 60:02d}]"
        f' "{request}" {"-" if status is None else status} {"-" if size is None else size}'
    )
    if tail is not None:
        text += f' "{tail[0]}" "{tail[1]}"'
    words = request.split(" ", 2) + ["", ""]
    expected = (
        host, ident, user, local - timedelta(minutes=offset), *words[:3], status, size, *(tail or ("", "")),
    )
    return text, expected


_FIELDS = (
    "remote_host", "ident", "auth_user", "ts", "method", "path", "protocol", "status", "bytes", "referer",
    "user_agent",
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_lines(), min_size=40, max_size=80))
def test_formatted_fields_come_back(spark, cases):
    rows = parse(spark, *{text for text, _ in cases})
    for text, expected in cases:
        assert tuple(rows[text][f] for f in _FIELDS) == expected
