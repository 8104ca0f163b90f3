import json

import pytest

from accesslens.__main__ import arguments, run
from tests.helpers import captures

LINE = b'<134>Jun 12 09:00:00 web apache: h - - [12/Jun/2026:09:00:00 +0000] "GET /a HTTP/1.1" 404 1'


def job(spark, store, *words):
    run(spark, arguments(["--store", str(store), *map(str, words)]))


def test_from_source_to_report(spark, tmp_path, capsys):
    store, landing = tmp_path / "store", tmp_path / "landing"
    captures(spark, [("10.0.0.1", LINE), ("10.0.0.2", LINE)]).write.parquet(str(landing))
    job(spark, store, "add-source", "web one", "10.0.0.1", "apache")
    job(spark, store, "sources")
    assert "web one" in capsys.readouterr().out
    job(spark, store, "ingest", landing, "--once", "--max-per-batch", 1)
    job(spark, store, "recent")
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [(r["source_ip"], r["path"], r["status"]) for r in rows] == [("10.0.0.1", "/a", 404)]
    job(spark, store, "dashboard", "--range", "7d", "--status", 4, "--as-of", "2026-06-13T00:00:00")
    shown = capsys.readouterr().out
    assert "timeline (last 7 days)" in shown and "100.0%" in shown and "/a" in shown
    job(spark, store, "remove-source", "10.0.0.1")
    job(spark, store, "sources")
    assert "web one" not in capsys.readouterr().out


def test_wrong_source(spark, tmp_path):
    with pytest.raises(ValueError, match="no parser"):
        job(spark, tmp_path, "add-source", "n", "10.0.0.1", "mailer")


def test_every_row_is_printed(spark, capsys):
    from accesslens.__main__ import _print

    _print(spark.range(10_500))
    assert capsys.readouterr().out.split() == ["id", *map(str, range(10_500))]
