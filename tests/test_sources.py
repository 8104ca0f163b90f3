import threading
from datetime import datetime

import pytest

from accesslens import SourceTable
from accesslens.operators.source_changes import (
    check_changes,
    count_sources,
    delete_sources,
    list_sources,
    upsert_sources,
)
from accesslens.sources.files import Folder
from accesslens.sources.source_table import ConcurrentEdit

DAY = [datetime(2026, 6, d) for d in range(1, 10)]


def table(spark, *rows):
    return spark.createDataFrame(
        list(rows), "ip STRING, name STRING, log_type STRING, created_at TIMESTAMP_NTZ"
    )


def changes(spark, *rows):
    return spark.createDataFrame(
        list(rows), "ip STRING, name STRING, log_type STRING, requested_at TIMESTAMP_NTZ, seq BIGINT"
    )


def sorted_rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_upsert(spark):
    old = table(spark, ("a", "A", "t", DAY[3]), ("b", "B", "t", DAY[4]))
    new = changes(
        spark,
        ("b", "B1", "u", DAY[0], 1),
        ("b", "B3", "t", DAY[1], 3),
        ("b", "B2", "u", DAY[1], 2),
        ("c", "C2", "u", DAY[6], 1),
        ("c", "C1", "t", DAY[5], 2),
    )
    assert sorted_rows(upsert_sources(old, new)) == [
        ("a", "A", "t", DAY[3]),
        ("b", "B3", "t", DAY[4]),
        ("c", "C2", "u", DAY[5]),
    ]
    assert sorted_rows(upsert_sources(old, new.drop("seq").where("ip = 'c'")))[2] == (
        "c", "C2", "u", DAY[5],
    )


def test_delete(spark):
    old = table(spark, ("10.0.0.1", "A", "t", DAY[0]), ("2001:db8::1", "B", "t", DAY[0]))
    gone = spark.createDataFrame([(" 10.0.0.1\n",), ("10.0.0.9",), ("nonsense",)], "ip STRING")
    assert [r["name"] for r in delete_sources(old, gone).collect()] == ["B"]
    other_form = spark.createDataFrame([("2001:DB8:0::1",)], "ip STRING")
    assert [r["name"] for r in delete_sources(old, other_form).collect()] == ["A"]


def test_list_and_count(spark):
    rows = table(spark, ("2", "b", "t", DAY[0]), ("1", "b", "t", DAY[0]), ("3", "B", "t", DAY[0]))
    assert [tuple(r) for r in list_sources(rows).collect()] == [("B", "3", "t"), ("b", "1", "t"), ("b", "2", "t")]
    assert count_sources(rows).first()[0] == 3


@pytest.mark.parametrize(
    "ip, canonical",
    [
        ("10.0.0.1", "10.0.0.1"),
        (" 10.0.0.1\t", "10.0.0.1"),
        ("2001:DB8:0:0:0:0:0:1", "2001:db8::1"),
        ("::ffff:10.0.0.1", "::ffff:10.0.0.1"),
        ("::", "::"),
        ("010.0.0.1", None),
        ("10.0.0", None),
        ("256.0.0.1", None),
        ("fe80::1%eth0", None),
        ("1:2", None),
        ("", None),
        ("host.example", None),
        ("10.0.0.1/32", None),
    ],
)
def test_addresses(spark, ip, canonical):
    row = check_changes(changes(spark, (ip, "n", "apache", DAY[0], 0)), ["apache"]).first()
    assert row["reason"] == (None if canonical else "invalid_ip")
    if canonical:
        assert row["ip"] == canonical


def test_checks_come_in_order(spark):
    rows = changes(
        spark,
        ("bad", " ", "mailer", DAY[0], 0),
        ("bad", " ", None, DAY[0], 1),
        ("bad", " ", "apache", DAY[0], 2),
        ("bad", None, "apache", DAY[0], 3),
        (None, "n", "apache", DAY[0], 4),
    )
    got = {r["seq"]: r["reason"] for r in check_changes(rows, ["apache"]).collect()}
    assert got == {
        0: "unknown_log_type", 1: "unknown_log_type", 2: "name_required", 3: "name_required", 4: "invalid_ip",
    }


def test_stored_table(spark, tmp_path):
    sources = SourceTable(spark, str(tmp_path / "sources"), ["apache"])
    assert sources.read().count() == 0
    sources.add(" web ", " 10.0.0.1 ", "apache")
    first = sources.read().first()
    assert (first["ip"], first["name"], first["log_type"]) == ("10.0.0.1", "web", "apache")
    sources.add("renamed", "10.0.0.1", "apache")
    second = sources.read().first()
    assert second["name"] == "renamed" and second["created_at"] == first["created_at"]
    for name, ip, log_type, message in (
        ("", "10.0.0.2", "apache", "must have a name"),
        ("n", "10.0.0", "apache", "neither an IPv4"),
        ("n", "10.0.0.2", "mailer", "no parser"),
    ):
        with pytest.raises(ValueError, match=message):
            sources.add(name, ip, log_type)
    refused = sources.upsert(
        changes(spark, ("10.0.0.3", "c", "apache", DAY[0], 0), ("x", "d", "apache", DAY[0], 1))
    )
    assert [r["ip"] for r in refused.collect()] == ["x"]
    sources.remove("10.0.0.1")
    assert [r["ip"] for r in sources.read().collect()] == ["10.0.0.3"]
    sources.remove("10.0.0.3")
    assert sources.read().count() == 0
    sources.remove("10.0.0.3")
    assert sources.read().count() == 0


def test_a_version_without_its_marker_is_not_read(spark, tmp_path):
    sources = SourceTable(spark, str(tmp_path / "sources"), ["apache"])
    sources.add("web", "10.0.0.1", "apache")
    unfinished = table(spark, ("9.9.9.9", "x", "apache", DAY[0]))
    unfinished.write.parquet(str(tmp_path / "sources" / "data" / "version=2"))
    assert [r["ip"] for r in sources.read().collect()] == ["10.0.0.1"]
    sources.add("db", "10.0.0.2", "apache")
    assert sorted(r["ip"] for r in sources.read().collect()) == ["10.0.0.1", "10.0.0.2"]


def test_drafts_and_rows_that_no_version_names_are_not_read(spark, tmp_path):
    sources = SourceTable(spark, str(tmp_path / "sources"), ["apache"])
    sources.add("web", "10.0.0.1", "apache")
    unfinished = table(spark, ("9.9.9.9", "x", "apache", DAY[0]))
    unfinished.write.parquet(str(tmp_path / "sources" / "data" / "unfinished"))
    (tmp_path / "sources" / "versions" / "_draft-left").write_text("unfinished")
    assert [r["ip"] for r in sources.read().collect()] == ["10.0.0.1"]
    sources.add("db", "10.0.0.2", "apache")
    assert sorted(r["ip"] for r in sources.read().collect()) == ["10.0.0.1", "10.0.0.2"]


def test_an_edit_of_an_old_version_is_refused(spark, tmp_path):
    ours, theirs = (SourceTable(spark, str(tmp_path / "sources"), ["apache"]) for _ in range(2))
    ours.add("one", "10.0.0.1", "apache")
    more = upsert_sources(ours.read(), changes(spark, ("10.0.0.2", "two", "apache", DAY[0], 0)))
    theirs.add("three", "10.0.0.3", "apache")
    with pytest.raises(ConcurrentEdit):
        ours.write(more)
    ours.write(upsert_sources(ours.read(), changes(spark, ("10.0.0.2", "two", "apache", DAY[0], 0))))
    assert sorted(r["ip"] for r in theirs.read().collect()) == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]


def test_an_edit_is_repeated_on_what_another_has_stored(spark, tmp_path):
    ours, theirs = (SourceTable(spark, str(tmp_path / "sources"), ["apache"]) for _ in range(2))
    seen = []

    def change(current):
        seen.append(sorted(r["ip"] for r in current.collect()))
        if len(seen) == 1:
            theirs.add("three", "10.0.0.3", "apache")
        return upsert_sources(current, changes(spark, ("10.0.0.2", "two", "apache", DAY[0], 0)))

    ours.edit(change)
    assert seen == [[], ["10.0.0.3"]]
    assert sorted(r["ip"] for r in ours.read().collect()) == ["10.0.0.2", "10.0.0.3"]


def test_no_edit_of_two_threads_is_lost(spark, tmp_path):
    root, each = str(tmp_path / "sources"), 20

    def run(thread):
        sources = SourceTable(spark, root, ["apache"])
        for n in range(each):
            sources.add(f"s{n}", f"10.0.{thread}.{n}", "apache")

    threads = [threading.Thread(target=run, args=(n,)) for n in range(2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    sources = SourceTable(spark, root, ["apache"])
    assert sources.read().count() == 2 * each and sources.version() == 2 * each


def test_one_of_many_claimants_gets_a_name(spark, tmp_path):
    won = []

    def run(n):
        if Folder(spark, str(tmp_path / "claims")).claim("1", f"text {n}"):
            won.append(n)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(16)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    folder = Folder(spark, str(tmp_path / "claims"))
    assert len(won) == 1 and folder.names() == ["1"] and folder.text("1") == f"text {won[0]}"


def test_a_name_is_claimed_by_rename_where_there_are_no_links(spark, tmp_path):
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.claims.link./on", f"file://{tmp_path}")
    spark.conf.set("fs.viewfs.mounttable.claims.link./on", f"file://{tmp_path}")
    folder = Folder(spark, "viewfs://claims/on/names")
    assert folder.claim("1", "first") and not folder.claim("1", "second")
    assert folder.text("1") == "first" and folder.names() == ["1"]


def test_routing_is_pinned_per_batch(spark, tmp_path):
    sources = SourceTable(spark, str(tmp_path / "sources"), ["apache"])

    def seen(query_id, batch_id):
        return sorted(r["ip"] for r in sources.read_for_batch(query_id, batch_id).collect())

    assert seen("q", 0) == []
    sources.add("web", "10.0.0.1", "apache")
    assert seen("q", 0) == []
    assert seen("r", 0) == ["10.0.0.1"]
    assert seen("q", 1) == ["10.0.0.1"]
    sources.remove("10.0.0.1")
    assert seen("q", 1) == seen("r", 0) == ["10.0.0.1"]
    assert seen("q", 2) == []


@pytest.mark.parametrize(
    "rows",
    [
        [("a", "A", "t"), ("a", "B", "t")],
        [(None, "A", "t")],
        [("a", None, "t")],
        [("a", "A", None)],
    ],
)
def test_constraints(spark, tmp_path, rows):
    sources = SourceTable(spark, str(tmp_path / "sources"), ["t"])
    with pytest.raises(ValueError, match="needs one row"):
        sources.write(table(spark, *[(*row, DAY[0]) for row in rows]))
    assert sources.read().count() == 0
