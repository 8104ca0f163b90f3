"""Every registered query against its SQL, on the smallest tables."""

import pytest

from pyspark.sql import functions as F

from __spark_entry__ import entry
from accesslens import catalogue, samples
from accesslens.catalogue import CATALOGUE, access_sql
from check import compare, duck


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_agrees_with_sql(spark, connection, sf_dir, name):
    verdict, _ = compare(spark, connection, sf_dir, name)
    assert verdict.startswith("ok"), verdict


def test_every_query_has_its_sql():
    assert all(item.sql for item in CATALOGUE.values())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["panel", "key", "label", "requests", "pct"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["parse_access", "timeline_24h", "bus_capture", "dashboard_one_pass"])
def test_results_do_not_depend_on_the_session_zone(spark, connection, sf_dir, zone, name):
    zone("America/New_York")
    verdict, _ = compare(spark, connection, sf_dir, name)
    assert verdict == "ok", verdict


@pytest.mark.parametrize(
    "name, condition",
    [("filter_ip", "remote_host = '192.168.2.42'"), ("filter_path", "path = '/click/2'")],
)
def test_filters_cover_all_of_the_table(spark, name, condition):
    tables = "/root/testdata/sf0.01"
    whole = f"SELECT count(*) FROM ({access_sql()}) WHERE ts IS NOT NULL AND {condition}"
    found = CATALOGUE[name].query(spark, tables).count()
    assert found == duck(tables).execute(whole).fetchone()[0] > 0


def test_a_row_group_of_many_rows_is_dealt_to_many_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(samples, "ROWS_PER_TASK", 100, raising=False)
    rows = samples.traffic(spark, sf_dir)
    tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(row["count"] for row in tasks) == 1000
    assert len(tasks) == 10 and max(row["count"] for row in tasks) < 200


def test_a_turn_of_the_edited_stream_is_landed_by_many_tasks_and_taken_in_at_once(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_folder", lambda spark, purpose: str(tmp_path))
    rows = CATALOGUE["stream_with_edit"].query(spark, sf_dir).groupBy("batch_id").count().collect()
    assert {row["batch_id"] for row in rows} == {0, 1}
    assert len(list((tmp_path / "capture").rglob("*.parquet"))) == 2 * spark.sparkContext.defaultParallelism
