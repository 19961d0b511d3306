"""The data source of day shards against Spark's own Parquet reader."""

import shutil

import pytest
from pyspark.sql import functions as F

from webmetrics.operators.flatten import flatten_events
from webmetrics.plans import event_report
from webmetrics.schema import RAW_EVENT_SCHEMA
from webmetrics.sources import driver_tables as sample
from webmetrics.sources import scan
from webmetrics.sources.shards import read_shards
from webmetrics.spec import FilterSpec

SCHEMA = "user STRING, n LONG, x DOUBLE, ok BOOLEAN, place STRUCT<city: STRING>, table_suffix STRING"
ROWS = [("a", 1, 1.0, True, ("p",), "20240101"), ("b", 2, float("nan"), None, None, "20240101"), (None, None, None, False, (None,), "20240102"),
        ("é", 3, -1.0, True, ("q",), "20240103"), ("", 4, 0.0, False, ("p",), "20240103"), ("a", 5, 2.0, None, ("q",), "intraday")]
FILTERS = ["true", "user = 'a'", "user <> 'a'", "user IS NULL", "n NOT IN (1, 5)", "x > 0", "x = 'NaN'", "place.city = 'p'", "table_suffix = '20240103' OR n = 1"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "events")
    spark.createDataFrame(ROWS, SCHEMA).write.partitionBy("table_suffix").parquet(path)
    return path


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("start, end", [(None, None), ("20240102", "20240103"), ("20240103", None), (None, "20240101"), ("2023", "2023")])
def test_ranges(spark, folder, start, end):
    plain = spark.read.schema(SCHEMA).parquet(folder).where(F.col("table_suffix").between(start or "", end or "z"))
    assert rows(read_shards(spark, folder, SCHEMA, start, end)) == rows(plain)


def test_one_frame_serves_several_queries(spark, folder):
    """Filters of one query must not reach another: they would, were they pushed down to a Python source."""
    stored, plain = read_shards(spark, folder, SCHEMA), spark.read.schema(SCHEMA).parquet(folder)
    for test in FILTERS + FILTERS:
        assert rows(stored.where(test)) == rows(plain.where(test))
    assert rows(stored) == rows(plain)


def test_other_shards_are_not_opened(spark, folder, tmp_path):
    copy = shutil.copytree(folder, tmp_path / "copy")
    for file in (copy / "table_suffix=20240101").glob("*.parquet"):
        file.write_bytes(b"not to be opened")
    assert read_shards(spark, str(copy), SCHEMA, "20240102", "20240103").count() == 3
    assert read_shards(spark, f"file://{copy}", SCHEMA, "20240102").count() == 4
    with pytest.raises(Exception, match="Could not open"):
        read_shards(spark, str(copy), SCHEMA).collect()


def test_columns_in_any_order_and_fewer(spark, folder):
    found = read_shards(spark, folder, "table_suffix STRING, n LONG")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((r[5], r[1]) for r in ROWS), key=repr)


def test_reports_from_shards(spark, tmp_path):
    raw = sample.raw_events(spark, "/root/testdata/sf0.001").drop("event_id")
    raw.write.partitionBy("table_suffix").parquet(str(tmp_path / "raw"))
    some = read_shards(spark, str(tmp_path / "raw"), RAW_EVENT_SCHEMA, "20240105", "20240120")
    wanted = scan.in_shards(raw, "20240105", "20240120")
    spec = FilterSpec(start="2024-01-10", end="2024-01-14")
    found, plain = (event_report.kpi_compare(flatten_events(df), spec).withColumns(
        {c: F.round(c, 6) for c in ("current", "previous", "pct")}).collect() for df in (some, wanted))
    assert found == plain
    assert some.agg(F.sum(F.size("items"))).collect() == wanted.agg(F.sum(F.size("items"))).collect()
