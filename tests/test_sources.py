"""Readers and writers on real files."""

from collections import Counter
from datetime import date, datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tests import frames
from tests.frames import at, column, dicts, only
from tests.oracle import DATA
from webmetrics.operators.flatten import explode_items, flatten_events
from webmetrics.operators.measures import count_rows
from webmetrics.operators.newusers import build_new_users
from webmetrics.plans.etl import run_etl
from webmetrics.plans.event_report import kpi, matched_rows
from webmetrics.schema import NEWUSER_COLUMNS, PURCHASES_SCHEMA, RAW_EVENT_SCHEMA, STORED_COLUMNS
from webmetrics.sources import driver_tables as sample
from webmetrics.sources import scan, sink
from webmetrics.sources.purchases import fill_purchases, gen_purchases
from webmetrics.spec import FilterSpec

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    """Sample records with full item lists, stored by day like a delivery."""
    path = str(tmp_path_factory.mktemp("raw") / "events")
    lists = (
        sample.raw_item_records(spark, SMALL)
        .groupBy("event_id").agg(F.flatten(F.collect_list("items")).alias("items"))
    )
    records = sample.raw_events(spark, SMALL).drop("items").join(lists, "event_id", "left")
    columns = [f.name for f in RAW_EVENT_SCHEMA.fields]
    sink.write_parquet(records.select("event_id", *columns), path, partition_by=("table_suffix",))
    return path


@pytest.fixture()
def database(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path)))}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def _rows(df):
    return Counter(map(tuple, df.collect()))


def test_one_item_records_equal_full_lists(spark, nested):
    raw = scan.read_raw_events(spark, nested, "20240101", "20240131")
    assert raw.where(F.size("items") > 1).count() > 100
    assert _rows(explode_items(raw)) == _rows(sample.products(spark, SMALL))
    assert _rows(flatten_events(raw)) == _rows(sample.events(spark, SMALL))


def test_shards_are_pruned_and_inclusive(spark, nested):
    some = scan.read_raw_events(spark, nested, "20240105", "20240107")
    assert sorted(column(some.select("table_suffix").distinct(), "table_suffix")) == [
        "20240105", "20240106", "20240107"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_suffix" in plan
    one = scan.read_raw_events(spark, nested, "20240105")
    assert column(one.select("table_suffix").distinct(), "table_suffix") == ["20240105"]
    assert scan.read_raw_events(spark, nested).count() == 0     # the default day is not there


def test_only_used_nested_fields_are_read(spark, nested):
    raw = scan.read_raw_events(spark, nested, "20240101", "20240131")
    plan = flatten_events(raw).select("country")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<geo:struct<country:string>>" in plan


def test_row_groups_are_bounded_and_files_are_not(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_parquet(spark.range(0, 1000, 1, 1), path, rows_per_group=300)
    files = list((tmp_path / "out").glob("*.parquet"))
    assert len(files) == 1
    meta = pq.ParquetFile(files[0]).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [300, 300, 300, 100]
    assert meta.row_group(0).column(0).compression == "SNAPPY"
    sink.write_parquet(spark.range(0, 10, 1, 1), path, rows_per_file=4)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3
    assert spark.read.parquet(path).count() == 10


def test_times_have_statistics(spark, tmp_path):
    path = tmp_path / "times"
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    sink.write_parquet(frames.events(spark, {}).select("event_datetime").coalesce(1), str(path))
    column = pq.ParquetFile(next(path.glob("*.parquet"))).metadata.row_group(0).column(0)
    assert column.physical_type == "INT64" and column.statistics.has_min_max
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == before


def test_empty_result_still_has_a_file(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert sink.extract("none", spark.range(0), path) == 0
    assert scan.read_table_path(spark, path).count() == 0


def test_empty_result_behind_a_shuffle_is_counted(spark, tmp_path):
    nothing = frames.raw(spark, {"event_date": "20240101", "event_timestamp": 1, "items": []})
    rows = explode_items(nothing)
    assert sink.extract("none", rows, str(tmp_path / "a"), partition_by=("event_date",),
                        rebalance=True) == 0
    some = frames.events(spark, {}, {})
    assert sink.extract("some", some, str(tmp_path / "b"), partition_by=("event_date",),
                        rebalance=True) == 2


def test_replacing_one_partition_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "days")
    days = spark.createDataFrame([("a", 1), ("b", 2)], "day STRING, v INT")
    sink.write_parquet(days, path, partition_by=("day",))
    sink.write_parquet(days.where("day = 'b'").withColumn("v", F.lit(9)), path,
                       partition_by=("day",), replace="partitions")
    stored = spark.read.parquet(path)
    assert sorted((r.day, r.v) for r in stored.collect()) == [("a", 1), ("b", 9)]
    sink.write_parquet(days.where("day = 'a'"), path, partition_by=("day",))
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        sink.write_parquet(days, path, replace="some")


def test_extract_counts_while_writing(spark, tmp_path):
    path = str(tmp_path / "counted")
    assert sink.extract("rows", frames.scattered(spark, 12345), path) == 12345
    assert spark.read.parquet(path).count() == 12345


def test_matched_rows_is_the_filtered_count(spark):
    df = frames.events(spark, {"country": "A"}, {"country": "B"}, {"country": "A"})
    rows, seen = matched_rows(df, FilterSpec(countries=["A"]))
    assert len(rows.collect()) == 2 and seen.rows == 2
    for act in (lambda df: df.groupBy("country").count().collect(), lambda df: df.collect()):
        rows, seen = matched_rows(df, FilterSpec(countries=["none"]))
        act(rows)
        assert seen.rows == 0


def test_warehouse(spark, database):
    ev = frames.events(spark, {"traffic_medium": "cpc"}, {"event_date": at("2024-01-02").date()})
    pr = frames.products(spark, {"item_price": 1.0})
    layout = sink.StoreLayout(database=database)
    assert sink.build_warehouse(spark, ev, pr, layout=layout) == ["events", "products"]
    assert not scan.has_table(spark, f"{database}.newusers")
    assert scan.open_optional(spark, f"{database}.newusers") is None
    assert sorted(spark.table(f"{database}.events").columns) == sorted(STORED_COLUMNS["events"])
    built = sink.build_warehouse(
        spark, ev, pr, frames.newusers(spark, {}),
        sink.StoreLayout(database=database, rebalance=("events", "products", "newusers")))
    assert built == ["events", "products", "newusers"]
    stored = scan.open_table(spark, f"{database}.events")
    assert stored.count() == 2
    day = FilterSpec(start="2024-01-02", end="2024-01-02")
    assert only(kpi(stored, day))["events"] == 1
    plan = kpi(stored, day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_warehouse_is_built_once(spark, database):
    calls = []

    def load():
        calls.append(1)
        return frames.events(spark, {}), frames.products(spark, {}), None

    layout = sink.StoreLayout(database=database, by_day=False)
    assert sink.ensure_warehouse(spark, load, layout) == ["events", "products"]
    assert sink.ensure_warehouse(spark, load, layout) == []
    assert calls == [1]


def test_append_matches_columns_by_name(spark, database):
    name = f"{database}.appended"
    sink.append_table(spark.createDataFrame([(1, "a")], "n INT, t STRING"), name)
    sink.append_table(spark.createDataFrame([("b", 2)], "t STRING, n INT"), name)
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, "a"), (2, "b")]


def test_etl_from_stored_records(spark, nested, database, tmp_path):
    schema = StructType([*RAW_EVENT_SCHEMA.fields, StructField("event_id", LongType())])
    raw = scan.read_raw_events(spark, nested, "20240101", "20240131", schema)
    result = run_etl(spark, raw, str(tmp_path / "files"), "20240101", "20240131",
                     sink.StoreLayout(database=database), tie_break=["event_id"])
    assert result.rows == {"events": 1334, "products": 4009, "newusers": 151}
    assert result.tables == ["events", "products", "newusers"]
    summary = only(result.summary)
    assert (summary["users"], summary["buyers"]) == (151, 68)
    assert summary["conversion_rate"] == pytest.approx(68 / 151 * 100)
    assert spark.table(f"{database}.newusers").count() == 151
    full = scan.read_table_path(spark, str(tmp_path / "files" / "newusers"))
    assert sorted(full.columns) == sorted(NEWUSER_COLUMNS)


def test_one_day_etl_uses_that_day_only(spark, nested, database, tmp_path):
    raw = scan.read_raw_events(spark, nested, "20240101", "20240131")
    result = run_etl(spark, raw, str(tmp_path / "files"), "20240110",
                     layout=sink.StoreLayout(database=database))
    assert result.rows["events"] == raw.where("table_suffix = '20240110'").count()
    assert result.rows["newusers"] == build_new_users(
        raw.where("table_suffix = '20240110'")).count()


@pytest.mark.parametrize("run_day, wanted", [
    ("2021-02-01", ("20210101", "20210131")),
    ("2021-01-01", ("20201201", "20201231")),
    ("2024-03-31", ("20240201", "20240229")),
])
def test_previous_month(spark, run_day, wanted):
    assert sink.previous_month_range(run_day) == wanted
    first, last = sink.previous_month(F.lit(date.fromisoformat(run_day)))
    row = only(spark.range(1).select(F.date_format(first, "yyyyMMdd").alias("a"),
                                     F.date_format(last, "yyyyMMdd").alias("b")))
    assert (row["a"], row["b"]) == wanted


def test_template_values_are_bound(spark):
    rows = spark.createDataFrame([("20240101", 1), ("20240102", 2), ("20240103", 3)],
                                 "table_suffix STRING, n INT")
    rows.createOrReplaceTempView("template_rows")
    found = scan.run_template(spark, "shard_range", source="template_rows", start="20240102",
                              end="20240103")
    assert sorted(column(found, "n")) == [2, 3]
    odd = scan.run_template(spark, "shard_range", source="template_rows",
                            start="' OR 1=1 --", end="")
    assert odd.count() == 0


def test_materialized_frame_is_reused(spark):
    kept = scan.materialize(frames.events(spark, {"country": "A"}, {}), ["country"])
    assert kept.columns == ["country"] and kept.storageLevel.useMemory and kept.count() == 2
    kept.unpersist()


def test_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    sink.write_csv(spark.createDataFrame([(1, "a,b")], "n INT, t STRING"), path)
    back = scan.read_source(spark, "csv", path=path, header=True)
    assert dicts(back) == [{"n": "1", "t": "a,b"}]


# ---- generated purchases -------------------------------------------------------------------


def test_purchases_do_not_depend_on_partitions(spark):
    one = gen_purchases(spark, 5000)
    assert one.dtypes == [(f.name, f.dataType.simpleString()) for f in PURCHASES_SCHEMA]
    ids = spark.range(1, 5001, 1, 7).withColumnRenamed("id", "purchase_id").repartition(3)
    assert _rows(one) == _rows(fill_purchases(ids))
    assert _rows(one) != _rows(gen_purchases(spark, 5000, seed=43))


def test_purchases_are_spread_evenly(spark):
    n = 210_000
    rows = gen_purchases(spark, n).cache()
    for name, values in (("supplier", 50), ("item_category", 4), ("department", 4),
                         ("status", 3), ("year", 7)):
        counts = [r["count"] for r in rows.groupBy(name).count().collect()]
        assert len(counts) == values
        expected = n / values
        chi2 = sum((c - expected) ** 2 / expected for c in counts)
        assert chi2 < 3 * values + 20, (name, chi2)
    ranges = only(rows.agg(
        F.min("quantity").alias("q0"), F.max("quantity").alias("q1"),
        F.min("unit_price").alias("u0"), F.max("unit_price").alias("u1"),
        F.min("purchase_amount").alias("a0"), F.max("purchase_amount").alias("a1"),
        F.avg("purchase_amount").alias("a"), F.corr("unit_price", "purchase_amount").alias("r"),
        F.corr(F.col("quantity").cast("double"), "purchase_amount").alias("s")))
    assert (ranges["q0"], ranges["q1"]) == (1, 999)
    assert 10 <= ranges["u0"] < 11 and 499 < ranges["u1"] < 500
    assert 100 <= ranges["a0"] < 120 and 49900 < ranges["a1"] < 50000
    assert abs(ranges["a"] - 25050) < 150
    assert abs(ranges["r"]) < 0.02 and abs(ranges["s"]) < 0.02
    assert only(count_rows(rows.select("purchase_id").distinct()))["row_count"] == n
    rows.unpersist()


def test_years_restart_in_every_chunk(spark):
    rows = gen_purchases(spark, 20, chunk=10).orderBy("purchase_id")
    assert column(rows, "year") == [2020 + (i % 10) % 7 for i in range(20)]


def _visit(shard, day, user, name="first_visit"):
    """A record delivered in ``shard`` that happened on ``day``."""
    micros = int(datetime(int(day[:4]), int(day[4:6]), int(day[6:]), tzinfo=timezone.utc).timestamp() * 1e6)
    return {"table_suffix": shard, "event_date": day, "event_timestamp": micros,
            "event_name": name, "user_pseudo_id": user, "items": []}


def test_reloaded_shards_replace_shards_not_days(spark, database, tmp_path):
    schema = StructType([*RAW_EVENT_SCHEMA.fields])
    if "table_suffix" not in schema.names:
        schema = schema.add("table_suffix", "string")
    january = [_visit("20210131", "20210131", "a"), _visit("20210131", "20210131", "b")]
    february = [_visit("20210201", "20210201", "a"), _visit("20210201", "20210201", "a", "purchase"),
                _visit("20210202", "20210202", "c"), _visit("20210201", "20210131", "late", "scroll")]
    out, layout = str(tmp_path / "files"), sink.StoreLayout(database=database)

    def load(records, start, end):
        raw = spark.createDataFrame(records, schema)
        return run_etl(spark, raw, out, start, end, layout, replace="partitions")

    load(january, "20210101", "20210131")
    done = load(january + february, "20210201", "20210228")
    assert done.rows["events"] == 4
    stored = spark.read.parquet(f"{out}/events").where("event_date = '2021-01-31'")
    assert sorted(r["user_pseudo_id"] for r in stored.collect()) == ["a", "b", "late"]
    people = [(r["user_pseudo_id"], r["did_purchase"])
              for r in spark.read.parquet(f"{out}/newusers").collect()]
    assert sorted(people) == [("a", True), ("b", False), ("c", False)]
    load(january + [r for r in february if r["table_suffix"] != "20210202"], "20210201", "20210228")
    assert spark.table(f"{database}.events").count() == 5  # the emptied shard is gone
