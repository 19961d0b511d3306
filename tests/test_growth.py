"""What must not grow with the tables: keys that the driver samples, and what joins shuffle."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests import frames
from webmetrics.operators import timeline
from webmetrics.operators.flatten import explode_items
from webmetrics.schema import RAW_EVENT_SCHEMA
from webmetrics.sources import driver_tables as sample


def test_ranges_do_not_grow_with_stretches(spark, monkeypatch):
    monkeypatch.setattr(timeline, "LEAST_RANGES", 4)
    start = datetime(2024, 1, 1)
    rows = frames.events(spark, *[{"event_datetime": None if k < 5 else start + timedelta(minutes=k), "user_pseudo_id": "u"} for k in range(400)])
    cut = timeline.cut_into_stretches(rows, 400, 10)
    assert cut.rdd.getNumPartitions() == 4
    seen = cut.groupBy("stretch").agg(F.min("event_datetime").alias("a"), F.max("event_datetime").alias("z"), F.count(F.lit(1)).alias("n")).orderBy("stretch").collect()
    assert sum(r["n"] for r in seen) == 400 and len(seen) > 20
    assert all(x["z"] is None or x["z"] < y["a"] for x, y in zip(seen, seen[1:]))


def test_items_are_built_behind_the_joins(spark):
    products = sample.products(spark, "/root/testdata/sf0.001", wide=True)
    lines = products._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(k for k, line in enumerate(lines) if "Join Inner" in line)
    assert any("item_variant_" in line for line in lines[:first])
    assert not any("item_variant_" in line for line in lines[first + 1 :] if "Join" not in line)


def test_joins_shuffle_only_what_is_asked_of_items(spark):
    products = sample.products(spark, "/root/testdata/sf0.001")
    plan = products.select("item_category").distinct()._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    projected = [line for line in below.splitlines() if "Project" in line]
    assert projected and not any(c in line for line in projected for c in ("l_quantity", "l_extendedprice", "p_name", "p_size"))


def test_empty_bundles_vanish_below_the_joins(spark):
    records = sample.raw_bundles(spark, "/root/testdata/sf0.001", by_field=True)
    lines = explode_items(records, by_field=True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "Relation [l_orderkey" in line)
    assert "Filter" in lines[at - 1] and "l_linenumber" in lines[at - 1]


def test_lists_by_field_are_the_items(spark):
    def rows(by_field):
        records = sample.raw_bundles(spark, "/root/testdata/sf0.001", by_field=by_field)
        return sorted(map(repr, explode_items(records, wide=True, by_field=by_field).collect()))

    assert rows(True) == rows(False) != []


def test_records_do_not_follow_changes_of_the_schema(spark):
    added = RAW_EVENT_SCHEMA.add("added_later", "string") if "added_later" not in RAW_EVENT_SCHEMA.names else RAW_EVENT_SCHEMA
    try:
        assert "added_later" not in sample.raw_events(spark, "/root/testdata/sf0.001").columns
    finally:
        added.fields.pop()
        added.names.pop()
