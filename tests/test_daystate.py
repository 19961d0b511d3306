"""Reports from daily states equal those from events, over any range and after reloads."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests import frames
from tests.test_plans import plan_of
from tests.test_sources import database  # noqa: F401  (a fixture)
from webmetrics.operators import daystate
from webmetrics.plans import day_report, event_report
from webmetrics.sources import sink
from webmetrics.spec import FilterSpec

BY = ("traffic_medium", "country", "event_name", "campaign_name", "traffic_source")
FIRST = date(2024, 1, 1)


def random_events(spark, seed, count=600):
    rng = random.Random(seed)
    return frames.events(spark, *[
        {"event_date": rng.choice([None, *[FIRST + timedelta(days=k) for k in range(20)]]),
         "event_name": rng.choice(["view_item", "add_to_cart", "begin_checkout", "purchase", "scroll", None]),
         "user_pseudo_id": rng.choice([None, *[f"u{k}" for k in range(30)]]),
         "transaction_id": rng.choice([None, None, "(not set)", *[f"t{k}" for k in range(40)]]),
         "total_purchase_revenue": rng.choice([None, None, 1.25, 2.5]),
         "traffic_medium": rng.choice([None, "", "cpc", "organic"]), "country": rng.choice([None, "A", "B"]),
         "campaign_name": rng.choice([None, "x", "sale"]), "traffic_source": rng.choice([None, "Google"])}
        for _ in range(count)])


def rows(df):
    return sorted(map(repr, df.collect()))


RANGES = [
    FilterSpec(), FilterSpec(start="2024-01-05"), FilterSpec(start="2024-01-08", end="2024-01-14"),
    FilterSpec(start="2024-01-20", end="2024-01-20"), FilterSpec(start="2025-01-01", end="2025-02-01"),
]
FILTERED = [
    FilterSpec(mediums=("", "cpc"), start="2024-01-03", end="2024-01-12"), FilterSpec(countries=("A",), keyword="goo"),
    FilterSpec(event_names=("purchase", "scroll"), start="2024-01-09", end="2024-01-15"),
]


def same_reports(state, events, specs, by=()):
    for spec in specs:
        assert rows(day_report.kpi(state, spec)) == rows(event_report.kpi(events, spec))
        assert rows(day_report.kpi_compare(state, spec)) == rows(event_report.kpi_compare(events, spec))
        assert rows(day_report.daily_trend(state, spec, by=by)) == rows(event_report.daily_trend(events, spec, by=by))
        assert rows(day_report.funnel(state, spec)) == rows(event_report.funnel(events, spec))


def test_any_range(spark):
    events = random_events(spark, 1).cache()
    numbers = daystate.new_numbers(events).cache()
    found = {(r["kind"], r["number"]) for r in numbers.collect()}
    counts = {"users": 30, "transactions": 41}
    assert found == {(kind, n) for kind, count in counts.items() for n in range(1, count + 1)}
    same_reports(daystate.day_state(events, numbers), events, RANGES)
    split = daystate.day_state(events, numbers, BY)
    same_reports(split, events, RANGES[:3] + FILTERED, ("country",))


def test_numbers_beyond_one_bitmap(spark):
    people = spark.range(100_000).withColumn("user", F.concat(F.lit("u"), F.col("id")))
    events = people.select(
        F.date_add(F.lit(FIRST), (F.col("id") % 3).cast("int")).alias("event_date"), F.col("user").alias("user_pseudo_id"),
        F.lit("view_item").alias("event_name"), F.lit(None).cast("string").alias("transaction_id"), F.lit(1.0).alias("total_purchase_revenue"))
    state = daystate.day_state(events, daystate.new_numbers(events))
    (row,) = day_report.kpi(state, FilterSpec(start="2024-01-02", end="2024-01-03")).collect()
    assert row["users"] == 66_666 and state.seen.agg(F.max("bucket")).first()[0] == 4


def test_filters_need_their_columns(spark):
    events = random_events(spark, 2, 20)
    state = daystate.day_state(events, daystate.new_numbers(events), ("country",))
    with pytest.raises(ValueError, match="traffic_medium"):
        day_report.kpi(state, FilterSpec(mediums=("cpc",)))
    with pytest.raises(ValueError, match="campaign_name, traffic_source"):
        day_report.kpi_compare(state, FilterSpec(keyword="x"))
    day_report.funnel(state, FilterSpec(event_names=("purchase",), countries=("A",)))  # the funnel ignores event names


@pytest.mark.parametrize("by", [(), BY])
def test_days_loaded_in_pieces_and_again(spark, database, by):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    right, wrong = random_events(spark, 3).cache(), random_events(spark, 4).cache()
    day_report.load_days(spark, wrong, layout, "2024-01-04", "2024-01-12", by)
    day_report.load_days(spark, right, layout, "2024-01-10", "2024-01-20", by)
    day_report.load_days(spark, right.where("event_date <> '2024-01-02'"), layout, None, "2024-01-09", by)
    events = right.where("event_date <> '2024-01-02'")
    state = day_report.open_days(spark, layout, by)
    same_reports(state, events, [FilterSpec(end="2024-01-31"), *RANGES[2:4]] + (FILTERED[:1] if by else []))
    numbers = spark.table(f"{database}.day_numbers")
    assert numbers.count() == numbers.select("kind", "number").distinct().count() == numbers.select("kind", "name").distinct().count()
    state = day_report.load_days(spark, right, layout, by=by)  # all days, those without a date included
    same_reports(state, right, [FilterSpec()])


def test_reports_read_no_events_and_only_their_days(spark, database):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    state = day_report.load_days(spark, random_events(spark, 5), layout)
    spec = FilterSpec(start="2024-01-05", end="2024-01-06")
    for df in (day_report.kpi(state, spec), day_report.kpi_compare(state, spec), day_report.funnel(state, spec)):
        plan = plan_of(df)
        scans = re.findall(r"FileScan parquet \S+day_(\w+?)__", plan)
        assert scans and set(scans) <= {"totals", "seen", "masks"}
        assert plan.count("PartitionFilters: [isnotnull(event_date") == len(scans)


def test_no_events(spark):
    none = random_events(spark, 6, 5).where("false")
    state = daystate.day_state(none, daystate.new_numbers(none))
    same_reports(state, none, [FilterSpec(), FilterSpec(start="2024-01-02", end="2024-01-03")])
