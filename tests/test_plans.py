"""The physical plans that large tables depend on."""

import re

import pytest
from pyspark.sql import functions as F

from tests import frames
from tests.oracle import DATA
from tests.test_skew import shuffled
from webmetrics.operators.semijoin import filter_products_by_events
from webmetrics.plans import event_report, event_table, newuser_report, options, product_report
from webmetrics.sources import driver_tables as sample
from webmetrics.sources.sink import write_parquet
from webmetrics.spec import FilterSpec

RECENT = FilterSpec(start="2024-01-16", end="2024-01-30")
AUDIENCE = FilterSpec(mediums=("", "cpc"), keyword="goo")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    small = f"{DATA}/sf0.001"
    for name in ("events", "products", "newusers"):
        getattr(sample, name)(spark, small).coalesce(1).write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}")
            for name in ("events", "products", "newusers")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def scans(plan):
    return re.findall(r"FileScan parquet \[(.*?)\]", plan)


def pushed(plan):
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))


def test_compare_reads_both_periods_in_one_scan(stored):
    plan = plan_of(event_report.kpi_compare(stored["events"], RECENT))
    assert len(scans(plan)) == 1
    assert len(scans(plan)[0].split(",")) == 4
    assert "GreaterThanOrEqual(event_date,2024-01-01)" in pushed(plan)
    assert "LessThanOrEqual(event_date,2024-01-30)" in pushed(plan)


def test_counts_are_combined_before_each_shuffle(stored):
    for df in (event_report.kpi(stored["events"], RECENT),
               event_report.daily_trend(stored["events"], RECENT),
               event_report.funnel(stored["events"], RECENT),
               newuser_report.newuser_stats(stored["newusers"], RECENT)):
        plan = plan_of(df)
        first_shuffle = plan.rindex("Exchange")
        assert "partial_" in plan[first_shuffle:] or "HashAggregate(keys=[" in plan[first_shuffle:]
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_medium_filter_reaches_the_reader(stored):
    plan = plan_of(event_report.event_composition(stored["events"], AUDIENCE))
    assert "Or(In(traffic_medium, [,cpc]),IsNull(traffic_medium))" in pushed(plan)
    plan = plan_of(event_report.event_composition(
        stored["events"], FilterSpec(countries=["A"], event_names=["purchase"])))
    assert "EqualTo(country,A)" in pushed(plan) and "EqualTo(event_name,purchase)" in pushed(plan)


def test_funnel_reads_stage_events_and_three_columns(stored):
    plan = plan_of(event_report.funnel(stored["events"], RECENT))
    assert "In(event_name, [add_to_cart,begin_checkout,purchase,view_item])" in pushed(plan)
    assert len(scans(plan)[0].split(",")) == 3
    assert plan.count("Exchange") == 2


def test_share_reuses_the_counts(spark, stored):
    shares = event_report.device_share(stored["events"], RECENT)
    shares.collect()
    total = plan_of(shares).split("Subquery subquery")[2].split("== Initial Plan ==")[0]
    assert "ReusedExchange" in total and not scans(total)
    assert "Window" not in plan_of(shares)


def test_no_join_without_event_conditions(stored):
    plan = plan_of(product_report.category_revenue(stored["products"], stored["events"], RECENT))
    assert "Join" not in plan and len(scans(plan)) == 1
    assert "TakeOrderedAndProject" in plan


def test_semi_join_reads_key_and_condition_columns_only(spark, stored):
    with shuffled(spark):
        plan = plan_of(filter_products_by_events(stored["products"], stored["events"], AUDIENCE))
        assert re.search(r"SortMergeJoin .*LeftSemi", plan)
        right = [s for s in scans(plan) if "traffic_medium" in s]
        assert len(right) == 1 and len(right[0].split(",")) == 7
        # The product side of the join sits directly on its shuffle, where AQE can split it.
        left = plan[plan.index("LeftSemi"):]
        assert re.match(r"LeftSemi\n\s*:- Sort [^\n]*\n\s*:\s+\+- Exchange hashpartitioning", left)


def test_totals_are_combined_before_the_join(spark, stored):
    with shuffled(spark):
        plan = plan_of(product_report.top_items(stored["products"], stored["events"], AUDIENCE))
    below = plan[plan.index("LeftSemi"):]
    assert "partial_sum" in below


def rows_read(df):
    """Rows each scan of an executed plan gave, in plan order."""
    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if name.startswith("Scan parquet"):
            return [node.metrics().get("numOutputRows").get().value()]
        children = node.children()
        return [n for i in range(children.size()) for n in visit(children.apply(i))]

    df.collect()
    return visit(df._jdf.queryExecution().executedPlan())


def test_dates_of_products_limit_the_events_read(spark, stored, tmp_path):
    events, products = stored["events"], stored["products"]
    for name, df in (("events", events), ("products", products)):
        write_parquet(df, str(tmp_path / name), partition_by=("event_date",))
    events, products = (spark.read.parquet(str(tmp_path / n)) for n in ("events", "products"))
    spec = FilterSpec(mediums=("", "cpc"), start="2024-01-16", end="2024-01-17")
    found = product_report.category_revenue(products, events, spec)
    sold, seen = rows_read(found)
    days = "event_date BETWEEN '2024-01-16' AND '2024-01-17'"
    assert sold == products.where(days).count()
    assert seen == events.where(days).count() < events.count() / 10


def test_small_sides_are_broadcast_by_size(spark, stored):
    found = filter_products_by_events(stored["products"], stored["events"], AUDIENCE)
    assert "BroadcastHashJoin" in final_plan(found)


def test_pages_never_sort_everything(stored):
    for df in (event_table.events_page(stored["events"], RECENT, None, 3),
               event_table.events_page_after(stored["events"], RECENT),
               product_report.products_page(stored["products"], None, RECENT, 2)):
        plan = plan_of(df)
        assert "TakeOrderedAndProject" in plan
        assert "rangepartitioning" not in plan


def test_page_shows_columns_only_for_its_rows(stored):
    plan = plan_of(event_table.events_page(stored["events"], RECENT))
    below = plan[plan.index("TakeOrderedAndProject"):]
    assert "date_format" not in below[below.index("\n"):]


def test_wide_columns_are_read_for_the_page_only(spark, stored, tmp_path):
    write_parquet(stored["events"], str(tmp_path / "days"), partition_by=("event_date",))
    days = spark.read.parquet(str(tmp_path / "days"))
    first = event_table.events_page(days, FilterSpec(), None, 0)
    assert rows_read(first)[0] < days.count() / 10
    rows = first.collect()
    assert len(rows) == 20 and rows[0]["event_date"] == "2024-01-30"
    plan = plan_of(first)
    assert any("event_datetime" in s and "country" not in s for s in scans(plan))


def test_page_and_count_share_the_semi_join_shuffles(spark, stored):
    with shuffled(spark):
        page = product_report.products_page(stored["products"], stored["events"], AUDIENCE, 0)
        page.collect()
        assert plan_of(page).split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def test_options_read_one_column_each(stored):
    plan = plan_of(options.filter_options(stored["events"], stored["products"]))
    assert sorted(len(s.split(",")) for s in scans(plan)) == [1, 1, 1, 1, 2]
    assert "rangepartitioning" not in plan


def test_day_range_reaches_the_sample_scan(spark):
    rows = sample.events(spark, f"{DATA}/sf0.001", "2024-01-16", "2024-01-30")
    plan = plan_of(event_report.event_composition(rows, RECENT))
    assert "GreaterThanOrEqual(ts,2024-01-16" in pushed(plan)
    assert "LessThan(ts,2024-01-31" in pushed(plan)


def test_new_user_join_needs_no_shuffle_of_its_own(spark, tmp_path):
    raw = frames.raw(spark, {"event_date": "20240101", "event_timestamp": 1,
                             "event_name": "first_visit", "user_pseudo_id": "a"})
    from webmetrics.operators.newusers import build_new_users
    raw.write.parquet(str(tmp_path / "raw"))
    with shuffled(spark):
        plan = plan_of(build_new_users(spark.read.parquet(str(tmp_path / "raw"))))
    # first visits: one; purchases: by (person, order), then by person
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("EqualTo(event_name,first_visit)") == 1
    assert "WindowGroupLimit" in plan


def test_everything_is_lazy(spark):
    broken = spark.range(1).select(
        F.raise_error(F.lit("read too early")).cast("date").alias("event_date"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "event_name", "user_pseudo_id", "country", "device_type", "traffic_medium",
            "traffic_source", "campaign_name", "transaction_id")],
        F.lit(None).cast("timestamp").alias("event_datetime"),
        F.lit(1.0).alias("total_purchase_revenue"))
    event_report.event_report(broken, RECENT)
    event_table.events_page(broken, RECENT)
    with pytest.raises(Exception, match="read too early"):
        event_report.daily_trend(broken, RECENT).collect()
