"""A third of all rows under one key: same results as brute force, and plans that split it."""

import re
from collections import defaultdict
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tests.frames import dicts, only, scattered
from webmetrics.operators import newusers, semijoin
from webmetrics.plans import event_report, product_report
from webmetrics.spec import FilterSpec

AUDIENCE = FilterSpec(countries=["C"])
ROWS = 6000


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffled(spark):
    """No broadcasts: the plan of tables too large for them."""
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                    spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def _key(hot):
    """Every third row belongs to one person and moment."""
    pid = F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("u"), F.col("id") % 400))
    moment = F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 1_704_100_000)
                                 .otherwise(1_704_000_000 + F.col("id") % 900 * 60))
    return pid, moment


@pytest.fixture(scope="module")
def hot_tables(spark, tmp_path_factory):
    pid, moment = _key("hot")
    base = scattered(spark, ROWS)
    folder = tmp_path_factory.mktemp("hot")
    base.select(
        F.to_date(moment).alias("event_date"), moment.alias("event_datetime"),
        F.when(F.col("id") % 5 == 0, "view_item").otherwise("purchase").alias("event_name"),
        pid.alias("user_pseudo_id"), F.concat(F.lit("i"), F.col("id") % 50).alias("item_id"),
        F.concat(F.lit("n"), F.col("id") % 17).alias("item_name"), F.lit("b").alias("item_brand"),
        F.concat(F.lit("c"), F.col("id") % 9).alias("item_category"),
        F.lit(1.5).alias("item_price"), (F.col("id") % 7).alias("item_quantity"),
        (F.col("id") % 11).cast("double").alias("item_total_revenue"),
    ).write.parquet(f"{folder}/products")
    base.select(
        F.to_date(moment).alias("event_date"), moment.alias("event_datetime"),
        F.when(F.col("id") % 4 == 0, "purchase").otherwise("view_item").alias("event_name"),
        pid.alias("user_pseudo_id"),
        F.when(F.col("id") % 3 == 0, "C").when(F.col("id") % 7 == 0, "C").otherwise("D")
        .alias("country"),
        F.lit(None).cast("string").alias("traffic_medium"),
        F.lit(None).cast("string").alias("traffic_source"),
        F.lit(None).cast("string").alias("campaign_name"),
        F.concat(F.lit("t"), F.col("id") % 1000).alias("transaction_id"),
        (F.col("id") % 13).cast("double").alias("total_purchase_revenue"),
    ).write.parquet(f"{folder}/events")
    return spark.read.parquet(f"{folder}/products"), spark.read.parquet(f"{folder}/events")


@pytest.fixture(scope="module")
def expected(hot_tables):
    """The product rows that must match, found with plain Python sets."""
    products, events = hot_tables
    keys = {(r["user_pseudo_id"], r["event_datetime"]) for r in dicts(events)
            if r["country"] == "C"}
    rows = [r for r in dicts(products) if r["event_name"] == "purchase"
            and (r["user_pseudo_id"], r["event_datetime"]) in keys]
    assert sum(r["user_pseudo_id"] == "hot" for r in rows) > len(rows) / 2
    return rows


def _sorted(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


def test_rows_of_a_hot_key(spark, hot_tables, expected):
    products, events = hot_tables
    with shuffled(spark):
        found = semijoin.filter_products_by_events(products, events, AUDIENCE)
        assert _sorted(dicts(found)) == _sorted(expected)


def test_hot_key_is_split_between_tasks(spark, hot_tables, expected):
    products, events = hot_tables
    with shuffled(spark), settings(
            spark, spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
            spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
            spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB"):
        found = semijoin.filter_products_by_events(products, events, AUDIENCE)
        assert _sorted(dicts(found)) == _sorted(expected)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan


def test_totals_of_a_hot_key(spark, hot_tables, expected):
    products, events = hot_tables
    revenue, quantity = defaultdict(float), defaultdict(int)
    for r in expected:
        revenue[r["item_category"]] += r["item_total_revenue"]
        quantity[r["item_name"]] += r["item_quantity"]
    with shuffled(spark):
        top = dicts(product_report.category_revenue(products, events, AUDIENCE))
        assert [(r["category"], r["revenue"]) for r in top] == sorted(
            revenue.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        items = dicts(product_report.top_items(products, events, AUDIENCE))
        assert [(r["item"], r["qty"]) for r in items] == sorted(
            quantity.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        total = product_report.product_total(products, events, AUDIENCE)
        assert only(total)["total"] == len(expected)


@pytest.mark.parametrize("number, size", [(0, 20), (1, 20), (3, 300), (5, 500), (99, 500)])
def test_pages_reach_into_a_hot_key(spark, hot_tables, expected, number, size):
    products, events = hot_tables
    shown = "event_date event_name item_id item_name item_brand item_category item_price " \
            "item_quantity item_total_revenue".split()

    def ahead(r):
        return (-r["event_datetime"].timestamp(), *[r[c] for c in shown])

    wanted = sorted(expected, key=ahead)[number * size:(number + 1) * size]
    with shuffled(spark):
        page = dicts(product_report.products_page(products, events, AUDIENCE, number, size))
    assert [[str(r[c]) for c in shown] for r in page] == [
        [str(r[c]) for c in shown] for r in wanted]
    assert {r["page_count"] for r in page} <= {-(-len(expected) // size)}


def test_rows_are_thinned_before_the_shuffle(spark, hot_tables):
    products, events = hot_tables
    with shuffled(spark):
        page = semijoin.leading_by_events(products, events, AUDIENCE, [F.asc("item_id")], 20)
        plan = page._jdf.queryExecution().executedPlan().toString()
        shuffles = _shuffles(page._jdf.queryExecution().executedPlan())
    partial = plan.index("WindowGroupLimit", plan.index("row_number(), 20, Final"))
    assert "row_number(), 20, Partial" in plan[partial:]
    assert shuffles == 2                    # one per side: the join needs no other


def _shuffles(node):
    """Shuffles of a plan that was not run yet, those of its scalar subqueries left out."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _shuffles(node.initialPlan())
    children = node.children()
    return (node.nodeName() == "Exchange") + sum(
        _shuffles(children.apply(i)) for i in range(children.size()))


def test_people_and_orders_of_a_hot_person(spark, hot_tables):
    _, events = hot_tables
    rows = dicts(events)
    spec = FilterSpec(start="2023-12-31", end="2024-01-01")
    inside = [r for r in rows if str(spec.start) <= str(r["event_date"]) <= str(spec.end)]
    found = only(event_report.kpi(events, spec))
    assert found["events"] == len(inside)
    assert found["users"] == len({r["user_pseudo_id"] for r in inside})
    assert found["transactions"] == len({r["transaction_id"] for r in inside})
    assert found["revenue"] == sum(r["total_purchase_revenue"] for r in inside)
    done = defaultdict(set)
    for r in rows:
        done[r["user_pseudo_id"]].add(r["event_name"])
    funnel = only(event_report.funnel(events, FilterSpec(), ["view_item", "purchase"]))
    assert funnel == {"view_item": sum("view_item" in d for d in done.values()),
                      "purchase": sum({"view_item", "purchase"} <= d for d in done.values())}


def test_first_event_and_rollup_of_a_hot_person(spark):
    raw = scattered(spark, ROWS).select(
        F.col("id").alias("event_id"), (F.lit(10_000_000) - F.col("id") % 100).alias("event_timestamp"),
        F.when(F.col("id") % 2 == 0, "first_visit").otherwise("purchase").alias("event_name"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 400))
        .alias("user_pseudo_id"),
        F.struct(F.lit(1.0).alias("purchase_revenue_in_usd"),
                 F.concat(F.lit("t"), F.col("id") % 500).alias("transaction_id")).alias("ecommerce"))
    rows = dicts(raw)
    first, orders, revenue = {}, defaultdict(set), defaultdict(float)
    for r in rows:
        who = r["user_pseudo_id"]
        if r["event_name"] == "first_visit":
            first[who] = min(first.get(who, (9e9, 0)), (r["event_timestamp"], r["event_id"]))
        else:
            orders[who].add(r["ecommerce"]["transaction_id"])
            revenue[who] += 1.0
    found = newusers.first_event_per_user(raw, "first_visit", ["event_id"])
    assert {r["user_pseudo_id"]: (r["event_timestamp"], r["event_id"]) for r in dicts(found)} == first
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"row_number\(\), 1, Final[\s\S]*Exchange[\s\S]*row_number\(\), 1, Partial", plan)
    rollup = newusers.purchase_rollup(raw)
    assert {r["user_pseudo_id"]: (r["purchase_count"], r["purchase_revenue_total"])
            for r in dicts(rollup)} == {w: (len(orders[w]), revenue[w]) for w in orders}
