"""Semi-joins on co-located tables: the rows of the plain form, no shuffle, hot pairs in several tasks."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import frames
from tests.test_plans import plan_of
from tests.test_skew import shuffled
from tests.test_sources import database  # noqa: F401  (a fixture)
from webmetrics.operators.semijoin import filter_products_by_events
from webmetrics.plans import colocated, product_report
from webmetrics.sources import sink
from webmetrics.spec import FilterSpec

NOON = datetime(2024, 1, 1, 12)
SPECS = [
    FilterSpec(), FilterSpec(mediums=("", "cpc")), FilterSpec(countries=("A",), start="2024-01-02", end="2024-01-03"),
    FilterSpec(keyword="goo", categories=("c1",)), FilterSpec(countries=("nowhere",)),
]


def tables(spark, seed=1, hot=300):
    rng = random.Random(seed)

    def key():
        if rng.random() < 0.05:
            return {"user_pseudo_id": rng.choice([None, "u1"]), "event_datetime": rng.choice([None, NOON])}
        return {"user_pseudo_id": f"u{rng.randrange(6)}", "event_datetime": NOON + timedelta(hours=rng.randrange(5))}

    def bought():
        return {"event_date": (NOON + timedelta(days=rng.randrange(4))).date(), "item_id": str(rng.randrange(9)),
                "item_name": rng.choice(["pen", "ink", None, "", "(not set)"]), "item_category": rng.choice(["c1", "c2", "", None]),
                "item_quantity": rng.choice([None, 1, 2]), "item_total_revenue": rng.choice([None, 0.5, 2.0])}

    pr = [{**key(), **bought()} for _ in range(400)]
    pr += [{"user_pseudo_id": "hot", "event_datetime": NOON, **bought()} for _ in range(hot)]
    seen = [{**key(), "traffic_medium": rng.choice([None, "", "cpc", "x"]), "country": rng.choice([None, "A", "B"]),
             "traffic_source": rng.choice([None, "Google"])} for _ in range(60)]
    seen += [{"user_pseudo_id": "hot", "event_datetime": NOON, "country": c} for c in ("A", "A", "B")]
    return frames.products(spark, *pr), frames.events(spark, *seen)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("rows_per_salt", [50, 10_000])
def test_same_rows_as_the_plain_join(spark, database, rows_per_salt):  # noqa: F811
    products, events = tables(spark)
    store = colocated.store_colocated(products, events, 4, sink.StoreLayout(database=database), rows_per_salt)
    for spec in SPECS:
        assert rows(store.filter(spec)) == rows(filter_products_by_events(products, events, spec))
        assert rows(colocated.category_revenue(store, spec)) == rows(product_report.category_revenue(products, events, spec))
        assert rows(colocated.top_items(store, spec)) == rows(product_report.top_items(products, events, spec))


def test_join_needs_no_exchange(spark, database):  # noqa: F811
    products, events = tables(spark)
    store = colocated.store_colocated(products, events, 4, sink.StoreLayout(database=database), 50)
    with shuffled(spark):
        plan = plan_of(store.filter(SPECS[1]))
        assert "SortMergeJoin" in plan and "LeftSemi" in plan
        assert "Exchange" not in plan
        plain = plan_of(filter_products_by_events(products, events, SPECS[1]))
        assert plain.count("Exchange") >= 2
        totals = plan_of(colocated.category_revenue(store, SPECS[1]))
        assert totals.count("Exchange") == 1 and "partial_sum" in totals  # that of the sums
    sizes = [s for s in re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)]
    assert sizes == [("4", "4"), ("4", "4")]


def test_a_hot_pair_is_dealt_to_many_buckets(spark, database):  # noqa: F811
    products, events = tables(spark, hot=4000)
    store = colocated.store_colocated(products, events, 16, sink.StoreLayout(database=database), 100)
    with shuffled(spark):
        found = store.filter(FilterSpec(countries=("A",)))
        tasks = found.where("user_pseudo_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    wanted = products.where("user_pseudo_id = 'hot' AND item_name IN ('pen', 'ink')").count()
    assert sum(r["count"] for r in tasks) == wanted
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < wanted / 3


def test_no_rows(spark, database):  # noqa: F811
    products, events = tables(spark)
    store = colocated.store_colocated(products.where("false"), events.where("false"), 3, sink.StoreLayout(database=database))
    assert store.filter(SPECS[0]).count() == store.filter(SPECS[1]).count() == 0
