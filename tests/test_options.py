"""All options from one scan of each table."""

from tests import frames
from tests.test_plans import final_plan, scans
from webmetrics.plans import options


def rows(df):
    return sorted(map(repr, df.collect()))


def test_one_scan_for_each_table(spark, tmp_path):
    frames.events(spark, {"country": "A", "traffic_medium": " "}, {"traffic_medium": ""}, {}).write.parquet(str(tmp_path / "events"))
    frames.products(spark, {"item_category": "c"}).write.parquet(str(tmp_path / "products"))
    events, products = (spark.read.parquet(str(tmp_path / n)) for n in ("events", "products"))
    found = options.filter_options_in_one_scan(events, products)
    plan = final_plan(found)
    assert sorted(len(s.split(",")) for s in scans(plan)) == [2, 4]
    assert "partial_count" in plan
    assert rows(found) == rows(options.filter_options(events, products))


def test_missing_values_and_no_rows(spark):
    nothing = {"country": None, "event_name": None, "traffic_medium": None, "event_date": None}
    events = frames.events(spark, nothing, {**nothing, "country": "A"}, {**nothing, "event_name": "x"}, {**nothing, "traffic_medium": ""})
    products = frames.products(spark, {"item_category": "c"}, {"item_category": ""}, {"item_category": None})
    for e in (events, events.where("false"), events.where("country = 'A'")):
        for p in (products, products.where("false")):
            assert rows(options.filter_options_in_one_scan(e, p)) == rows(options.filter_options(e, p))
