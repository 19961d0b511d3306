"""Pages from tables stored in order of time: the rows of the plain pages, and only the stretches they need."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import frames
from tests.test_sources import database  # noqa: F401  (a fixture)
from webmetrics.operators.ordering import Cursor
from webmetrics.plans import event_table, product_report, timeline_pages
from webmetrics.sources import sink
from webmetrics.spec import FilterSpec

START = datetime(2024, 1, 1)


def event_rows(rng, count, hours=200):
    return [{
        "event_datetime": rng.choice([None, *[START + timedelta(hours=rng.randrange(hours))] * 9]),
        "event_date": rng.choice([None, *[(START + timedelta(days=rng.randrange(10))).date()] * 9]),
        "event_name": rng.choice(["a", "b"]), "user_pseudo_id": f"u{rng.randrange(4)}",
        "country": rng.choice([None, "A", "A", "B"] + ["rare"] * (rng.random() < 0.02)), "traffic_medium": rng.choice([None, "cpc"]),
    } for _ in range(count)]


def product_rows(rng, count, hours=200):
    return [{
        "event_datetime": rng.choice([None, *[START + timedelta(hours=rng.randrange(hours))] * 9]),
        "event_date": (START + timedelta(days=rng.randrange(10))).date(), "user_pseudo_id": f"u{rng.randrange(4)}",
        "item_id": str(rng.randrange(30)), "item_name": rng.choice(["pen", "ink", ""]), "item_quantity": rng.randrange(5),
    } for _ in range(count)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    same_time = [{**r, "event_datetime": START + timedelta(hours=150)} for r in event_rows(rng, 150)]
    return (frames.events(spark, *event_rows(rng, 500), *same_time).cache(),
            frames.products(spark, *product_rows(rng, 400)).cache())


@pytest.fixture()
def lines(tables, database):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    return [timeline_pages.store_timeline(df, name, layout, 25) for df, name in zip(tables, ("events", "products"))]


def shown(df):
    return [tuple(r) for r in df.drop("page_count").collect()]


EVENT_SPECS = [FilterSpec(), FilterSpec(countries=("rare",)), FilterSpec(start="2024-01-03", end="2024-01-05", mediums=("",)), FilterSpec(countries=("none",))]
PRODUCT_SPECS = [FilterSpec(), FilterSpec(countries=("rare",)), FilterSpec(mediums=("cpc",), start="2024-01-02", end="2024-01-04")]


def test_pages_equal_the_plain_ones(tables, lines):
    (events, products), (seen, bought) = tables, lines
    assert seen.index.count() > 10
    for spec in EVENT_SPECS:
        for number, size in ((0, 20), (3, 7), (0, 700)):
            assert shown(timeline_pages.events_page(seen, spec, number, size)) == shown(event_table.events_page(events, spec, None, number, size))
    for spec in PRODUCT_SPECS:
        for number, size in ((0, 20), (2, 9)):
            assert shown(timeline_pages.products_page(bought, seen, spec, number, size)) == shown(
                product_report.products_page(products, events, spec, number, size))
    assert shown(timeline_pages.products_page(bought, None, FilterSpec(), 1)) == shown(product_report.products_page(products, None, FilterSpec(), 1))


def test_cursors_visit_all_rows(tables, lines):
    (events, products), (seen, bought) = tables, lines
    for plain, paged, size in (
        (lambda c, n: event_table.events_page_after(events, EVENT_SPECS[2], c, None, n), lambda c, n: timeline_pages.events_page_after(seen, EVENT_SPECS[2], c, n), 11),
        (lambda c, n: product_report.products_page_after(products, events, PRODUCT_SPECS[2], c, n),
         lambda c, n: timeline_pages.products_page_after(bought, seen, PRODUCT_SPECS[2], c, n), 5),
    ):
        wanted = [tuple(r) for r in plain(None, 10_000).collect()]
        found, cursor = [], None
        while rows := paged(cursor, size).collect():
            found += map(tuple, rows)
            cursor = Cursor.after([r.sort_values for r in rows], cursor)
        assert found == wanted and len(found) > 2 * size


def test_page_counts(tables):
    events, products = tables
    for spec in EVENT_SPECS:
        (row,) = timeline_pages.event_pages(events, spec).collect()
        assert row["page_count"] == max(1, -(-row["total"] // 20)) and row["total"] == len(shown(event_table.events_page(events, spec, None, 0, 10_000)))
    (row,) = timeline_pages.product_pages(products, events, PRODUCT_SPECS[2], 5).collect()
    assert row["page_count"] == product_report.products_page(products, events, PRODUCT_SPECS[2], 0, 5).first()["page_count"]


def test_only_the_latest_files_are_opened(spark, database, tmp_path):  # noqa: F811
    """Files of earlier stretches may be unreadable, whatever their number."""
    layout = sink.StoreLayout(database=database)
    rng = random.Random(2)
    opened = {}
    for count in (1000, 4000):
        events = frames.events(spark, *[{**r, "event_datetime": START + timedelta(minutes=k)} for k, r in enumerate(event_rows(rng, count))])
        products = frames.products(spark, *[{**r, "event_datetime": START + timedelta(minutes=k)} for k, r in enumerate(product_rows(rng, count))])
        lines = [timeline_pages.store_timeline(df, name, layout, 100) for df, name in ((events, "events"), (products, "products"))]
        wanted = shown(event_table.events_page(events, FilterSpec(countries=("A",)), None, 1))
        sold = shown(product_report.products_page(products, events, FilterSpec(mediums=("cpc",))))
        last = max(int(p.name.split("=")[1]) for p in tmp_path.rglob("stretch=*"))
        for folder in tmp_path.rglob("stretch=*"):
            if int(folder.name.split("=")[1]) < last - 4:
                for file in Path(folder).glob("*.parquet"):
                    file.write_bytes(b"not to be opened")
        assert shown(timeline_pages.events_page(lines[0], FilterSpec(countries=("A",)), 1)) == wanted
        assert shown(timeline_pages.products_page(lines[1], lines[0], FilterSpec(mediums=("cpc",)))) == sold
        rows, _ = lines[0].latest(20, lambda some, _: some)
        opened[count] = rows.select("stretch").distinct().count()
    assert opened[1000] == opened[4000] <= 3


def test_no_rows(spark, database, tables):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    none = [timeline_pages.store_timeline(df.where("false"), name, layout) for df, name in zip(tables, ("events", "products"))]
    assert timeline_pages.events_page(none[0], FilterSpec()).count() == 0
    assert timeline_pages.products_page(none[1], none[0], FilterSpec(mediums=("cpc",))).count() == 0
