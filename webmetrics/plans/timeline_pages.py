"""Pages of the event and product tables, latest first, from tables stored in order of time.

A page reads the latest stretches only. The number of pages is a question of its own, which has to
look at all rows, so it is asked apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webmetrics.functions.predicates import event_filter
from webmetrics.operators.measures import count_rows
from webmetrics.operators.ordering import PAGE_SIZE, Cursor, behind, page_count, portable_keys
from webmetrics.operators.semijoin import filter_products_by_events
from webmetrics.operators.timeline import ROWS_PER_STRETCH, STRETCH, Timeline, cut_into_stretches, describe
from webmetrics.plans import event_table, product_report
from webmetrics.schema import EVENT_TABLE_COLUMNS, PRODUCT_TABLE_COLUMNS, STORED_COLUMNS
from webmetrics.sources.sink import StoreLayout, times_with_statistics
from webmetrics.sources.versions import write_version
from webmetrics.spec import FilterSpec

_SPREAD = {"events": EVENT_TABLE_COLUMNS, "products": PRODUCT_TABLE_COLUMNS}


def store_timeline(rows: DataFrame, name: str, layout: StoreLayout = StoreLayout(),
                   rows_per_stretch: int = ROWS_PER_STRETCH) -> Timeline:
    """Store ``events`` or ``products`` in order of time, as ``<name>_timeline`` with its index."""
    spark, folder = rows.sparkSession, layout.folder(rows.sparkSession)
    stored = rows.select(*STORED_COLUMNS[name])
    times_with_statistics(spark)
    cut = cut_into_stretches(stored, stored.count(), rows_per_stretch, _SPREAD[name])
    data = write_version(cut, layout.table(f"{name}_timeline"), folder, [STRETCH])
    index = write_version(describe(data.rows()).coalesce(1), layout.table(f"{name}_stretches"), folder)
    data.switch()
    index.switch()
    return open_timeline(spark, name, layout)


def open_timeline(spark: SparkSession, name: str, layout: StoreLayout = StoreLayout()) -> Timeline:
    return Timeline(spark.table(layout.table(f"{name}_timeline")), spark.table(layout.table(f"{name}_stretches")))


def _reach(cursor: Cursor | None) -> tuple[int, int | None]:
    """Rows to skip behind a cursor, and its moment (the first sort value)."""
    return (cursor.shown, cursor.values[0]) if cursor else (0, None)


def events_page(events: Timeline, spec: FilterSpec, number: int | None = 0, size: int = PAGE_SIZE) -> DataFrame:
    """As ``event_table.events_page`` in its default order, but for the page count."""
    rows, _ = events.latest(
        ((number or 0) + 1) * size, lambda some, _: some.where(event_filter(spec)), spec.start, spec.end)
    return event_table.events_page_rows(rows, spec, None, number, size)


def events_page_after(events: Timeline, spec: FilterSpec, cursor: Cursor | None = None,
                      size: int = PAGE_SIZE) -> DataFrame:
    """As ``event_table.events_page_after`` in its default order."""
    shown, moment = _reach(cursor)
    keys = event_table.event_keys()
    _, typed = portable_keys(events.rows, keys, cursor)
    rows, _ = events.latest(
        size + shown, lambda some, _: behind(some.where(event_filter(spec)), keys, typed), spec.start, spec.end, moment)
    return event_table.events_page_after(rows, spec, cursor, None, size)


def _bought(products: Timeline, events: Timeline | None, spec: FilterSpec, count: int,
            keep=lambda rows: rows, moment: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The latest products that hold a page, and the events of their time."""
    def match(some: DataFrame, since: int) -> DataFrame:
        return keep(filter_products_by_events(some, events and events.since(since), spec))

    rows, since = products.latest(count, match, spec.start, spec.end, moment)
    if events is None:
        return rows, None
    return rows, events.rows if since is None else events.since(since)


def products_page(products: Timeline, events: Timeline | None, spec: FilterSpec, number: int | None = 0,
                  size: int = PAGE_SIZE) -> DataFrame:
    """As ``product_report.products_page``, but for the page count."""
    rows, seen = _bought(products, events, spec, ((number or 0) + 1) * size)
    return product_report.products_page_rows(rows, seen, spec, number, size)


def products_page_after(products: Timeline, events: Timeline | None, spec: FilterSpec,
                        cursor: Cursor | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """As ``product_report.products_page_after``."""
    shown, moment = _reach(cursor)
    keys = product_report.product_keys()
    _, typed = portable_keys(products.rows, keys, cursor)
    rows, seen = _bought(products, events, spec, size + shown, lambda some: behind(some, keys, typed), moment)
    return product_report.products_page_after(rows, seen, spec, cursor, size)


def event_pages(events: DataFrame, spec: FilterSpec, size: int = PAGE_SIZE) -> DataFrame:
    """(total, page_count) of the filtered events: one row."""
    total = count_rows(events.where(event_filter(spec)), "total")
    return total.select("total", page_count(total["total"], size).alias("page_count"))


def product_pages(products: DataFrame, events: DataFrame | None, spec: FilterSpec, size: int = PAGE_SIZE) -> DataFrame:
    """(total, page_count) of the filtered products: one row."""
    total = product_report.product_total(products, events, spec)
    return total.select("total", page_count(total["total"], size).alias("page_count"))
