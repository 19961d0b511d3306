"""The sorted, paged event table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import event_filter
from webmetrics.functions.scalar import iso_text, money, named, or_else, time_text
from webmetrics.operators.measures import count_rows
from webmetrics.operators.ordering import (
    PAGE_SIZE,
    Cursor,
    behind,
    directed,
    order_by,
    page,
    page_after,
    page_count,
    portable_keys,
    reaching,
)
from webmetrics.schema import DASH, DIRECT, EVENT_TABLE_COLUMNS
from webmetrics.spec import FilterSpec, sort_keys


def event_display() -> dict[str, Column]:
    """What the event table shows, by column."""
    return {
        "event_date": iso_text("event_date"),
        "event_datetime": time_text("event_datetime"),
        "event_name": F.col("event_name"),
        "country": or_else("country", DASH),
        "device_type": or_else("device_type", DASH),
        "traffic_medium": named("traffic_medium", DIRECT),
        "traffic_source": named("traffic_source", DASH),
        "campaign_name": named("campaign_name", DASH),
        "transaction_id": or_else("transaction_id", DASH),
        "total_purchase_revenue": money(or_else("total_purchase_revenue", F.lit(0.0))),
    }


def display_events(events: DataFrame) -> DataFrame:
    return events.select(*[c.alias(n) for n, c in event_display().items()])


def event_keys(sort: Iterable[Mapping[str, str]] | None = None) -> list[tuple[Column, bool]]:
    """(column, ascending) keys that put events in a definite order.

    Requested keys compare what is shown (the time of day, the placeholders); without any,
    the latest event comes first. Equal rows follow the table's stored columns.
    """
    asked = order_by(sort_keys(sort, EVENT_TABLE_COLUMNS), event_display(),
                     default=[(F.col("event_datetime"), False)])
    return [*asked, *[(F.col(c), True) for c in EVENT_TABLE_COLUMNS]]


def _candidates(rows: DataFrame, sort: Iterable[Mapping[str, str]] | None,
                count: int) -> DataFrame:
    """Rows a page can show. Only the default order starts with a stored column."""
    if sort_keys(sort, EVENT_TABLE_COLUMNS):
        return rows
    return reaching(rows, F.col("event_datetime"), False, count)


def events_page(events: DataFrame, spec: FilterSpec,
                sort: Iterable[Mapping[str, str]] | None = None, number: int | None = 0,
                size: int = PAGE_SIZE) -> DataFrame:
    """A page of the filtered events, with the page count on each row.

    Only sort keys are computed for all rows; the display columns only for the page.
    """
    rows = events.where(event_filter(spec))
    pages = page_count(count_rows(rows, "total").scalar(), size)
    return events_page_rows(events, spec, sort, number, size).withColumn("page_count", pages)


def events_page_rows(events: DataFrame, spec: FilterSpec,
                     sort: Iterable[Mapping[str, str]] | None = None, number: int | None = 0,
                     size: int = PAGE_SIZE) -> DataFrame:
    """The page alone, without counting all pages."""
    order = [directed(c, ascending) for c, ascending in event_keys(sort)]
    near = _candidates(events.where(event_filter(spec)), sort, ((number or 0) + 1) * size)
    return display_events(page(near, order, number, size))


def events_page_after(events: DataFrame, spec: FilterSpec, cursor: Cursor | None = None,
                      sort: Iterable[Mapping[str, str]] | None = None,
                      size: int = PAGE_SIZE) -> DataFrame:
    """The page behind a cursor, with a ``sort_values`` struct on each row.

    ``Cursor.after([r.sort_values for r in rows], cursor)`` leads to the following page.
    """
    keys = event_keys(sort)
    values, cursor = portable_keys(events, keys, cursor)
    rest = behind(events.where(event_filter(spec)), keys, cursor)
    near = _candidates(rest, sort, size + (cursor.shown if cursor else 0))
    return page_after(near, keys, cursor, size).select(
        *[c.alias(n) for n, c in event_display().items()], values)
