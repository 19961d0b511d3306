"""Filters as boolean Columns. Values become literals, so no text can alter a query."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webmetrics.functions.scalar import ColumnLike, col
from webmetrics.schema import NOT_SET
from webmetrics.spec import Day, FilterSpec, as_day

KEYWORD_COLUMNS = ("campaign_name", "traffic_source", "country")


def f_in(c: ColumnLike, values: Iterable[str]) -> Column:
    """NULL never matches."""
    return col(c).isin(*values)


def f_medium(c: ColumnLike, values: Iterable[str]) -> Column:
    """The empty option stands for both '' and NULL.

    Written so that a list without the empty option is a plain IN, which the Parquet reader
    can use to skip row groups.
    """
    values = list(values)
    known = f_in(c, values)
    return (known | col(c).isNull()) if "" in values else known


def f_keyword(keyword: str, *columns: ColumnLike) -> Column:
    """Case-insensitive substring in any column; % and _ are wildcards, a backslash is not."""
    pattern = "%" + keyword.strip().replace("\\", "\\\\") + "%"
    return reduce(Column.__or__, [col(c).ilike(pattern) for c in columns])


def f_date(c: ColumnLike, start: Day = None, end: Day = None) -> Column:
    """Inclusive range, either bound optional."""
    start, end = as_day(start), as_day(end)
    parts = []
    if start is not None:
        parts.append(col(c) >= F.lit(start))
    if end is not None:
        parts.append(col(c) <= F.lit(end))
    return all_of(parts)


def non_empty(c: ColumnLike) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def all_of(parts: Iterable[Column]) -> Column:
    """Conjunction; nothing to check means everything passes."""
    return reduce(Column.__and__, parts, F.lit(True))


def _audience(spec: FilterSpec) -> list[Column]:
    parts = []
    if spec.mediums:
        parts.append(f_medium("traffic_medium", spec.mediums))
    if spec.countries:
        parts.append(f_in("country", spec.countries))
    if spec.keyword:
        parts.append(f_keyword(spec.keyword, *KEYWORD_COLUMNS))
    return parts


def audience_filter(spec: FilterSpec) -> Column:
    """Medium, country and keyword: what a product report asks of the event row."""
    return all_of(_audience(spec))


def event_filter(spec: FilterSpec) -> Column:
    parts = _audience(spec)
    if spec.event_names:
        parts.append(f_in("event_name", spec.event_names))
    parts.append(f_date("event_date", spec.start, spec.end))
    return all_of(parts)


def newuser_filter(spec: FilterSpec) -> Column:
    """Event names and categories say nothing about a person, so they are left out."""
    return all_of([*_audience(spec), f_date("first_visit_date", spec.start, spec.end)])


def product_filter(spec: FilterSpec) -> Column:
    """Purchased items with a real name, in the date range and categories."""
    parts = [
        F.col("event_name") == "purchase",
        F.col("item_name").isNotNull(),
        ~F.col("item_name").isin("", NOT_SET),
        f_date("event_date", spec.start, spec.end),
    ]
    if spec.categories:
        parts.append(f_in("item_category", spec.categories))
    return all_of(parts)
