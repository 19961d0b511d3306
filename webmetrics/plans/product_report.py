"""Product reports over purchased items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.scalar import iso_text, money, named, or_else
from webmetrics.operators.ordering import (
    PAGE_SIZE,
    Cursor,
    behind,
    directed,
    page,
    page_after,
    page_count,
    portable_keys,
    top_k,
)
from webmetrics.operators.semijoin import leading_by_events, totals_by_events
from webmetrics.schema import DASH, PRODUCT_TABLE_COLUMNS, UNCATEGORISED
from webmetrics.spec import FilterSpec


def category_revenue(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                     n: int = 5, uncategorised: str = UNCATEGORISED) -> DataFrame:
    """The n categories with the largest positive revenue."""
    totals = totals_by_events(products, events, spec, [named("item_category", uncategorised)],
                              F.col("item_total_revenue"), "revenue")
    sold = totals.where(F.col("revenue") > 0).withColumnRenamed("by_0", "category")
    return top_k(sold, [F.desc("revenue"), F.asc_nulls_last("category")], n)


def top_items(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
              n: int = 10) -> DataFrame:
    """The n items sold most often; an unnamed item goes by its id."""
    totals = totals_by_events(products, events, spec,
                              [named("item_name", F.col("item_id"))],
                              F.col("item_quantity"), "qty")
    sold = totals.where(F.col("qty") > 0).withColumnRenamed("by_0", "item")
    return top_k(sold, [F.desc("qty"), F.asc_nulls_last("item")], n)


def product_display(uncategorised: str = UNCATEGORISED) -> dict[str, Column]:
    """What the product table shows, by column."""
    return {
        "event_date": iso_text("event_date"),
        "event_name": F.col("event_name"),
        "item_id": or_else("item_id", DASH),
        "item_name": named("item_name", F.col("item_id")),
        "item_brand": or_else("item_brand", DASH),
        "item_category": named("item_category", uncategorised),
        "item_price": money(or_else("item_price", F.lit(0.0))),
        "item_quantity": or_else("item_quantity", F.lit(0)),
        "item_total_revenue": money(or_else("item_total_revenue", F.lit(0.0))),
    }


def display_products(products: DataFrame, uncategorised: str = UNCATEGORISED) -> DataFrame:
    return products.select(*[c.alias(n) for n, c in product_display(uncategorised).items()])


def product_total(products: DataFrame, events: DataFrame | None,
                  spec: FilterSpec) -> DataFrame:
    """Number of product rows under the filter."""
    total = totals_by_events(products, events, spec, [], F.lit(1), "total")
    return total.select(F.coalesce("total", F.lit(0)).alias("total"))


def products_page(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                  number: int | None = 0, size: int = PAGE_SIZE,
                  uncategorised: str = UNCATEGORISED) -> DataFrame:
    """A page of purchased items, latest first, with the page count on each row.

    Rows with the same time follow the order of the table's columns.
    """
    pages = page_count(product_total(products, events, spec).scalar(), size)
    return products_page_rows(products, events, spec, number, size, uncategorised).withColumn("page_count", pages)


def products_page_rows(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                       number: int | None = 0, size: int = PAGE_SIZE,
                       uncategorised: str = UNCATEGORISED) -> DataFrame:
    """The page alone, without counting all pages."""
    same_time = [F.asc_nulls_last(c) for c in PRODUCT_TABLE_COLUMNS]
    rows = leading_by_events(products, events, spec, same_time, ((number or 0) + 1) * size)
    wanted = page(rows, [F.desc_nulls_last("event_datetime"), *same_time], number, size)
    return display_products(wanted, uncategorised)


def product_keys() -> list[tuple[Column, bool]]:
    """(column, ascending) keys that put products in a definite order, latest first."""
    return [(F.col("event_datetime"), False), *[(F.col(c), True) for c in PRODUCT_TABLE_COLUMNS]]


def products_page_after(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                        cursor: Cursor | None = None, size: int = PAGE_SIZE,
                        uncategorised: str = UNCATEGORISED) -> DataFrame:
    """The page behind a cursor, latest first, with a ``sort_values`` struct on each row.

    Nothing is counted: rows before the cursor drop out in the scan of the products, so a page
    costs the same at any depth. ``Cursor.after([r.sort_values for r in rows], cursor)`` leads
    to the following page.
    """
    keys = product_keys()
    values, cursor = portable_keys(products, keys, cursor)
    same_time = [directed(c, ascending) for c, ascending in keys[1:]]
    reach = size + (cursor.shown if cursor else 0)
    near = leading_by_events(behind(products, keys, cursor), events, spec, same_time, reach)
    shown = [c.alias(n) for n, c in product_display(uncategorised).items()]
    return page_after(near, keys, cursor, size).select(*shown, values)


def product_report(products: DataFrame, events: DataFrame | None,
                   spec: FilterSpec) -> dict[str, DataFrame]:
    return {
        "category_revenue": category_revenue(products, events, spec),
        "top_items": top_items(products, events, spec),
        "products_page": products_page(products, events, spec),
    }
