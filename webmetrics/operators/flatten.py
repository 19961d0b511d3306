"""Nested records to flat rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.scalar import from_micros, line_total, parse_day
from webmetrics.schema import (
    EVENT_COLUMNS,
    EVENT_PATHS,
    ITEM_FIELDS,
    PRODUCT_COLUMNS,
    WIDE_EVENT_COLUMNS,
    WIDE_PRODUCT_COLUMNS,
)


def event_column(name: str) -> Column:
    """A flat event column computed from the nested record."""
    if name == "event_date":
        return parse_day("event_date").alias(name)
    if name == "event_datetime":
        return from_micros("event_timestamp").alias(name)
    return F.col(EVENT_PATHS.get(name, name)).alias(name)


def _item_fields(name: str) -> list[str]:
    """The fields of an item that a flat product column needs."""
    if name == "item_total_revenue":
        return ["price", "quantity"]
    if name in ITEM_FIELDS or name.startswith("item_") or name == "location_id":
        return [ITEM_FIELDS.get(name, name)]
    return []


def _item_column(name: str, item: Callable[[str], Column]) -> Column:
    fields = [item(field) for field in _item_fields(name)]
    if not fields:
        return F.col(name)
    return (line_total(*fields) if len(fields) == 2 else fields[0]).alias(name)


def flatten_events(raw: DataFrame, wide: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event. ``keep`` names extra raw columns to carry along.

    Only the nested leaves that are used reach the scan.
    """
    columns = WIDE_EVENT_COLUMNS if wide else EVENT_COLUMNS
    return raw.select(*map(event_column, columns), *keep)


def explode_items(raw: DataFrame, wide: bool = False, keep: Sequence[str] = (),
                  by_field: bool = False) -> DataFrame:
    """One row per item; records whose item list is empty or NULL disappear.

    ``by_field`` says that ``raw`` has each field's list as a column of its own, too (items_price
    and so on), and their length as items_size. Places in the lists are exploded, not items: Spark
    keeps all fields of a struct that it explodes, and with them, through all joins below, every
    column that one is computed from.
    """
    columns = WIDE_PRODUCT_COLUMNS if wide else PRODUCT_COLUMNS
    fields = sorted({field for name in columns for field in _item_fields(name)})
    size = F.col("items_size") if by_field else F.size("items.item_id")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    # Lengths of their own are cheap: Spark takes this filter below the joins.
    lists = (raw.where(size > 0) if by_field else raw).select(
        event_column("event_date"), "user_pseudo_id", event_column("event_datetime"), "event_name",
        F.explode(places).alias("item_place"),
        *[F.col(f"items_{f}" if by_field else f"items.{f}").alias(f"items_{f}") for f in fields], *keep,
    )

    def item(field: str) -> Column:
        return F.get(F.col(f"items_{field}"), F.col("item_place"))

    return lists.select(*[_item_column(name, item) for name in columns], *keep)


def prune(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
