"""Values offered by the filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import non_empty
from webmetrics.functions.scalar import medium_label
from webmetrics.operators.measures import (
    DEFAULT_DAYS,
    date_bounds,
    medium_options,
    options_by_frequency,
)
from webmetrics.schema import DIRECT


def country_options(events: DataFrame, ordered: bool = True) -> DataFrame:
    return options_by_frequency(events, "country", F.col("country").isNotNull(), ordered)


def event_name_options(events: DataFrame, ordered: bool = True) -> DataFrame:
    return options_by_frequency(events, "event_name", None, ordered)


def category_options(products: DataFrame, ordered: bool = True) -> DataFrame:
    """From purchases only: that is what the category filter is applied to."""
    bought = F.col("event_name") == "purchase"
    return options_by_frequency(products, "item_category",
                                bought & non_empty("item_category"), ordered)


def filter_options(events: DataFrame, products: DataFrame,
                   direct: str = DIRECT) -> DataFrame:
    """All option lists and the date range as (field, value, label, cnt), in no order.

    Each part scans just the column it lists. Sort a field by ``cnt`` descending.
    """
    no_count = F.lit(None).cast("long").alias("cnt")

    def listed(field: str, values: DataFrame) -> DataFrame:
        return values.select(F.lit(field).alias("field"), "value",
                             F.col("value").alias("label"), "cnt")

    mediums = medium_options(events, direct, ordered=False).select(
        F.lit("medium").alias("field"), "value", "label", no_count)
    bounds = ("min_date", "max_date", "default_start", "default_end")
    stacked = ", ".join(f"'{b}', cast({b} AS string)" for b in bounds)
    dates = date_bounds(events).select(
        F.expr(f"stack({len(bounds)}, {stacked}) AS (field, value)")
    ).select("field", "value", F.col("value").alias("label"), no_count)
    parts = [
        listed("country", country_options(events, ordered=False)),
        listed("event_name", event_name_options(events, ordered=False)),
        listed("category", category_options(products, ordered=False)),
        mediums, dates,
    ]
    return reduce(DataFrame.unionByName, parts)


def filter_options_in_one_scan(events: DataFrame, products: DataFrame,
                               direct: str = DIRECT) -> DataFrame:
    """The same rows as ``filter_options``, from one scan of each table.

    Events are combined map-side to one row for each country, event name and medium that occur
    together; all lists and the date range are grouping sets over these few rows. Better than a
    column each when the table is large or not columnar, or when other columns are read anyway.
    """
    lists = ("country", "event_name", "traffic_medium")
    met = events.groupBy(*lists).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("min_day"), F.max("event_date").alias("max_day"))
    # A row that counts nothing, so that the date range has its rows even without events.
    nothing = events.sparkSession.range(1).select(*[
        F.lit(None).cast(met.schema[c].dataType).alias(c) for c in lists], F.lit(0).cast("long").alias("n"),
        *[F.lit(None).cast("date").alias(c) for c in ("min_day", "max_day")])
    sets = [[F.col(c)] for c in lists] + [[]]
    found = met.unionByName(nothing).groupingSets(sets, *lists).agg(
        F.grouping_id().alias("left_out"), F.sum("n").alias("n"),
        F.min("min_day").alias("min_date"), F.max("max_day").alias("max_date"))
    dates = found.withColumns({
        "default_start": F.greatest("min_date", F.date_sub("max_date", DEFAULT_DAYS - 1)), "default_end": F.col("max_date")})

    def line(field: str, value: Column, label: Column, count: Column | None = None) -> Column:
        count = F.lit(None).cast("long") if count is None else count
        return F.struct(F.lit(field).alias("field"), value.alias("value"), label.alias("label"), count.alias("cnt"))

    def listed(field: str) -> Column:
        return F.array(line(field, F.col(field), F.col(field), F.col("n")))

    medium = F.array(line("medium", F.coalesce("traffic_medium", F.lit("")), medium_label("traffic_medium", direct)))
    bounds = F.array(*[line(c, F.col(c).cast("string"), F.col(c).cast("string")) for c in ("min_date", "max_date", "default_start", "default_end")])
    # Bits of the columns that a grouping set leaves out, the last one lowest.
    only = {c: 7 ^ 1 << 2 - i for i, c in enumerate(lists)}
    lines = (
        F.when(F.col("left_out") == 7, bounds)
        .when((F.col("left_out") == only["country"]) & F.col("country").isNotNull(), listed("country"))
        .when((F.col("left_out") == only["event_name"]) & (F.col("n") > 0), listed("event_name"))
        .when((F.col("left_out") == only["traffic_medium"]) & (F.col("n") > 0), medium)
    )
    categories = category_options(products, ordered=False).select(
        F.lit("category").alias("field"), "value", F.col("value").alias("label"), "cnt")
    return dates.select(F.inline(lines)).unionByName(categories)
