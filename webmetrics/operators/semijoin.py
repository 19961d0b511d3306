"""Products restricted by properties of their event, without multiplying rows.

(person, time) is unique on neither side, so an inner join would count revenue several
times; a left-semi join keeps each product row once. Both sides may also be skewed: one
(person, time) pair can hold a large part of all rows. The three forms below differ in how
they keep that pair from filling a single task:

* ``filter_products_by_events`` returns the rows themselves and leaves the product side of
  the join directly on a shuffle, which AQE can split;
* ``totals_by_events`` combines product rows map-side before the join;
* ``leading_by_events`` drops, map-side and exactly, rows that cannot reach a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmetrics.functions.predicates import audience_filter, product_filter
from webmetrics.operators.ordering import reaching, top_k
from webmetrics.spec import FilterSpec

EVENT_KEY = ["user_pseudo_id", "event_datetime"]


def _needs_events(spec: FilterSpec, events: DataFrame | None) -> bool:
    if spec.narrows_events and events is None:
        raise ValueError("medium, country and keyword filters need the events table")
    return spec.narrows_events


def matching_keys(bought: DataFrame, events: DataFrame, spec: FilterSpec,
                  *also: str) -> DataFrame:
    """The distinct keys of events that satisfy the audience filters.

    The dates of the filter say nothing about event rows. When they narrow the products,
    though, only events from the first to the last moment of these products can match, so the
    rest is neither read (the range reaches the scan) nor shuffled.
    """
    wanted = audience_filter(spec)
    if spec.start is not None or spec.end is not None:
        moment = F.col("event_datetime")
        # The second condition keeps Spark from merging both values into one struct, whose
        # fields the Parquet reader could not compare with its statistics.
        first = bought.agg(F.min("event_datetime")).scalar()
        last = bought.where(moment.isNotNull()).agg(F.max("event_datetime")).scalar()
        wanted = wanted & (moment >= first) & (moment <= last)
    return events.where(wanted).select(*EVENT_KEY, *also).distinct()


def filter_products_by_events(products: DataFrame, events: DataFrame | None,
                              spec: FilterSpec) -> DataFrame:
    """Product rows under the whole filter; no join if nothing is asked of the event.

    Keys are made distinct together with the event day. That takes heavy keys down to a few
    rows map-side, and because the day is not part of the join, Spark shuffles both inputs
    for the join itself: the shape in which AQE splits a skewed product partition.
    """
    bought = products.where(product_filter(spec))
    if not _needs_events(spec, events):
        return bought
    keys = matching_keys(bought, events, spec, "event_date").select(*EVENT_KEY)
    return bought.join(keys, EVENT_KEY, "left_semi").select(*products.columns)


def _summed(bought: DataFrame, events: DataFrame, spec: FilterSpec, by: Sequence[Column],
            measure: Column) -> DataFrame:
    """Matching keys with ``measure`` summed per key and ``by`` (columns by_0, by_1, ...).

    All rows of a key share the join's answer, so they are combined map-side before it.
    """
    group = [c.alias(f"by_{i}") for i, c in enumerate(by)]
    return (
        bought.groupBy(*EVENT_KEY, *group).agg(F.sum(measure).alias("measure"))
        .join(matching_keys(bought, events, spec), EVENT_KEY, "left_semi")
    )


def totals_by_events(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                     by: Sequence[Column], measure: Column, total: str) -> DataFrame:
    """``sum(measure)`` under the whole filter, per ``by`` (or overall)."""
    bought = products.where(product_filter(spec))
    if not _needs_events(spec, events):
        group = [c.alias(f"by_{i}") for i, c in enumerate(by)]
        return bought.groupBy(*group).agg(F.sum(measure).alias(total))
    group = [f"by_{i}" for i in range(len(by))]
    return _summed(bought, events, spec, by, measure).groupBy(*group).agg(
        F.sum("measure").alias(total))


def leading_by_events(products: DataFrame, events: DataFrame | None, spec: FilterSpec,
                      order: Sequence[Column], rows: int) -> DataFrame:
    """Product rows under the whole filter, less those that cannot be among the ``rows`` latest.

    ``order`` sorts rows of one time. Every key stands for at least one row, so the latest
    ``rows`` matching keys reach far enough back. A row behind ``rows`` others of its own key
    has as many ahead of it, so that a key with very many rows is thinned map-side. Neither
    step loses a row of the page.
    """
    bought = products.where(product_filter(spec))
    moment = F.col("event_datetime")
    if not _needs_events(spec, events):
        return reaching(bought, moment, False, rows)
    # The condition is always true. It keeps the sum, so that this plan and the row count of
    # the page (``totals_by_events`` of 1) share their shuffles.
    keys = _summed(bought, events, spec, [], F.lit(1)).where("measure > 0")
    earliest = top_k(keys, [F.desc("event_datetime")], rows).agg(F.min("event_datetime"))
    recent = bought.where(moment >= earliest.scalar())
    within_key = Window.partitionBy(*EVENT_KEY).orderBy(*order)
    return (
        recent.withColumn("place", F.row_number().over(within_key))
        .where(F.col("place") <= rows).drop("place")
        .join(matching_keys(bought, events, spec), EVENT_KEY, "left_semi")
    )
