"""Event reports: KPI, comparison with the previous period, trend, composition, funnel.

Each function takes the flat events table and a FilterSpec and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import event_filter
from webmetrics.functions.scalar import (
    ColumnLike,
    col,
    days_between,
    or_else,
    percent,
    percent_or_zero,
    shift_days,
)
from webmetrics.operators.measures import (
    count_by,
    stage_counts,
    with_moving_average,
    with_share,
)
from webmetrics.schema import (
    FUNNEL_STAGES,
    PERIOD_NAMES,
    PERIOD_OF_DAYS,
    PERIOD_UNKNOWN,
    UNKNOWN_DEVICE,
)
from webmetrics.sources.sink import RowCount, counted
from webmetrics.spec import FilterSpec

KPIS = ("events", "users", "revenue", "transactions")


def filtered(events: DataFrame, spec: FilterSpec) -> DataFrame:
    return events.where(event_filter(spec))


def _kpi_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("user_pseudo_id").alias("users"),
        F.sum("total_purchase_revenue").alias("revenue"),
        F.count_distinct("transaction_id").alias("transactions"),
    ]


def kpi(events: DataFrame, spec: FilterSpec) -> DataFrame:
    """Events, distinct people, revenue (0 if none), distinct orders: always one row."""
    return filtered(events, spec).agg(*_kpi_columns()).select(
        "events", "users", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), "transactions")


def kpi_compare(events: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row per KPI: current and previous value, change in percent, direction, status.

    Both periods come from one scan, grouped by period. The change is NULL where the
    previous value is 0 or missing. Status: ``has_previous``, ``out_of_range`` (no events in
    the previous period) or ``no_dates``.
    """
    whole, is_current = both_periods(spec)
    per_period = filtered(events, whole).groupBy(is_current).agg(*_kpi_columns())
    return compared(per_period, spec)


def both_periods(spec: FilterSpec) -> tuple[FilterSpec, Column]:
    """A filter for the period and the one before it, and which of them a row is in."""
    before = spec.previous()
    whole = spec if before is None else spec.between(before.start, spec.end)
    is_current = F.lit(True) if before is None else F.col("event_date") >= F.lit(spec.start)
    return whole, is_current.alias("is_current")


def compared(per_period: DataFrame, spec: FilterSpec) -> DataFrame:
    """The comparison, from the KPIs of both periods (a row each, if it has events)."""
    before = spec.previous()
    both = per_period.agg(*[
        F.max(F.when(F.col("is_current") == current, F.col(name).cast("double")))
        .alias(f"{name}_{side}")
        for name in KPIS for side, current in (("cur", True), ("prev", False))
    ])
    lines = both.select(
        F.col("events_prev").alias("events_before"),
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("kpi"),
                     F.coalesce(f"{name}_cur", F.lit(0.0)).alias("current"),
                     _previous(name, before is not None).alias("previous"))
            for name in KPIS
        ])),
    )
    if before is None:
        status = F.lit("no_dates")
    else:
        status = F.when(F.coalesce("events_before", F.lit(0.0)) > 0, "has_previous") \
            .otherwise("out_of_range")
    change = percent(F.col("current") - F.col("previous"), "previous")
    return lines.select(
        "kpi", "current", "previous", change.alias("pct"), (change >= 0).alias("up"),
        status.alias("status"))


def _previous(name: str, known: bool) -> Column:
    if not known:
        return F.lit(None).cast("double")
    return F.coalesce(f"{name}_prev", F.lit(0.0))


def previous_period(start: ColumnLike, end: ColumnLike) -> tuple[Column, Column]:
    """The adjoining earlier range of equal length; NULL if a bound is missing."""
    last = F.when(col(end).isNotNull(), shift_days(start, -1))
    first = F.date_sub(shift_days(start, -1), days_between(end, start))
    return first, last


def period_label(start: ColumnLike, end: ColumnLike,
                 names: Sequence[tuple[int, int, str]] = PERIOD_NAMES,
                 of_days: str = PERIOD_OF_DAYS, unknown: str = PERIOD_UNKNOWN) -> Column:
    """A plain name for the previous period, from the number of days including both ends."""
    days = days_between(end, start) + 1
    name = F.when(days.isNull(), unknown)
    for fewest, most, text in names:
        name = name.when(days.between(fewest, most), text)
    before, after = of_days.split("{}")
    return name.otherwise(F.concat(F.lit(before), days.cast("string"), F.lit(after)))


def daily_trend(events: DataFrame, spec: FilterSpec, window: int = 7,
                by: Sequence[str] = ()) -> DataFrame:
    """Per day: events, revenue, moving average of events over existing days.

    ``by`` adds segments (e.g. country) with an average of their own.
    """
    daily = filtered(events, spec).groupBy(*by, F.col("event_date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum("total_purchase_revenue"), F.lit(0.0)).alias("revenue"),
    )
    return with_moving_average(daily, window, "day", "events", "ma7", by).orderBy(*by, "day")


def device_share(events: DataFrame, spec: FilterSpec) -> DataFrame:
    device = or_else("device_type", UNKNOWN_DEVICE)
    return with_share(count_by(filtered(events, spec), device, "device"))


def event_composition(events: DataFrame, spec: FilterSpec) -> DataFrame:
    return count_by(filtered(events, spec), F.col("event_name"), "name")


def funnel(events: DataFrame, spec: FilterSpec,
           stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """Cumulative distinct people per stage, one row; the event-name filter is ignored."""
    return stage_counts(filtered(events, spec.without_events()), stages)


def funnel_rates(counts: DataFrame, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """One row per stage, in percent: of the first stage, of the stage before, overall.

    The counts arrive as one row, so all rates are row expressions.
    """
    first, last = stages[0], stages[-1]
    lines = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(stage).alias("stage"),
            F.col(stage).alias("users"),
            percent_or_zero(stage, first).alias("pct_initial"),
            (percent_or_zero(stage, stages[i - 1]) if i else F.lit(None).cast("double"))
            .alias("step_rate"),
            percent_or_zero(last, first).alias("overall_rate"),
        )
        for i, stage in enumerate(stages)
    ]
    return counts.select(F.inline(F.array(*lines)))


def matched_rows(events: DataFrame, spec: FilterSpec) -> tuple[DataFrame, RowCount]:
    """Filtered events and the number of them, counted while another action reads them."""
    return counted(filtered(events, spec))


def event_report(events: DataFrame, spec: FilterSpec) -> dict[str, DataFrame]:
    """Everything one refresh of the event view shows.

    The frames are independent. Pass a materialised ``events`` to share one scan.
    """
    return {
        "kpi_compare": kpi_compare(events, spec),
        "daily_trend": daily_trend(events, spec),
        "device_share": device_share(events, spec),
        "event_composition": event_composition(events, spec),
        "funnel": funnel_rates(funnel(events, spec)),
    }
