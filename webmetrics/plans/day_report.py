"""The event reports from stored daily states: any range of days without reading events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.functions.predicates import event_filter, f_date
from webmetrics.operators.daystate import (
    DAY,
    DayState,
    answerable,
    day_state,
    new_numbers,
    range_sums,
    stage_counts_of,
)
from webmetrics.operators.measures import with_moving_average
from webmetrics.plans.event_report import both_periods, compared
from webmetrics.schema import FUNNEL_STAGES
from webmetrics.sources.sink import StoreLayout, times_with_statistics
from webmetrics.sources.versions import current_rows, partition_folders, write_version
from webmetrics.spec import Day, FilterSpec, as_day

NUMBERS, BATCH = "day_numbers", "batch"


def kpi(state: DayState, spec: FilterSpec) -> DataFrame:
    """As ``event_report.kpi``."""
    return range_sums(state, spec).withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))


def kpi_compare(state: DayState, spec: FilterSpec) -> DataFrame:
    """As ``event_report.kpi_compare``."""
    whole, is_current = both_periods(spec)
    return compared(range_sums(state, whole, is_current), spec)


def daily_trend(state: DayState, spec: FilterSpec, window: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """As ``event_report.daily_trend``; ``by`` are columns that the state is split by."""
    answerable(state, spec)
    daily = state.totals.where(event_filter(spec)).groupBy(*by, F.col(DAY).alias("day")).agg(
        F.sum("events").alias("events"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    return with_moving_average(daily, window, "day", "events", "ma7", by).orderBy(*by, "day")


def funnel(state: DayState, spec: FilterSpec) -> DataFrame:
    """As ``event_report.funnel``, for the stages that the state was made with."""
    return stage_counts_of(state, spec)


def load_days(spark: SparkSession, events: DataFrame, layout: StoreLayout = StoreLayout(), start: Day = None,
              end: Day = None, by: Sequence[str] = (), stages: Sequence[str] = FUNNEL_STAGES) -> DayState:
    """Compute the states of the days from ``start`` to ``end`` and store them in place of those days' old ones.

    Of ``events`` only these days are read, and only these days are written; without bounds, all are
    (events without a day included). Names keep their numbers, new names are added to the stored list.
    Use the same ``by`` and ``stages`` for all days of a layout.
    """
    first, last = as_day(start), as_day(end)
    everything = first is None and last is None
    rows = events if everything else events.where(f_date(DAY, first, last))
    folder = layout.folder(spark)
    times_with_statistics(spark)

    def stays(spec: dict) -> bool:
        day = as_day(spec[DAY])
        return not everything and (day is None or (first is not None and day < first) or (last is not None and day > last))

    name = layout.table(NUMBERS)
    known = current_rows(spark, name)
    batch = f"{len(partition_folders(spark, name)) + 1:06d}"
    added = new_numbers(rows, known).withColumn(BATCH, F.lit(batch))
    numbers = write_version(added, name, folder, [BATCH], ["kind", "name", "number"], lambda spec: True)
    state = day_state(rows, numbers.rows().drop(BATCH), by, stages)
    staged = [
        write_version(df.hint("rebalance", DAY), layout.table(f"day_{part}"), folder, [DAY], df.columns, stays)
        for part, df in state.frames().items()
    ]
    for version in (numbers, *staged):
        version.switch()
    return open_days(spark, layout, by, stages)


def open_days(spark: SparkSession, layout: StoreLayout = StoreLayout(), by: Sequence[str] = (),
              stages: Sequence[str] = FUNNEL_STAGES) -> DayState:
    """The stored state of all days."""
    frames = {part: spark.table(layout.table(f"day_{part}")) for part in ("totals", "seen", "masks")}
    return DayState(by=tuple(by), stages=tuple(stages), **frames)
