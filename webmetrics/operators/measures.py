"""Aggregations and what is derived from aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmetrics.functions.scalar import (
    ColumnLike,
    col,
    flag,
    medium_label,
    percent,
    ratio,
)
from webmetrics.schema import DIRECT

#: Days of the range that is offered first.
DEFAULT_DAYS = 30


def count_rows(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def frequency(df: DataFrame, key: Column, name: str, count: str = "cnt") -> DataFrame:
    """Rows per key, in no order."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias(count))


def count_by(df: DataFrame, key: Column, name: str, count: str = "cnt") -> DataFrame:
    """Rows per key, most frequent first."""
    return frequency(df, key, name, count).orderBy(F.desc(count), F.asc_nulls_last(name))


def with_share(df: DataFrame, count: str = "cnt", name: str = "share") -> DataFrame:
    """Each row's part of the overall total, for already aggregated rows.

    The total is a scalar subquery over the same rows, so they are not gathered in one task.
    """
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(name, ratio(count, total))


def with_moving_average(df: DataFrame, rows: int, order: str, value: str, name: str,
                        by: Sequence[str] = ()) -> DataFrame:
    """Mean over the current and the ``rows - 1`` earlier existing rows.

    Meant for aggregated rows: without ``by`` the frame is one window, bounded by the number
    of days. Segments in ``by`` are spread over tasks.
    """
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(window))


def stage_mask(stages: Sequence[str]) -> Column:
    """The bit of an event's stage, 0 for other events."""
    bit = F.lit(0)
    for i, stage in enumerate(stages):
        bit = F.when(F.col("event_name") == stage, 1 << i).otherwise(bit)
    return bit


def completed(people: DataFrame, stages: Sequence[str]) -> DataFrame:
    """How many people's masks (``done``) have stage 1, stages 1-2, ...: one row, a column per stage."""
    prefix = [(2 << i) - 1 for i in range(len(stages))]
    return people.agg(*[
        F.count_if(F.col("done").bitwiseAND(mask) == mask).alias(stage)
        for stage, mask in zip(stages, prefix)
    ])


def stage_counts(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """People who did stage 1, stages 1-2, ... at any time: one row, a column per stage.

    Only stage events are read. Each person's stages are or-ed into one bit mask, map-side
    first, so a person costs one row per map task however many events there are.
    """
    people = (
        events.where(F.col("event_name").isin(*stages))
        .groupBy("user_pseudo_id").agg(F.bit_or(stage_mask(stages)).alias("done"))
    )
    return completed(people, stages)


def stage_flags(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per person one 0/1 column per stage, for everyone with any event."""
    return events.groupBy("user_pseudo_id").agg(*[
        F.max(flag(F.col("event_name") == stage)).alias(stage) for stage in stages
    ])


def options_by_frequency(df: DataFrame, column: str, keep: Column | None = None,
                         ordered: bool = True) -> DataFrame:
    """Values to choose from, most frequent first."""
    kept = df if keep is None else df.where(keep)
    return (count_by if ordered else frequency)(kept, F.col(column), "value")


def medium_options(events: DataFrame, direct: str = DIRECT, ordered: bool = True) -> DataFrame:
    """Distinct mediums, NULL first, as (value, label)."""
    mediums = events.select("traffic_medium").distinct()
    if ordered:
        mediums = mediums.orderBy(F.asc_nulls_first("traffic_medium"))
    return mediums.select(F.coalesce("traffic_medium", F.lit("")).alias("value"),
                          medium_label("traffic_medium", direct).alias("label"))


def date_bounds(events: DataFrame, default_days: int = DEFAULT_DAYS) -> DataFrame:
    """First and last day, and the default range: the last days, not before the first."""
    bounds = events.agg(F.min("event_date").alias("min_date"),
                        F.max("event_date").alias("max_date"))
    return bounds.select(
        "min_date", "max_date",
        F.greatest("min_date", F.date_sub("max_date", default_days - 1)).alias("default_start"),
        F.col("max_date").alias("default_end"),
    )


def conversion_summary(newusers: DataFrame) -> DataFrame:
    """People, buyers and the buyers' percentage (NULL without people)."""
    return newusers.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("did_purchase").alias("buyers"),
    ).select("users", "buyers", percent("buyers", "users").alias("conversion_rate"))


def purchase_summary(purchases: DataFrame) -> DataFrame:
    """Amounts by year and supplier, largest total of a year first."""
    return (
        purchases.groupBy("year", "supplier")
        .agg(F.sum("purchase_amount").alias("total_amount"),
             F.avg("purchase_amount").alias("avg_amount"))
        .orderBy("year", F.desc("total_amount"), "supplier")
    )


def linear_projection(df: DataFrame, x: ColumnLike, y: ColumnLike, at: float,
                      by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per group, and its value at a given x."""
    fitted = df.groupBy(*by).agg(
        F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"),
    )
    return fitted.withColumn("projected",
                             F.col("intercept") + F.col("slope") * F.lit(float(at)))
