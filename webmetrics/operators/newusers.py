"""One row per new user: the first visit and what the person bought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webmetrics.functions.scalar import day_of, days_between, flag_not_null, from_micros
from webmetrics.operators.flatten import event_column
from webmetrics.schema import FIRST_VISIT_DIMENSIONS, NEWUSER_COLUMNS


def first_event_per_user(raw: DataFrame, name: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Each person's earliest event of that name.

    Spark keeps one row per person in every map task before it shuffles (WindowGroupLimit),
    so a person with very many events does not fill a reducer. ``tie_break`` names columns
    that make the choice between simultaneous events definite.
    """
    earliest = Window.partitionBy("user_pseudo_id").orderBy("event_timestamp", *tie_break)
    return (
        raw.where(F.col("event_name") == name)
        .withColumn("rn", F.row_number().over(earliest))
        .where("rn = 1").drop("rn")
    )


def purchase_rollup(raw: DataFrame) -> DataFrame:
    """Per buyer: first purchase, revenue (NULL if none was recorded), distinct orders.

    The distinct count shuffles on (person, order) after a map-side combine, so one heavy
    buyer is spread over all tasks.
    """
    return (
        raw.where(F.col("event_name") == "purchase")
        .select("user_pseudo_id", "event_timestamp",
                F.col("ecommerce.purchase_revenue_in_usd").alias("revenue"),
                F.col("ecommerce.transaction_id").alias("transaction_id"))
        .groupBy("user_pseudo_id")
        .agg(F.min("event_timestamp").alias("first_purchase_micros"),
             F.sum("revenue").alias("purchase_revenue_total"),
             F.count_distinct("transaction_id").alias("purchase_count"))
        .select("user_pseudo_id", "purchase_revenue_total", "purchase_count",
                from_micros("first_purchase_micros").alias("first_purchase_datetime"))
    )


def build_new_users(raw: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """First visits with conversion flags; people who never bought stay in.

    Purchases before the first visit count as well and give negative days. Conversion is
    judged inside ``raw`` only: load the whole period, not month by month.
    """
    visits = raw.select(
        "user_pseudo_id", "event_name", "event_timestamp", *tie_break,
        event_column("event_date").alias("first_visit_date"),
        event_column("event_datetime").alias("first_visit_datetime"),
        *map(event_column, FIRST_VISIT_DIMENSIONS),
    )
    first = first_event_per_user(visits, "first_visit", tie_break)
    bought = purchase_rollup(raw).withColumn("buyer", F.col("user_pseudo_id"))
    return first.join(bought, "user_pseudo_id", "left").select(
        "user_pseudo_id", "first_visit_date", "first_visit_datetime", *FIRST_VISIT_DIMENSIONS,
        flag_not_null("buyer").alias("did_purchase"),
        "first_purchase_datetime",
        "purchase_revenue_total",
        F.coalesce("purchase_count", F.lit(0)).alias("purchase_count"),
        days_between(day_of("first_purchase_datetime"),
                     "first_visit_date").alias("days_to_first_purchase"),
    ).select(*NEWUSER_COLUMNS)
