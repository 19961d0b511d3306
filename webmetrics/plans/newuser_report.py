"""New-user reports over the one-row-per-person table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import newuser_filter
from webmetrics.functions.scalar import named, or_else, percent, percent_or_zero
from webmetrics.operators.measures import count_by, with_share
from webmetrics.operators.ordering import top_k
from webmetrics.schema import DIRECT, UNKNOWN_COUNTRY, UNKNOWN_DEVICE
from webmetrics.spec import FilterSpec


def filtered(newusers: DataFrame, spec: FilterSpec) -> DataFrame:
    return newusers.where(newuser_filter(spec))


def newuser_stats(newusers: DataFrame, spec: FilterSpec) -> DataFrame:
    """People, buyers, conversion in percent (0 if nobody), mean days to the first purchase.

    Only buyers with a purchase on or after the first visit's day enter the mean.
    """
    days = F.when(F.col("did_purchase") & (F.col("days_to_first_purchase") >= 0),
                  F.col("days_to_first_purchase"))
    return filtered(newusers, spec).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("did_purchase").alias("converted"),
        F.avg(days).alias("avg_days"),
    ).select("total", "converted", percent_or_zero("converted", "total").alias("rate"),
             "avg_days")


def newuser_trend(newusers: DataFrame, spec: FilterSpec) -> DataFrame:
    return (
        filtered(newusers, spec).groupBy(F.col("first_visit_date").alias("day"))
        .agg(F.count(F.lit(1)).alias("new_users"),
             F.count_if("did_purchase").alias("converted"))
        .orderBy(F.asc_nulls_last("day"))
    )


def newuser_device(newusers: DataFrame, spec: FilterSpec) -> DataFrame:
    device = or_else("device_type", UNKNOWN_DEVICE)
    return with_share(count_by(filtered(newusers, spec), device, "device"))


def newuser_country(newusers: DataFrame, spec: FilterSpec, n: int = 10) -> DataFrame:
    counts = (
        filtered(newusers, spec).groupBy(named("country", UNKNOWN_COUNTRY).alias("country"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return top_k(counts, [F.desc("cnt"), F.asc("country")], n)


def newuser_medium(newusers: DataFrame, spec: FilterSpec) -> DataFrame:
    medium = named("traffic_medium", DIRECT)
    return with_share(count_by(filtered(newusers, spec), medium, "medium"))


def newuser_conversion(newusers: DataFrame, spec: FilterSpec,
                       min_users: int = 20) -> DataFrame:
    """Conversion in percent per medium with enough people, lowest first."""
    return (
        filtered(newusers, spec).groupBy(named("traffic_medium", DIRECT).alias("medium"))
        .agg(F.count(F.lit(1)).alias("users"), F.count_if("did_purchase").alias("buyers"))
        .where(F.col("users") >= min_users)
        .withColumn("rate", percent("buyers", "users"))
        .orderBy("rate", "medium")
    )


def newuser_report(newusers: DataFrame | None,
                   spec: FilterSpec) -> dict[str, DataFrame] | None:
    """Everything the new-user view shows; None when the table was not built."""
    if newusers is None:
        return None
    return {
        "stats": newuser_stats(newusers, spec),
        "trend": newuser_trend(newusers, spec),
        "device": newuser_device(newusers, spec),
        "country": newuser_country(newusers, spec),
        "medium": newuser_medium(newusers, spec),
        "conversion": newuser_conversion(newusers, spec),
    }
