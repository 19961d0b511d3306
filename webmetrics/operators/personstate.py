"""What is known of each person, kept by delivered shard so that shards can be replaced.

A shard's state has a row for each person and order: the earliest visit, the first purchase, the
revenue and the number of purchases. Rows of several shards are combined by minima, sums and a count
of distinct orders, in any order, so a load reads its own shards and the state, never old events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.scalar import day_of, days_between, from_micros
from webmetrics.operators.flatten import event_column
from webmetrics.schema import FIRST_VISIT_DIMENSIONS, NEWUSER_COLUMNS

PERSON = "user_pseudo_id"


def person_state(raw: DataFrame, tie_break: Sequence[str] = (),
                 by: Sequence[str] = ("table_suffix",)) -> DataFrame:
    """State of the raw records, one scan of visits and purchases, combined map-side.

    Rows are spread by person and order. Visits belong to no order, so all of a person's visits in a
    shard end in one row; ``tie_break`` and then the visit's own columns decide between
    simultaneous ones. As in a join, purchases of nobody (a NULL person) count for nobody.
    """
    visited = F.col("event_name") == "first_visit"
    bought = (F.col("event_name") == "purchase") & F.col(PERSON).isNotNull()
    visit = F.struct(
        "event_timestamp", *tie_break, event_column("event_date").alias("first_visit_date"),
        event_column("event_datetime").alias("first_visit_datetime"),
        *map(event_column, FIRST_VISIT_DIMENSIONS))
    rows = raw.where(F.col("event_name").isin("first_visit", "purchase")).select(
        *by, PERSON,
        F.when(bought, F.col("ecommerce.transaction_id")).alias("transaction_id"),
        F.when(visited, visit).alias("visit"),
        F.when(bought, F.col("event_timestamp")).alias("purchase_micros"),
        F.when(bought, F.col("ecommerce.purchase_revenue_in_usd")).alias("revenue"),
        F.when(bought, 1).otherwise(0).alias("purchases"),
    )
    return rows.groupBy(*by, PERSON, "transaction_id").agg(
        F.min("visit").alias("visit"), F.min("purchase_micros").alias("purchase_micros"),
        F.sum("revenue").alias("revenue"), F.sum("purchases").alias("purchases"))


def people_of(state: DataFrame) -> DataFrame:
    """New users (``NEWUSER_COLUMNS``) from the state of any number of shards.

    The distinct count shuffles on (person, order), so one heavy buyer is spread over all tasks.
    """
    people = state.groupBy(PERSON).agg(
        F.min("visit").alias("visit"), F.min("purchase_micros").alias("purchase_micros"),
        F.sum("revenue").alias("purchase_revenue_total"), F.sum("purchases").alias("purchases"),
        F.count_distinct("transaction_id").alias("purchase_count"),
    ).where("visit IS NOT NULL")
    return people.select(
        "*", "visit.first_visit_date", "visit.first_visit_datetime",
        *[f"visit.{name}" for name in FIRST_VISIT_DIMENSIONS],
        (F.col("purchases") > 0).alias("did_purchase"),
        from_micros("purchase_micros").alias("first_purchase_datetime"),
    ).withColumn(
        "days_to_first_purchase", days_between(day_of("first_purchase_datetime"), "first_visit_date"),
    ).select(*NEWUSER_COLUMNS)


def of_people(rows: DataFrame, people: DataFrame, kind: str = "left_semi") -> DataFrame:
    """``rows`` of the given people, or with ``left_anti`` of all others; NULL is a person, too."""
    wanted = people.select(F.col(PERSON).alias("wanted_person"))
    return rows.join(wanted, F.col(PERSON).eqNullSafe(F.col("wanted_person")), kind)
