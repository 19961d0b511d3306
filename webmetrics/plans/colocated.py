"""Product reports on tables that are stored for their join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.functions.scalar import named
from webmetrics.operators.colocation import (
    JOIN_KEY,
    ROWS_PER_SALT,
    audiences,
    bought_by,
    hot_keys,
    salted_products,
)
from webmetrics.operators.ordering import top_k
from webmetrics.schema import UNCATEGORISED
from webmetrics.sources.scan import materialize
from webmetrics.sources.sink import StoreLayout, times_with_statistics
from webmetrics.sources.versions import Version, write_version
from webmetrics.spec import FilterSpec


@dataclass(frozen=True)
class Colocated:
    """Stored products and audiences; ``filter`` joins them bucket by bucket."""

    products: DataFrame
    audiences: DataFrame

    def filter(self, spec: FilterSpec) -> DataFrame:
        return bought_by(self.products, self.audiences, spec)


def _bucketed(df: DataFrame, name: str, layout: StoreLayout, buckets: int) -> Version:
    """The next version of a table with a sorted file for each bucket."""
    times_with_statistics(df.sparkSession)
    # The shuffle deals rows as buckets do, so that every task writes one file.
    dealt = df.repartition(buckets, *JOIN_KEY)
    return write_version(dealt, layout.table(name), layout.folder(df.sparkSession), buckets=(buckets, JOIN_KEY))


def store_colocated(products: DataFrame, events: DataFrame, buckets: int, layout: StoreLayout = StoreLayout(),
                    rows_per_salt: int = ROWS_PER_SALT) -> Colocated:
    """Store both sides. ``buckets`` is the parallelism of later joins: choose it so that a bucket of products
    fits a task, some hundred megabytes."""
    # Known before the joins with it are planned, so that a small one is broadcast and products are shuffled once.
    hot = materialize(hot_keys(products, rows_per_salt))
    hot.count()
    try:
        staged = [
            _bucketed(salted_products(products, hot, buckets), "products_by_event", layout, buckets),
            _bucketed(audiences(events, hot), "audiences_by_event", layout, buckets),
        ]
    finally:
        hot.unpersist()
    for version in staged:
        version.switch()
    return open_colocated(products.sparkSession, layout)


def open_colocated(spark: SparkSession, layout: StoreLayout = StoreLayout()) -> Colocated:
    return Colocated(spark.table(layout.table("products_by_event")), spark.table(layout.table("audiences_by_event")))


def category_revenue(store: Colocated, spec: FilterSpec, n: int = 5, uncategorised: str = UNCATEGORISED) -> DataFrame:
    """As ``product_report.category_revenue``."""
    return _leading(store.filter(spec), named("item_category", uncategorised), "category", "item_total_revenue", "revenue", n)


def top_items(store: Colocated, spec: FilterSpec, n: int = 10) -> DataFrame:
    """As ``product_report.top_items``."""
    return _leading(store.filter(spec), named("item_name", F.col("item_id")), "item", "item_quantity", "qty", n)


def _leading(rows: DataFrame, label: Column, name: str, measure: str, total: str, n: int) -> DataFrame:
    sums = rows.groupBy(label.alias(name)).agg(F.sum(measure).alias(total)).where(F.col(total) > 0)
    return top_k(sums, [F.desc(total), F.asc_nulls_last(name)], n)
